"""Deal-intelligence table work expressed as Spark DataFrame jobs."""
