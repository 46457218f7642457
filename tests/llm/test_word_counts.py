"""Words of labelled documents are counted in parts of bounded size."""

from collections import Counter

import pyarrow as pa

from quarry.llm.quality import COUNTED, terms, word_counts


def rows(n):
    return [(f"common word{i % 900} {chr(97 + i % 26) * 7} other{i}" if i % 11 else None, i % 2, int(i % 5 == 0)) for i in range(n)]


def test_counts_in_parts_add_up():
    import re

    given = rows(3000)
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*given[at : at + 700]), (pa.string(), pa.int64(), pa.int64()))], ["text", "quality", "toxic"]) for at in range(0, 3000, 700)]
    want = Counter()
    for text, quality, toxic in given:
        for word in terms(re.findall(r"[^\W\d_]+", (text or "").lower())):
            want[word, "n"] += 1
            want[word, "quality"] += quality
            want[word, "toxic"] += toxic
    for most in (1, 10, COUNTED):
        parts = list(word_counts(iter(batches), most))
        got = Counter()
        for part in parts:
            for row in part.to_pylist():
                for name in ("n", "quality", "toxic"):
                    got[row["word"], name] += row[name]
        assert +got == +want and all(p.num_rows <= most + 12 for p in parts) and (len(parts) > 1) == (most < COUNTED)
    assert [p.num_rows for p in word_counts(iter([]))] == [0]
