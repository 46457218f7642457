"""Which listed texts are names of companies: fixed values, and the rules over them as Columns and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.staging import written

# Texts of buttons, menus, filters and labels that are no company.
UI_WORDS = (
    "get in touch", "go-to-market", "view all", "load more", "show more", "learn more", "read more", "visit website", "visit site", "back to top", "contact us",
    "about us", "our team", "our portfolio", "our startups", "our mission", "see all", "see more", "subscribe", "sign up", "log in", "login", "sign in",
    "privacy policy", "privacy", "privacy center", "terms of service", "terms of use", "terms", "cookie policy", "cookie settings", "filter", "sort", "search",
    "menu", "close", "open", "all companies", "all", "current portfolio", "previous portfolio", "active", "exited", "limited partner login", "investor portal",
    "lp portal", "lp log-in", "investor login", "for investors", "for founders", "for lps", "for lp's", "how we invest", "series a", "series b", "series c",
    "series d", "series e", "pre-seed", "seed", "ipo", "gaming", "health", "health tech", "consumer", "finance", "media", "software", "education", "marketplace",
    "other", "resources", "news", "blog", "press", "insights", "newsletter", "team", "studio", "linkedin", "twitter", "facebook", "instagram", "podcast", "faq",
    "faqs", "reset", "apply", "cancel", "submit", "back", "next", "previous", "more", "less", "fundraising", "founder services", "investments", "partners",
    "network", "careers", "events", "overview", "contact", "home", "stage", "spotlight", "trending topics", "disclosures", "featured", "enterprise", "commerce",
    "crypto", "robotics", "space", "hardware", "fintech", "cybersecurity", "ai apps", "ai infrastructure & developer platforms", "data, ai & machine learning",
    "energy & infrastructure", "enterprise apps & vertical ai", "infrastructure & developer tools", "jobs", "portfolio jobs", "digital health", "life sciences",
    "loading...")
# Labels that are no company wherever they stand, in either case.
ANYWHERE = ("Founder(s)", "Partner Since", "Year of Investment", "Investment Status", "Entry Stage", "Country:", "Industry:", "Sector:", "DISCLAIMER", "Portfolio Highlights")
# Patterns of filters and notices, in either case.
CONTENT = (
    "Published on", "Exits?(true|false)$", "Stage RTP", "SectorFintech", "SectorAI", "SectorSaaS", "SectorE-commerce", "SectorAgriculture", "CustomerB2[BC]",
    "New York, NY.*Enterprise", "Tel Aviv.*Enterprise", "San Francisco, CA.*Enterprise", "Status:?(Current|Exited|Active)", "AllMedia$", "AllCommerce$", "AllSaaS$",
    "AllFinTech$", "AllHealthcare$", "AllEducation$", "AllHR$", "AllPropTech$", "AllSocial$", "AllCrypto$", "CommerceAll$", "FinTechAll$", "HealthcareAll$",
    "EducationAll$", "SaaSAll$", "Link opens in new tab", "ENTERPRISE WEEKLY NEWSLETTER", "BROWSE OUR", "PLAY VIDEO", "VIEW LEGAL", "NVP PROMISE", "COMPANY↑",
    "Initial investment:", "Entry Year:", "Entry Stage:", "Country:", "Marketplace:All")
# Words of categories; a name glued of them alone is no company.
CATEGORY_TOKENS = (
    "AI", "CONSUMER", "Consumer", "Fintech", "Healthcare", "Enterprise", "Saas", "SaaS", "Hardware", "Robotics", "Space", "Media", "Commerce", "Brands", "Strategy",
    "Featured", "PropTech", "Social", "Crypto", "Climate", "Security", "Infrastructure", "Logistics", "Gaming", "Education")
# Single words and places that are no company.
SINGLE_WORDS = (
    "ai", "biotech", "food", "saas", "fintech", "healthcare", "edtech", "cleantech", "proptech", "insurtech", "crypto", "web3", "gaming", "media", "commerce",
    "ecommerce", "logistics", "robotics", "defense", "energy", "agriculture", "education", "legal", "sports", "entertainment", "climate", "security",
    "infrastructure", "data", "platform", "marketplace", "software", "hardware", "social", "travel", "fitness", "beauty", "fashion", "music", "b2b", "b2c",
    "consumer", "enterprise", "current", "explore")
GEOGRAPHY = ("bay area", "new york", "san francisco", "los angeles", "boston", "austin", "seattle", "london", "global")
# Beginnings of texts about the list itself, in either case.
META = (
    "Select investments", "Showing results", "Showcasing ", "View (Research|Portfolio|All)", "Click here", "Explore Our", "MetaProp Portfolio", "Hypothesis Portfolio",
    "Launched in ", "Simple consumer ", "Current$", "Backed at ", "See all backed", "Our Advisors", "Our Culture", "Explore CTEK", "Visit Our", "Diverse perspectives",
    "Tag Field", "hello@", r"@\w+", "Info$", "Industries$", "Grants$", "Theses$", "Writing$", "Connect$", "No Results Found", "Privacy Settings", r"\(c\) \d{4}",
    r"copyright \d{4}")
# Sectors of which three in a name of over 20 letters are a list, verbs of descriptions of over 40 letters,
# small words in sentences of over 35.
SECTORS = ("AI", "SaaS", "Fintech", "Healthcare", "Commerce", "Security", "Industrials", "Digital", "Infra")
VERBS = (
    " is a ", " is an ", " provides ", " delivers ", " develops ", " offers ", " enables ", " builds ", " allows ", " revolutionizes ", " partnering ",
    " dedicated to ", " bringing ", " powered by ")
SMALL_WORDS = ("in", "for", "of", "the", "and", "a", "to", "an", "&")
# Further patterns, as they are and in either case.
PATTERNS = (
    r"^\d+$", r"-(Developer|Creator|Maker|Builder|Provider)\s+of\s", r"^Acquired\s+by\s", r"^Exited(\s+to\s|\s+Investments$)", "^Acquired$", "^Status[A-Z]",
    "^(Consumer|Enterprise|AI|Fintech|Healthcare|Commerce)(Current|Exited|Active|Live)$", "^Sector[A-Z]", r"^Investment\s+Year\d{4}$", "^Country[A-Z]",
    r"^[\w.+-]+@[\w.-]+\.\w+$", r"^@\w+", r"\bIcon$", "(Pre-Seed|Series [A-Ea-e]|Seed)(Pre-Seed|Series [A-Ea-e]|Seed|IPO)", "^Initial Investment", "^Strategy[A-Z]",
    "Founders'.*Portfolio|Portfolio Companies$", r"(Consumer|Media|Health|Finance|Software|Education|Marketplace)\d{4}$", r"Invested\d{4}$", r"^AI\d{4}$", r"^\(", "Acq:",
    "^(NASDAQ|NYSE)", "^(Austin|Boston|London|New York|San Francisco|Tel Aviv|Toronto|Washington).*,", r"\S\s+\S.*\s+Series [A-E]$")
EITHER_CASE = (r"^About\b", "other-", "^(AI-powered|AI-Native|An? investment|A specialty|An? AI|A platform|The leading|An? \\w+ that)", "^(Design|Built|Made|Powered|Created) by ")
# Patterns that count in names of more letters than the first number and of fewer than the second.
BY_LENGTH = (
    ("^(Acquired|IPO)[A-Z][a-z]", 0, 25), ("[a-z]ALL[A-Z]|[A-Z]ALL[a-z]|ALL$", 10, 99), ("(Food|Finance|Consumer|Enterprise|Health|Media|Commerce|Marketplace)(All|Current|Exited)$", 8, 99),
    (r"\.$", 10, 99), (r"(?i)^The\s+\w+\s+of\s+\w+", 0, 30), (r"\s+(Platform|Solution|Solutions|Automation|Optimization|Apps)$", 30, 99),
    ("^(Austin|Boston|London|New York|San Francisco|Tel Aviv|Toronto|Washington)", 20, 99), ("^Filter", 10, 99), (r"Together\.|Startups,", 20, 99),
    (r"(?i)\b(for|of)\b.*\b(for|of)\b", 30, 99), (r"^[A-Z]\S*(\s+\S+){3,}\s+for\s+[A-Z]|^[A-Z]\S*(\s+\S+)*\s+for\s+[A-Z]\S*(\s+\S+){3,}", 35, 99))
LONGEST = 60
INVISIBLE = r"[\x{200b}-\x{200f}\x{2028}-\x{202f}\x{2060}\x{feff}]"
# Rows that a clean-up deletes, as LIKE patterns in either case with the lengths that they count beyond and below.
JUNK_LIKE = (
    ("%Founder(s)%", 0, 999), ("%Partner Since%", 0, 999), ("%Exit", 0, 30), ("%DISCLAIMER%", 0, 999), ("Country:%", 0, 999), ("CountryUS%", 0, 999), ("Investment Status:%", 0, 999),
    ("Entry Stage:%", 0, 999), ("Entry Year:%", 0, 999), ("Industry:%", 0, 999), ("Sector:%", 0, 999), ("Year of Investment%", 0, 999), ("%Published on%", 0, 999), ("%Stage RTP%", 0, 999),
    ("%SectorFintech%", 0, 999), ("%SectorAI%", 0, 999), ("%SectorSaaS%", 0, 999), ("%SectorE-commerce%", 0, 999), ("%SectorAgriculture%", 0, 999), ("%CustomerB2%", 50, 999),
    ("Initial investment:%", 0, 999), ("%Status:Current%", 0, 999), ("%Status:Exited%", 0, 999), ("%StatusCurrent%", 0, 999), ("%StatusExited%", 0, 999), ("%AllMedia", 0, 999),
    ("%CommerceAll", 0, 999), ("%FinTechAll", 0, 999), ("%HealthcareAll", 0, 999), ("%EducationAll", 0, 999), ("%SaaSAll", 0, 999), ("%PropTechAll", 0, 999), ("%SocialAll", 0, 999),
    ("%AllHR", 0, 999), ("%AllPropTech", 0, 999), ("%AllSocial", 0, 999), ("%AllCommerce", 0, 999), ("%AllSaaS", 0, 999), ("%AllFinTech", 0, 999), ("%Link opens in new tab%", 0, 999),
    ("Spotlight%:%", 0, 999), ("Filter%", 10, 999), ("Austin, TX%", 12, 999), ("Boston, MA%", 12, 999), ("San Francisco, CA%", 20, 999), ("Tel Aviv, Israel%", 18, 999),
    ("New York, NY%", 14, 999), ("London, UK%", 12, 999), ("Toronto, Canada%", 18, 999), ("Washington DC%", 15, 999), ("NASDAQ%", 0, 999), ("NYSE%", 0, 999), ("%Enterprise/Saas%", 0, 999))
JUNK_NAMES = ("company↑", "play video", "view legal disclosures", "browse our—portfolio", "nvp promise", "enterprise weekly newsletter")
JUNK_UI = (
    "get in touch", "go-to-market services", "view all", "load more", "show more", "learn more", "read more", "visit website", "visit site", "contact us", "about us", "about",
    "our team", "our portfolio", "our startups", "our mission", "see all", "see more", "privacy policy", "privacy", "privacy center", "terms of service", "cookie policy",
    "cookie settings", "portfolio", "subscribe", "sign up", "log in", "login", "sign in", "filter", "active", "exited", "fundraising", "founder services", "investments",
    "partners", "network", "ai apps", "cybersecurity", "healthcare", "data, ai & machine learning", "enterprise apps & vertical ai", "infrastructure & developer tools",
    "commerce & fintech", "energy & infrastructure", "ai infrastructure & developer platforms", "all companies", "all", "how we invest", "for investors", "for founders",
    "for lps", "for lp's", "trending topics", "disclosures", "content", "spotlight", "stage", "podcast", "careers", "events", "overview", "contact", "home", "resources", "news",
    "blog", "press", "insights", "featured", "enterprise", "commerce", "crypto", "robotics", "space", "hardware", "fintech", "loading...", "canada")

_PLAIN = "|".join(f"(?:{p})" for p in PATTERNS)
_FOLDED = "|".join([*(f"(?:{x.replace('(', chr(92) + '(').replace(')', chr(92) + ')')})" for x in ANYWHERE), *(f"(?:{p})" for p in CONTENT), f"^(?:{'|'.join(META)})", *(f"(?:{p})" for p in EITHER_CASE)])


def _long(pattern: str, longer: int, shorter: int) -> str:
    """A pattern that counts in texts of certain lengths, as one pattern with two looks ahead."""
    return f"^(?=.{{{longer + 1},{shorter - 1}}}$)(?=.*(?:{pattern}))"


#: All that a name is tested for by pattern, in two passes over it.
_AS_IS = "|".join([_PLAIN, *(_long(*x) for x in BY_LENGTH), _long(f"(?i){'|'.join(VERBS)}", 40, 99)])
_EITHER = f"(?i){_FOLDED}"
_JUNK = "|".join(_long("^" + ".*".join(f"\\Q{part}\\E" if part else "" for part in p.split("%")) + "$", a, b) for p, a, b in JUNK_LIKE)
_WHOLE = (*UI_WORDS, *SINGLE_WORDS, *GEOGRAPHY)
_GLUE = (*CATEGORY_TOKENS, "/", " ", "&")


def glued_of(text: Column, tokens: tuple[str, ...]) -> Column:
    """Whether a text falls into ``tokens`` without a rest.

    If no token begins another, a text falls apart in one way only, and a pattern that never goes back tells; else a fold
    over the text's letters keeps which beginnings fall apart.
    """
    if not any(a != b and b.startswith(a) for a in tokens for b in tokens):
        return F.coalesce(text.rlike(rf"^(?:{'|'.join(map(re.escape, tokens))})++\z"), F.lit(False))
    listed = F.array(*map(F.lit, tokens))

    def step(fits: Column, end: Column) -> Column:
        return F.array_append(fits, F.exists(listed, lambda t: F.coalesce(F.get(fits, end - F.char_length(t)), F.lit(False)) & (F.substring(text, end - F.char_length(t) + 1, F.char_length(t)) == t)))

    fold = F.aggregate(F.sequence(F.lit(1), F.char_length(text)), F.array(F.lit(True)), step)
    return F.when(F.char_length(text) > 0, F.element_at(fold, -1)).otherwise(False)


def tidy(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), INVISIBLE, "")


def is_company_name(c: Column) -> Column:
    """Whether a listed text is a company's name: no button, label, filter, number, status, place or sentence.

    All tests are flat patterns over the name; only names that begin with a category's word are taken apart.
    """
    name = tidy(c)
    n = F.char_length(name)
    bad = F.lower(name).isin(*_WHOLE) | name.rlike(_AS_IS) | name.rlike(_EITHER)
    sectors = F.size(F.filter(F.array(*map(F.lit, SECTORS)), lambda x: F.contains(name, x)))
    bad |= F.when(n > 20, sectors >= 3).otherwise(False)
    words = F.split(name, r"\s+")
    small = F.size(F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w.rlike(r"^\p{Ll}") | w.isin(*SMALL_WORDS)))
    bad |= F.when((n > 35) & (F.size(words) >= 5), small >= F.size(words) - 2).otherwise(False)
    base = F.trim(F.regexp_replace(name, r"\d{4}$", ""))
    bad |= F.when((F.char_length(base) > 3) & (n <= LONGEST) & name.rlike(f"^(?:{'|'.join(CATEGORY_TOKENS)})"), glued_of(base, _GLUE)).otherwise(False)
    return F.coalesce((F.char_length(F.trim(c)) >= 2) & n.between(1, LONGEST) & ~bad, F.lit(False))


def is_junk_row(c: Column) -> Column:
    """Whether a clean-up deletes a row of this name: by length, year, patterns, or the text of a button."""
    bad = c.rlike("^[12][0-9]{3}$") | (F.char_length(c) > LONGEST) | (F.char_length(F.trim(c)) <= 1) | F.lower(F.trim(c)).isin(*JUNK_NAMES, *JUNK_UI) | c.rlike(f"(?i){_JUNK}")
    return F.coalesce(bad, F.lit(False))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def judged_sql(rows: str) -> str:
    """SQL beginning ``with recursive``: ``judged`` has ``id``, ``name`` and ``valid`` of ``rows`` (``id``, ``name``)."""
    tests = [
        f"lower(n) in ({', '.join(map(_q, _WHOLE))})", f"regexp_matches(n, {_q(_PLAIN)})", f"regexp_matches(n, {_q('(?i)' + _FOLDED)})",
        *(f"length(n) > {a} and length(n) < {b} and regexp_matches(n, {_q(p)})" for p, a, b in BY_LENGTH),
        "length(n) > 40 and (" + " or ".join(f"contains(lower(n), {_q(v)})" for v in VERBS) + ")",
        "length(n) > 20 and " + " + ".join(f"contains(n, {_q(s)})::int" for s in SECTORS) + " >= 3",
        "length(n) > 35 and len(w) >= 5 and len(list_filter(w[2:], lambda x: regexp_matches(x, '^\\p{Ll}') or x in (" + ", ".join(map(_q, SMALL_WORDS)) + "))) >= len(w) - 2",
        "length(trim(regexp_replace(n, '\\d{4}$', ''))) > 3 and n in (select n from falls where rest = '')"]
    return f"""with recursive named as (select id, name, regexp_replace(trim(name), {_q(INVISIBLE)}, '', 'g') as n from ({rows})),
tokens as (select unnest([{', '.join(map(_q, _GLUE))}]) as t),
falls as (select distinct n, trim(regexp_replace(n, '\\d{{4}}$', '')) as rest from named union select n, substr(rest, length(t) + 1) from falls join tokens on starts_with(rest, t)),
split as (select *, regexp_split_to_array(n, '\\s+') as w from named),
judged as (select id, name, coalesce(length(trim(name)) >= 2 and length(n) between 1 and {LONGEST} and not (({') or ('.join(tests)})), false) as valid from split)
"""


def junk_sql(name: str) -> str:
    """SQL for ``is_junk_row``."""
    tests = [f"(length({name}) > {a} and length({name}) < {b} and {name} ilike {_q(p)})" for p, a, b in JUNK_LIKE]
    return f"(regexp_matches({name}, '^[12][0-9]{{3}}$') or length({name}) > {LONGEST} or length(trim({name})) <= 1 or lower(trim({name})) in ({', '.join(map(_q, (*JUNK_NAMES, *JUNK_UI)))}) or {' or '.join(tests)})"


#: Texts without signs of patterns, that stand for labels in listed names.
_MARKS = tuple(x.rstrip("$") for x in CONTENT if not set(x.rstrip("$")) & set("?([*."))
_STAGES = ("Pre-Seed", "Seed", "Series A", "Series B")
_CITIES = ("Austin", "Boston", "London, UK", "New York", "Toronto", "San Francisco, CA")


def listed_name(id_: Column, name: Column, sector: Column) -> Column:
    """Names as pages list them, by a row's id: companies, and texts of sixteen other kinds."""
    pick = lambda listed, by=1: F.element_at(F.array(*map(F.lit, listed)), (F.floor(id_ / by) % len(listed) + 1).cast("int"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    t = lambda by: pick(CATEGORY_TOKENS, by)
    forms = (
        text(t(1), t(7)), text(t(1), t(7), t(11), (F.lit(2000) + id_ % 25).cast("string")), text(t(1), "ology Labs"), F.initcap(pick(UI_WORDS, 3)), text(name, " ", pick(ANYWHERE, 3)),
        text(name, pick(_MARKS, 3)), F.upper(pick((*SINGLE_WORDS, *GEOGRAPHY), 3)), text(pick(_CITIES, 3), " ", sector), text("Sector", name), text(pick(_STAGES, 3), pick(_STAGES, 5)),
        text("The ", F.lower(sector), " of things"), text(name, " is a platform that provides ", sector, " to all"), text(name, "."), text(t(1), " & ", t(7), t(13), t(17)), text(name, " Series B"), text("AI", F.lower(t(3))))
    out = name
    for i, form in enumerate(forms):
        out = F.when(id_ % 20 == i, form).otherwise(out)
    return out


def listed(portfolio: DataFrame) -> DataFrame:
    """``id``, ``company_name`` and ``name`` as listed, written, so that a name is made once and not in each test of it."""
    return written(portfolio.select("id", "company_name", listed_name(F.col("id"), F.col("company_name"), F.col("sector")).alias("name")), "listed")


def listed_sql(table: str = "portfolio") -> str:
    """The same names as SQL over a table with ``id``, ``company_name`` and ``sector``."""
    pick = lambda listed, by=1: f"([{', '.join(map(_q, listed))}])[id // {by} % {len(listed)} + 1]"
    t = lambda by: pick(CATEGORY_TOKENS, by)
    words = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    forms = (
        f"{t(1)} || {t(7)}", f"{t(1)} || {t(7)} || {t(11)} || (2000 + id % 25)", f"{t(1)} || 'ology Labs'", words(pick(UI_WORDS, 3)), f"company_name || ' ' || {pick(ANYWHERE, 3)}",
        f"company_name || {pick(_MARKS, 3)}", f"upper({pick((*SINGLE_WORDS, *GEOGRAPHY), 3)})", f"{pick(_CITIES, 3)} || ' ' || sector", "'Sector' || company_name", f"{pick(_STAGES, 3)} || {pick(_STAGES, 5)}",
        "'The ' || lower(sector) || ' of things'", "company_name || ' is a platform that provides ' || sector || ' to all'", "company_name || '.'", f"{t(1)} || ' & ' || {t(7)} || {t(13)} || {t(17)}", "company_name || ' Series B'", f"'AI' || lower({t(3)})")
    return "select id, company_name, case id % 20 " + " ".join(f"when {i} then {form}" for i, form in enumerate(forms)) + f" else company_name end as name from {table}"
