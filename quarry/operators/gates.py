"""Rules applied to every row, and the gates that accept or reject candidates with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import portfolio as P
from quarry.functions import rules as R
from quarry.functions.measures import count
from quarry.functions.words import at, bares, let, phrase, words_of
from quarry.operators.linking import fuzzy_name_join
from quarry.plans.registry import query
from quarry.sources.staging import written
from quarry.sources.tables import AS_OF, NORM, Tables, norm_name


def _any_sql(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _first_sql(c: str, table: dict, other: str) -> str:
    return "case " + " ".join(f"when {_any_sql(c, words)} then '{name}'" for name, words in table.items()) + f" else {other} end"


_BANDS = "case when amount_usd is null then 'Unknown' " + " ".join(f"when amount_usd < {b:.0f} then '{s}'" for b, s in R.STAGE_BELOW) + " else 'Series C+' end"
_LEVEL = "case {0} " + " ".join(f"when '{s}' then {n}" for s, n in R.STAGE_LEVEL.items()) + " else -1 end"
_NUMBER = r"try_cast(nullif(regexp_extract(replace(title, ',', ''), '(?i){0}(\d[\d.]*)\s*(?:{1})', 1), '') as double) * {2}"
_AMOUNT = "coalesce(" + ", ".join(_NUMBER.format(sign, unit, scale) for sign in (r"\$\s*", "") for unit, scale in (("B|billion", "1e9"), ("M|million|mm", "1e6"), ("K|thousand", "1e3"))) + ")"


@query("norm_name", f"select id, {NORM.format('company_name')} as norm from deals")
def norm_names(t: Tables) -> DataFrame:
    return t.deals.select("id", norm_name("company_name").alias("norm"))


@query("norm_name_sql5", "select id, replace(replace(replace(replace(replace(lower(company_name), ' ', ''), '.', ''), ',', ''), '-', ''), '''', '') as norm from portfolio")
def norm_name_sql5(t: Tables) -> DataFrame:
    return t.portfolio.select("id", F.translate(F.lower("company_name"), " .,-'", "").alias("norm"))


@query("normalize_stage", f"select id, {_first_sql('lower(title)', R.STAGE_LABELS, chr(39) + 'Unknown' + chr(39))} as stage from articles")
def normalize_stage(t: Tables) -> DataFrame:
    return t.articles.select("id", R.normalize_stage(F.col("title")).alias("stage"))


@query("stage_from_amount", f"select id, {_BANDS} as stage from deals")
def stage_from_amount(t: Tables) -> DataFrame:
    return t.deals.select("id", R.stage_from_amount(F.col("amount_usd")).alias("stage"))


@query("restage_from_amount", f"select id, case when stage = 'Unknown' and amount_usd is not null then {_BANDS} else stage end as stage from deals")
def restage_from_amount(t: Tables) -> DataFrame:
    fixed = F.when((F.col("stage") == "Unknown") & F.col("amount_usd").isNotNull(), R.stage_from_amount(F.col("amount_usd"))).otherwise(F.col("stage"))
    return t.deals.select("id", fixed.alias("stage"))


@query("parse_amount", f"select id, {_AMOUNT} as amount from articles")
def parse_amount(t: Tables) -> DataFrame:
    return t.articles.select("id", R.parse_amount(F.col("title")).alias("amount"))


@query("amount_title_first", f"select id, case when {_AMOUNT} <= 1e10 then {_AMOUNT} end as amount from articles")
def amount_title_first(t: Tables) -> DataFrame:
    found = F.coalesce(R.parse_amount(F.substring_index("title", ". Based", 1)), R.parse_amount(F.substring("title", 1, 500)))
    return t.articles.select("id", F.when(found <= R.GLOBAL_CAP, found).alias("amount"))


_SCORES = ", ".join("(" + " + ".join(f"contains(text, '{w.replace(chr(39), chr(39) * 2)}')::int" for w in words) + f") as s{i}" for i, words in enumerate(R.SECTOR_WORDS.values()))
_PICK = "case when greatest({0}) = 0 then null ".format(", ".join(f"s{i}" for i in range(len(R.SECTOR_WORDS)))) + " ".join(
    f"when s{i} = greatest({', '.join(f's{j}' for j in range(len(R.SECTOR_WORDS)))}) then '{name}'" for i, name in enumerate(R.SECTOR_WORDS)) + " end"


@query("classify_sector", f"select doc_id as id, {_PICK} as sector from (select doc_id, {_SCORES} from (select doc_id, lower(text) as text from documents))")
def classify_sector(t: Tables) -> DataFrame:
    return t.raw("documents").select(F.col("doc_id").alias("id"), R.classify_sector(F.col("text")).alias("sector"))


@query("detect_city", f"select id, {_first_sql('lower(title)', R.CITY_WORDS, 'null')} as city from articles")
def detect_city(t: Tables) -> DataFrame:
    return t.articles.select("id", R.first_of(F.col("title"), R.CITY_WORDS, None).alias("city"))


@query("funding_related", f"select doc_id, source from documents where {_any_sql('lower(text)', R.FUNDING_WORDS)}")
def funding_related(t: Tables) -> DataFrame:
    return t.raw("documents").where(R.contains_any(F.lower("text"), R.FUNDING_WORDS)).select("doc_id", "source")


_CAP = "case stage " + " ".join(f"when '{s}' then {c:.0f}" for s, c in R.STAGE_CAP.items()) + f" else {R.OTHER_CAP:.0f} end"


@query("valid_amount", f"select id, coalesce(amount_usd > 0 and amount_usd <= 1e10 and amount_usd <= {_CAP}, true) as valid from deals")
def valid_amount(t: Tables) -> DataFrame:
    return t.deals.select("id", R.valid_amount(F.col("amount_usd"), F.col("stage")).alias("valid"))


@query("full_date", "select id, case id % 4 when 0 then strftime(date_announced, '%Y-%m-%d') when 1 then strftime(date_announced, '%Y-%m') || '-01' end as day from deals")
def full_date(t: Tables) -> DataFrame:
    """Dates written in four ways: whole, without a day, as text, missing."""
    k = F.col("id") % 4
    said = F.when(k == 0, F.date_format("date_announced", "yyyy-MM-dd")).when(k == 1, F.date_format("date_announced", "yyyy-MM")).when(k == 2, F.lit("last week"))
    return t.deals.select("id", R.full_date(said).alias("day"))


@query("pub_date", "select id, case when id % 5 < 4 then date_announced end as day from deals where date_announced is not null")
def pub_date(t: Tables) -> DataFrame:
    """Days read back from feed dates with weekday, time and zone by name or number, in ISO form or as a day; else null."""
    k = F.col("id") % 5
    forms = ("'Mon,' dd MMM yyyy '08:00:00 GMT'", "'Tue,' dd MMM yyyy '08:00:00 +0000'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "'on 'dd/MM")
    said = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        said = F.when(k == i, F.date_format("date_announced", form)).otherwise(said)
    return t.deals.where("date_announced is not null").select("id", R.pub_date(said).alias("day"))


@query("date_guard", f"select id, case when d <= date '{AS_OF}' + 365 and year(d) >= 2000 then d end as day from (select id, case id % 5 when 0 then date_announced + 1000 else date_announced end as d from deals)")
def date_guard(t: Tables) -> DataFrame:
    said = F.when(F.col("id") % 5 == 0, F.date_add("date_announced", 1000)).otherwise(F.col("date_announced"))
    return t.deals.select("id", R.date_guard(said.cast("string"), F.lit(AS_OF)).alias("day"))


_TRUST = "case source_type " + " ".join(f"when '{s}' then {v}" for s, v in R.SOURCE_TRUST.items()) + f" else {R.OTHER_TRUST} end"


@query("confidence", f"""
select id, greatest(0.1, least(1.0, round({_TRUST}::double + case when amount_usd <> 0 then 0.05 else -0.1 end::double + case when stage <> 'Unknown' then 0.05 else -0.05 end::double
  + case when date_announced is not null then 0.02 else 0 end::double + case when length(company_description) > 20 then 0.03 else 0 end::double
  + case when city = 'New York' then 0.05 else 0 end::double + case when source_url is null then -0.1 else 0 end::double
  + case when raw_text is null then -0.05 else 0 end::double, 2)))::double as confidence from deals""")
def confidence(t: Tables) -> DataFrame:
    c = F.col
    score = R.confidence(c("source_type"), c("amount_usd"), c("stage"), c("date_announced"), c("company_description"), c("city") == "New York", c("source_url"), c("raw_text"))
    return t.deals.select("id", score.alias("confidence"))


@query("clean_company_name", "select id, company_name as name from deals")
def clean_company_name(t: Tables) -> DataFrame:
    """Names with a legal ending, a headline's rest or a former name, all cleaned to the name."""
    said = F.concat("company_name", F.when(F.col("id") % 3 == 0, ", Inc.").when(F.col("id") % 3 == 1, " - Raises $5M").otherwise(" (formerly Oldco)"))
    return t.deals.select("id", R.clean_company_name(said).alias("name"))


#: Beginnings of headlines without signs of patterns, that stand in rendered names.
_HEADS = tuple(x for x in R.TOPIC_HEADS if "\\" not in x)
_NAMED = f"""case id % 8 when 0 then 'Why ' || company_name when 1 then company_name || ' announced' when 2 then ([{', '.join(f"'{x}'" for x in _HEADS)}])[id // 8 % {len(_HEADS)} + 1] || '-' || ([{', '.join(f"'{x}'" for x in R.TOPIC_TAILS)}])[id // 3 % {len(R.TOPIC_TAILS)} + 1]
  when 3 then 'Exclusive: ' || company_name when 4 then company_name || ' Startup' when 5 then 'the maker of small ' || company_name when 6 then ([{', '.join(f"'{x}'" for x in _HEADS)}])[id // 8 % {len(_HEADS)} + 1] || ' ' || company_name else company_name end"""


def valid_sql(rows: str) -> str:
    """``id``, ``name``, ``valid`` of rows with ``id`` and ``name``."""
    return f"""
select id, name, not (length(name) > {R.LONGEST_NAME} or regexp_matches(name, '{R.TOPIC_NAME}') or regexp_matches(lower(name), '\\b({"|".join(R.SAID)}|laid off|startup)\\b')
  or {_any_sql('lower(name)', R.HEADINGS + R.QUESTIONS)} or regexp_matches(lower(name), '^(a|an) ')
  or len(w) > 3 and len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Ll}}'))) > len(w) * 0.6) as valid
from (select id, name, regexp_split_to_array(name, '\\s+') as w from ({rows}))"""


_VALID = valid_sql(f"select id, {_NAMED} as name from deals")


def named(deals: DataFrame) -> DataFrame:
    """Deals under names of eight kinds: headlines, sentences, topics that stand for a company, and companies."""
    pick = lambda listed, by: F.element_at(F.array(*map(F.lit, listed)), (F.floor(F.col("id") / by) % len(listed) + 1).cast("int"))
    k, own = F.col("id") % 8, F.col("company_name")
    name = (
        F.when(k == 0, F.concat(F.lit("Why "), own)).when(k == 1, F.concat(own, F.lit(" announced"))).when(k == 2, F.concat(pick(_HEADS, 8), F.lit("-"), pick(R.TOPIC_TAILS, 3))).when(k == 3, F.concat(F.lit("Exclusive: "), own))
        .when(k == 4, F.concat(own, F.lit(" Startup"))).when(k == 5, F.concat(F.lit("the maker of small "), own)).when(k == 6, F.concat(pick(_HEADS, 8), F.lit(" "), own)).otherwise(own))
    return deals.withColumn("company_name", name)


@query("valid_company_name", _VALID)
def valid_company_name(t: Tables) -> DataFrame:
    """The rule over names of eight kinds."""
    return named(t.deals).select("id", F.col("company_name").alias("name")).withColumn("valid", R.valid_company_name(F.col("name")))


@query("pattern_of", f"""
select reason, case reason when 'error' then lower(company_name) when 'view' then 'len>' || length(company_name) else substr({NORM.format('company_name')}, 1, 20) end as pattern, count(*) as hits
from rejections group by 1, 2""")
def pattern_of(t: Tables) -> DataFrame:
    kind = F.when(F.col("reason") == "error", "bad_name_headline").when(F.col("reason") == "view", "bad_name_too_long").otherwise(F.col("reason"))
    rows = t.rejections.select("reason", R.pattern_of(F.col("company_name"), kind).alias("pattern"))
    return rows.groupBy("reason", "pattern").agg(count().alias("hits"))


#: Reasons of the gate that the table's reasons stand for.
_REASONS = {"error": "bad_name_headline", "view": "bad_name_too_long", "purchase": "vc_firm", "signup": "bad_name_pattern"}
_REASON_SQL = "case reason " + " ".join(f"when '{k}' then '{v}'" for k, v in _REASONS.items()) + " else reason end"
_PATTERN_SQL = f"""case when coalesce(company_name, '') = '' then null when {_REASON_SQL} = 'bad_name_headline' and len(regexp_extract_all(company_name, '\\S+')) >= 2
  then lower(array_to_string(regexp_extract_all(company_name, '\\S+')[1:2], ' ')) when {_REASON_SQL} = 'bad_name_too_long' then 'len>' || length(company_name)
  when {_REASON_SQL} = 'vc_firm' then {NORM.format('company_name')} else substr({NORM.format('company_name')}, 1, 20) end"""
#: Reasons of which learned patterns reject what comes later.
TEACHING = ("bad_name_headline", "bad_name_pattern", "vc_firm")


def add_hits(old: DataFrame | None, rejections: DataFrame) -> DataFrame:
    """``reason``, ``pattern``, ``hits``, ``last_seen``: what rejections (``company_name``, ``reason``, ``created_at``) teach, added to ``old``.

    A headline teaches its first two words, a long name its length, a firm its normalized name, others the first twenty
    letters of that; nameless rejections teach nothing.
    """
    rows = rejections.withColumn("pattern", R.pattern_of(F.col("company_name"), F.col("reason"))).where("pattern is not null and pattern <> ''")
    rows = rows.groupBy("reason", "pattern").agg(count().alias("hits"), F.max("created_at").alias("last_seen"))
    if old is None:
        return rows
    return old.select(*rows.columns).unionByName(rows).groupBy("reason", "pattern").agg(F.sum("hits").alias("hits"), F.max("last_seen").alias("last_seen"))


@query("learn_patterns", f"""
select reason, pattern, count(*) as hits, max(created_at) as last_seen, count(*) >= 5 as auto_reject from (
  select {_REASON_SQL} as reason, {_PATTERN_SQL} as pattern, created_at from rejections) where pattern <> '' group by 1, 2""")
def learn_patterns(t: Tables, min_hits: int = 5) -> DataFrame:
    reason = F.col("reason")
    for k, v in _REASONS.items():
        reason = F.when(F.col("reason") == k, v).otherwise(reason)
    return add_hits(None, t.rejections.withColumn("reason", reason)).withColumn("auto_reject", F.col("hits") >= min_hits)


def taught(patterns: DataFrame) -> DataFrame:
    """``p`` of the patterns that reject: a name is rejected if the first twenty letters of its normalized form are one."""
    return patterns.where(F.col("auto_reject") & F.col("reason").isin(*TEACHING)).select(F.col("pattern").alias("p")).distinct()


def known_firms(candidates: DataFrame, firms: DataFrame) -> DataFrame:
    """``id`` of candidates that are investment firms: equal names, or one in the other at 0.7 and five letters."""
    left = candidates.select(F.col("id").alias("l"), norm_name("company_name").alias("left_name")).where(F.char_length("left_name") >= 3)
    right = firms.select(F.col("id").alias("r"), norm_name("name").alias("right_name"))
    exact = left.join(right.select(F.col("right_name").alias("left_name")).distinct(), "left_name", "left_semi").select("l")
    fuzzy = fuzzy_name_join(left, right.where(F.char_length("right_name") >= 5), 0.7).select("l")
    return exact.unionByName(fuzzy).distinct().withColumnRenamed("l", "id")


def duplicates_of(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """``id`` of candidates that repeat a round in ``existing``: same name, or a fuzzy one where no same name exists."""
    new = candidates.select(F.col("id").alias("l"), norm_name("company_name").alias("left_name"), F.col("stage").alias("s"), F.col("amount_usd").alias("a"), F.col("date_announced").alias("d"))
    old = existing.select(F.col("id").alias("r"), F.col("company_name_normalized").alias("right_name"), F.col("stage").alias("s2"), F.col("amount_usd").alias("a2"), F.col("date_announced").alias("d2"))
    new = new.where("left_name <> ''")
    exact = new.join(old, new.left_name == old.right_name).drop("left_name", "right_name")
    rest = new.join(old.select(F.col("right_name").alias("left_name")).distinct(), "left_name", "left_anti").where(F.char_length("left_name") >= 4)
    names = fuzzy_name_join(rest.select("l", "left_name"), old.select("right_name").distinct().withColumn("r", F.lit(0)), 0.85).select("l", "right_name")
    fuzzy = rest.drop("left_name").join(names.hint("merge"), "l").join(old.hint("merge"), "right_name").drop("right_name")
    similar, close = R.amounts_similar(F.col("a"), F.col("a2")), R.dates_close(F.col("d"), F.col("d2"))
    pairs = exact.unionByName(fuzzy)
    return pairs.where(R.is_duplicate(F.col("s"), F.col("s2"), similar, close)).select(F.col("l").alias("id")).distinct()


_SIM = "case when a.amount_usd <> 0 and b.amount_usd <> 0 then greatest(a.amount_usd, b.amount_usd) / greatest(least(a.amount_usd, b.amount_usd), 1) <= 2 end"
_CLOSE = "abs(datediff('day', a.date_announced, b.date_announced)) <= 180"
_FITS = "(a.stage = b.stage or a.stage = 'Unknown' or b.stage = 'Unknown')"


@query("duplicate_of_existing", f"""
select distinct a.id from deals a join deals b on a.company_name_normalized = b.company_name_normalized
where a.id % 10 = 3 and b.id % 10 <> 3 and ((({_SIM}) is true and ({_CLOSE}) is not false) or (({_CLOSE}) is true and ({_SIM}) is null and {_FITS})
  or ({_FITS} and ({_CLOSE}) is not false and ({_SIM}) is not false))""")
def duplicate_of_existing(t: Tables) -> DataFrame:
    """A tenth of the deals stands for a new batch, held against the rest."""
    return duplicates_of(t.deals.where("id % 10 = 3"), t.deals.where("id % 10 <> 3"))


def deal_gate(candidates: DataFrame, firms: DataFrame, existing: DataFrame, patterns: DataFrame) -> DataFrame:
    """``candidates`` cleaned and scored, with the first ``reason`` against each; null for those accepted.

    Stateless rules come first and their rows are written, so that nothing is worked out twice; only names that pass
    them meet patterns, firms and stored deals, in equi joins.
    """
    c = F.col
    plain = F.when(c("stage").isin(*R.STAGE_LEVEL, "Unknown"), c("stage")).otherwise(R.normalize_stage(c("stage")))
    rows = candidates.withColumns({"company_name": R.clean_company_name(F.trim("company_name")), "stage": plain})
    rows = rows.withColumn("stage", F.when((c("stage") == "Unknown") & (c("amount_usd") != 0), R.stage_from_amount(c("amount_usd"))).otherwise(c("stage")))
    rows = rows.withColumns({
        "amount_usd": F.when(R.valid_amount(c("amount_usd"), c("stage")), c("amount_usd")),
        "date_announced": R.date_guard(c("date_announced").cast("string"), F.lit(AS_OF)), "company_name_normalized": norm_name("company_name")})
    rows = written(rows, "gate")
    reason = (
        F.when(F.coalesce(F.char_length(F.trim("company_name")), F.lit(0)) < 2, "empty_name").when(F.char_length("company_name") > R.LONGEST_NAME, "name_too_long")
        .when(~R.valid_company_name(c("company_name")), "bad_name").when(R.bad_name(c("company_name")), "bad_name_pattern"))
    rows = written(rows.withColumn("reason", reason), "gate")
    fine = rows.where("reason is null")
    hits = fine.withColumn("p", F.substring("company_name_normalized", 1, 20)).join(taught(patterns).hint("merge"), "p", "left_semi").select("id", F.lit("auto_reject").alias("why"), F.lit(1).alias("n"))
    firms_hit = known_firms(fine, firms).select("id", F.lit("vc_firm").alias("why"), F.lit(2).alias("n"))
    again = duplicates_of(fine, existing).select("id", F.lit("duplicate").alias("why"), F.lit(3).alias("n"))
    later = hits.unionByName(firms_hit).unionByName(again).groupBy("id").agg(F.min_by("why", "n").alias("why"))
    score = R.confidence(c("source_type"), c("amount_usd"), c("stage"), c("date_announced"), c("company_description"), c("city") == "New York", c("source_url"), c("raw_text"))
    out = rows.join(later.hint("merge"), "id", "left").withColumn("reason", F.coalesce("reason", "why")).drop("why")
    return out.withColumn("confidence_score", F.when(c("reason").isNull(), score))


def _candidates(t: Tables) -> DataFrame:
    """A tenth of the deals as they might arrive: headline names, names of firms, single letters, names stored before."""
    k = F.floor(F.col("id") / 10) % 8
    odd = F.when(k == 0, F.concat(F.lit("Exclusive: "), "company_name")).when(k == 1, F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 90).cast("string"), 9, "0"))).when(k == 2, "x").when(k == 3, F.col("company_name")).when(k == 4, F.concat(F.lit("This "), "company_name"))
    return t.deals.where("id % 10 = 3").withColumn("company_name", F.coalesce(odd, F.concat(F.lit("Cand "), "company_name"), "company_name"))


_GATE = f"""
with c as (
  select id, case (id // 10) % 8 when 0 then 'Exclusive: ' || company_name when 1 then 'Supplier#' || lpad(cast(id % 90 as varchar), 9, '0') when 2 then 'x' when 3 then company_name
    when 4 then 'This ' || company_name else 'Cand ' || company_name end as name, case when stage = 'Unknown' and amount_usd <> 0 then {_BANDS} else stage end as stage, amount_usd, date_announced
  from deals where id % 10 = 3),
a as (
  select id, name, {NORM.format('name')} as norm, stage, case when coalesce(amount_usd > 0 and amount_usd <= 1e10 and amount_usd <= {_CAP}, true) then amount_usd end as amount_usd,
    case when year(date_announced) >= 2000 and date_announced <= date '{AS_OF}' + 365 then date_announced end as date_announced from c),
taught as (select p from (select {_REASON_SQL} as reason, {_PATTERN_SQL} as p from rejections) where reason in ('bad_name_headline', 'bad_name_pattern', 'vc_firm') group by reason, p having count(*) >= 5)
select id, name as company_name, case when length(name) < 2 then 'empty_name' when length(name) > 45 then 'name_too_long' when contains(lower(name), 'exclusive:') then 'bad_name'
  when starts_with(lower(name), 'this ') then 'bad_name_pattern' when substr(norm, 1, 20) in (select p from taught) then 'auto_reject'
  when norm in (select {NORM.format('name')} from firms) then 'vc_firm'
  when exists (select 1 from deals b where b.id % 10 <> 3 and b.company_name_normalized = a.norm and ((({_SIM}) is true and ({_CLOSE}) is not false)
    or (({_CLOSE}) is true and ({_SIM}) is null and {_FITS}) or ({_FITS} and ({_CLOSE}) is not false and ({_SIM}) is not false))) then 'duplicate' else 'accepted' end as outcome
from a"""


@query("validate_deal", _GATE)
def validate_deal(t: Tables) -> DataFrame:
    rows = deal_gate(_candidates(t), t.firms, t.deals.where("id % 10 <> 3"), learn_patterns(t))
    return rows.select("id", F.coalesce("reason", F.lit("accepted")).alias("outcome"), "company_name")


@query("gate_outcomes", f"select outcome, source_type, count(*) as candidates from ({_GATE}) v join deals d on d.id = v.id group by 1, 2")
def gate_outcomes(t: Tables) -> DataFrame:
    """Candidates by outcome and source."""
    rows = deal_gate(_candidates(t), t.firms, t.deals.where("id % 10 <> 3"), learn_patterns(t))
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome"), "source_type").agg(count().alias("candidates"))


def valid_portfolio_name(c: Column) -> Column:
    """Whether a listed text is a company's name."""
    return P.is_company_name(c)


def _listed(t: Tables) -> DataFrame:
    return P.listed(t.portfolio)


@query("validate_portfolio", P.judged_sql(P.listed_sql()) + """
select id, case when length(trim(name)) < 2 then 'empty_name' when length(trim(name)) > 60 then 'name_too_long' when valid then 'accepted' else 'junk_pattern' end as outcome,
  case when valid then trim(regexp_replace(regexp_replace(trim(name), '(?i)Exits?(true|false)$', ''), '\\((Acquired|Exited)\\)', '', 'g')) end as company_name from judged""")
def validate_portfolio(t: Tables) -> DataFrame:
    name = F.trim("name")
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)Exits?(true|false)$", ""), r"\((Acquired|Exited)\)", ""))
    reason = (
        F.when(F.coalesce(F.char_length(name), F.lit(0)) < 2, "empty_name").when(F.char_length(name) > P.LONGEST, "name_too_long")
        .when(~F.col("valid"), "junk_pattern").when(F.char_length(clean) < 2, "empty_name"))
    # columns of their own, so that a name is judged once and not wherever its outcome is asked for
    rows = _listed(t).withColumn("valid", valid_portfolio_name(name)).withColumn("reason", reason).withColumn("clean", clean)
    return rows.select("id", F.coalesce("reason", F.lit("accepted")).alias("outcome"), F.when(F.col("reason").isNull(), F.col("clean")).alias("company_name"))


@query("junk_portfolio_rows", f"select id, name from ({P.listed_sql()}) where {P.junk_sql('name')}")
def junk_portfolio_rows(t: Tables) -> DataFrame:
    """Rows that the clean-up of portfolios deletes."""
    return _listed(t).where(P.is_junk_row(F.col("name"))).select("id", "name")


def bad_firm_name(c: Column) -> Column:
    """Names that begin like a sentence, credit a maker or end in a source."""

    def told(low: Column) -> Column:
        opens = (F.size(low) > 1) & at(low, 1).isin("and", "the", "a", "an")
        return opens | phrase(low, ("powered", "designed", "built", "made"), ("by",)).isNotNull() | at(low, -1).isin("source", "via", "from")

    return F.coalesce(let(F.filter(bares(words_of(c)), lambda w: w != ""), told), F.lit(False))


@query("validate_firm", """
select s_suppkey as id, case when s_suppkey % 5 = 0 then 'bad_name_pattern' when s_suppkey % 5 = 1 then 'accepted' else 'duplicate_firm' end as outcome,
  case when s_suppkey % 5 = 1 and s_suppkey % 4 not in (0, 1) then 'https://firm' || s_suppkey || '.example.com' end as website from supplier""")
def validate_firm(t: Tables) -> DataFrame:
    """Firms as candidates: names that begin with an article, new names, and known names; urls without a scheme are dropped."""
    k = F.col("id") % 5
    rows = t.firms.withColumn("name", F.when(k == 0, F.concat(F.lit("The "), "name")).when(k == 1, F.concat(F.lit("Fresh "), "name")).otherwise(F.col("name")))
    rows = rows.withColumn("website", F.when(F.col("id") % 4 == 1, F.replace("website", F.lit("https://"), F.lit(""))).otherwise(F.col("website")))
    bad = bad_firm_name(F.col("name"))
    known = t.firms.select(norm_name("name").alias("k"), F.lit(True).alias("known")).distinct()
    rows = rows.withColumn("k", norm_name("name")).join(known, "k", "left")
    outcome = F.when(bad, "bad_name_pattern").when(F.col("known"), "duplicate_firm").otherwise("accepted")
    site = F.when((outcome == "accepted") & F.col("website").rlike(r"^https?://\S+$"), F.col("website"))
    return rows.select("id", outcome.alias("outcome"), site.alias("website"))


@query("reject_known_firms", f"select id from (select id, case when id % 50 = 0 then 'Supplier#' || lpad(cast(id % 90 as varchar), 9, '0') else company_name end as n from deals) where {NORM.format('n')} in (select {NORM.format('name')} from firms)")
def reject_known_firms(t: Tables) -> DataFrame:
    named = F.when(F.col("id") % 50 == 0, F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 90).cast("string"), 9, "0"))).otherwise(F.col("company_name"))
    return t.deals.withColumn("k", norm_name(named)).join(t.firms.select(norm_name("name").alias("k")).distinct(), "k", "left_semi").select("id")


# Endings of entities that are no startups, words of such names, and beginnings that are addresses.
FILING_SUFFIXES = ("REIT", "DST", "SPV", "PLC(?:/ADR)?", "/ADR", "SCSp", "SARL", "SCA", r"EB[\s-]?5")
FILING_WORDS = (
    r"\bFund\b", r"\bFeeder\b", r"\bHoldings?\b", r"\bPartners(?:hip)?\b", r"\bAssociates?\b", r"\bInvestors?\b", r"\bRealty\b", r"\bEstate\b", r"\bVentures\s+Fund\b",
    r"\bCapital\s+Fund\b", r"\bCapital\s+Partners\b", r"\bCapital\s+Management\b", r"\bAcquisition\s+Corp\b", r"\bMaster\s+Fund\b", r"\bInvestment\b", r"\bPooled\b",
    r"\bInsurance\b", r"\bAnnuity\b", r"\bDiocese\b", r"\bTrust\b", r"\bSeries\s+[A-Z0-9IVX]+\b", r"\bOffshore\b", r"\bOnshore\b", r"\bCo-Invest\b", r"\bSidecar\b",
    r"\bLP\s*-\s*Series\b", r"\bIDF\b", r"\bAsset\s+Backed\b", r"\bCredit\s+Co\b", r"\bConglomerate\b", r"\bBDC\b", r"\bCorp(?:oration)?\b.*\b(?:Acquisition|Blank\s+Check|SPAC)\b")
FILING_ADDRESS = r"^\d+[-\d]*\s+\w"
#: A filing name that is no company's, as one pattern.
FILING_JUNK = rf"(?i)(?:{FILING_ADDRESS})|(?:^|\s)(?:{'|'.join(FILING_SUFFIXES)})(?:\s|$|[.,])|{'|'.join(FILING_WORDS)}|[/ ]ADR$"


_FILED_CAP = f"case {_BANDS} " + " ".join(f"when '{s}' then {v}" for s, v in R.STAGE_CAP.items()) + f" else {R.OTHER_CAP} end"


@query("filing_gate", f"""
with filed as (select id, city, case when id % 10 = 7 then 'Supplier#' || lpad(cast(id % 200 as varchar), 9, '0') else company_name end as name, case when id % 9 = 4 then amount_usd * 100000 else amount_usd end as amount_usd
  from deals where source_type in ('sec_filing', 'de_filing') and id % 3 <> 0)
select id, name from filed where (amount_usd is null or amount_usd > 0 and amount_usd <= {R.GLOBAL_CAP} and amount_usd <= {_FILED_CAP})
  and (amount_usd is not null or city is not null) and lower(name) not in (select lower(name) from firms)""")
def filing_gate(t: Tables) -> DataFrame:
    """Filers that are companies: CIK tags off, fund vehicles, impossible amounts, filings without data and known firms out."""
    k, filed = F.col("id") % 3, t.deals.where("source_type in ('sec_filing', 'de_filing')")
    own = F.when(F.col("id") % 10 == 7, F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 200).cast("string"), 9, "0"))).otherwise(F.col("company_name"))
    said = F.concat(own, F.when(k == 0, " Fund").when(k == 1, F.concat(F.lit(" (CIK 000"), F.col("id").cast("string"), F.lit(")"))).otherwise(""))
    amount = F.when(F.col("id") % 9 == 4, F.col("amount_usd") * 100000).otherwise(F.col("amount_usd"))
    return gate_filings(filed.select("id", said.alias("name"), amount.alias("amount_usd"), "city"), t.firms)


def gate_filings(filings: DataFrame, firms: DataFrame) -> DataFrame:
    """``id`` and tidy ``name`` of the filings (``id``, ``name``, ``amount_usd``, ``city``) that a company can have made."""
    clean = F.trim(F.regexp_replace("name", r"(?i)\s*\(CIK\s+\d+\)", ""))
    amount = F.col("amount_usd")
    rows = filings.withColumn("name", clean).where(~F.col("name").rlike(FILING_JUNK) & (amount.isNotNull() | F.col("city").isNotNull()))
    rows = rows.where(R.valid_amount(amount, R.stage_from_amount(amount))).withColumn("low", F.lower("name"))
    return rows.join(firms.select(F.lower("name").alias("low")), "low", "left_anti").select("id", "name")


@query("three_valued_match", f"""
select a.id as a, b.id as b, ({_SIM}) as similar, ({_CLOSE}) as close from deals a join deals b on a.company_name_normalized = b.company_name_normalized and a.id < b.id""")
def three_valued_match(t: Tables) -> DataFrame:
    cols = ("company_name_normalized", "amount_usd", "date_announced")
    a = t.deals.select(F.col("id").alias("a"), *[F.col(c).alias(f"x_{c}") for c in cols])
    b = t.deals.select(F.col("id").alias("b"), *[F.col(c).alias(f"y_{c}") for c in cols])
    pairs = a.join(b, F.col("x_company_name_normalized") == F.col("y_company_name_normalized")).where("a < b")
    return pairs.select("a", "b", R.amounts_similar(F.col("x_amount_usd"), F.col("y_amount_usd")).alias("similar"), R.dates_close(F.col("x_date_announced"), F.col("y_date_announced")).alias("close"))


@query("is_firm_name", """
select id, id % 3 = 0 or id % 3 = 2 as firm from investors""")
def is_firm_name(t: Tables) -> DataFrame:
    name = F.when(F.col("id") % 3 == 0, F.concat_ws(" ", F.initcap("name"), F.lit("Capital"))).when(F.col("id") % 3 == 1, F.lit("Jane Doe")).otherwise(F.lit("Intel"))
    return t.investors.select("id", R.is_firm_name(name).alias("firm"))


@query("site_of_url", "select id, 'https://' || regexp_extract(source_url, '^https?://([^/]+)', 1) as site, regexp_extract(source_url, '^https?://(?:www\\.)?([^/]+)', 1) as domain from deals where source_url is not null")
def site_of_url(t: Tables) -> DataFrame:
    host = F.try_parse_url("source_url", F.lit("HOST"))
    return t.deals.where("source_url is not null").select("id", F.concat(F.lit("https://"), host).alias("site"), F.regexp_replace(host, r"^www\.", "").alias("domain"))


@query("domain_slug", f"select id, {NORM.format('name')} || tld as domain from firms, (select unnest(['.com', '.ai', '.io', '.co']) as tld) where length({NORM.format('name')}) between 2 and 40")
def domain_slug(t: Tables) -> DataFrame:
    slug = norm_name("name")
    rows = t.firms.where(F.char_length(slug).between(2, 40))
    return rows.select("id", slug.alias("slug"), F.explode(F.array(*map(F.lit, (".com", ".ai", ".io", ".co")))).alias("tld")).select("id", F.concat("slug", "tld").alias("domain"))
