"""Queries over postings: scans, filters, signals, keys, ranking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions import experience
from gristmill.functions import resume as R
from gristmill.functions import signals as S
from gristmill.functions import text as X
from gristmill.operators import chain, ranking, scoring
from gristmill.operators.chain import Settings
from gristmill.registry import query
from gristmill.sources.tables import ctes, dealt, postings, table

#: Terms that occur in the driver's prose, in the order of their weights.
SKILLS = {"the": 3, "of": 2, "with": 4, "der": 5, "les": 4, "que": 3, "una": 2, "license": 6, "trash": 1}
PENALTIES = {"stupid": -5, "loser": -4, "mit": -1}
FRONTEND, BACKEND, TITLES = ("and", "und", "et"), ("for", "aus", "pour"), ("is", "est")
HARD, SOFT = ("or", "oder"), ("on", "an")
BLOCKED = ("src3", "src7")
PROFILE = scoring.Profile(SKILLS, PENALTIES, FRONTEND, BACKEND, TITLES, HARD, SOFT, BLOCKED)


def _has(text: str, term: str) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


def _any_of(text: str, terms) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9])({'|'.join(terms)})([^a-z0-9]|$)')"


LOW = "lower(title || chr(10) || description)"
SCORED = (
    ctes("posting")
    + f""", low AS (SELECT *, {LOW} AS t, lower(title) AS tt FROM posting WHERE company NOT IN {BLOCKED}),
scored AS (SELECT arrival, company, title, location, {_any_of('tt', HARD)} AS excluded,
 ({_any_of('t', FRONTEND)} AND {_any_of('t', BACKEND)}) OR {_any_of('tt', TITLES)} AS is_fullstack, {_any_of('tt', SOFT)} AS soft,
 array_to_string(list_filter([{', '.join(f"CASE WHEN {_has('t', k)} THEN '{k}' END" for k in SKILLS)}], lambda x: x IS NOT NULL), ', ') AS matched_skills,
 {' + '.join(f"CASE WHEN {_has('t', k)} THEN {v} ELSE 0 END" for k, v in (SKILLS | PENALTIES).items())} AS base FROM low),
final AS (SELECT *, (base + CASE WHEN is_fullstack THEN 3 ELSE 0 END + CASE WHEN soft THEN -4 ELSE 0 END + CASE WHEN excluded THEN -20 ELSE 0 END)::INT AS score FROM scored)"""
)


def scored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(postings(spark, sf_dir).drop("score"), PROFILE)


@query(ctes("posting") + f" SELECT arrival, array_to_string(list_filter([{', '.join(f'CASE WHEN ' + _has('lower(description)', k) + f' THEN {chr(39)}{k}{chr(39)} END' for k in SKILLS)}], lambda x: x IS NOT NULL), ', ') AS matched, ({' + '.join(f'CASE WHEN ' + _has('lower(description)', k) + f' THEN {v} ELSE 0 END' for k, v in SKILLS.items())})::INT AS score FROM posting")
def e1_term_score(spark, sf_dir):
    hit = scoring.matched_terms("description", list(SKILLS))
    return postings(spark, sf_dir).select("arrival", F.array_join(hit, ", ").alias("matched"), scoring.term_score(hit, SKILLS).alias("score"))


@query(SCORED + " SELECT arrival, score, matched_skills, is_fullstack, excluded FROM final")
def e17_score_job(spark, sf_dir):
    return scored_postings(spark, sf_dir).select("arrival", "score", "matched_skills", "is_fullstack", "excluded")


@query(SCORED + " SELECT arrival, is_fullstack FROM final WHERE is_fullstack")
def e5_fullstack_flag(spark, sf_dir):
    text = F.concat_ws("\n", F.lower("title"), F.lower("description"))
    full = (X.mentions(text, FRONTEND) & X.mentions(text, BACKEND)) | X.mentions("title", TITLES)
    return postings(spark, sf_dir).where(~X.norm_company("company").isin(*BLOCKED)).select("arrival", full.alias("is_fullstack")).where("is_fullstack")


@query(ctes("posting") + f" SELECT arrival, {' + '.join(f'CASE WHEN ' + _has('lower(description)', k) + f' THEN {v} ELSE 0 END' for k, v in PENALTIES.items())} + CASE WHEN {_any_of('lower(title)', SOFT)} THEN -4 ELSE 0 END AS penalty FROM posting")
def e6_penalties(spark, sf_dir):
    penalty = scoring.term_score(scoring.matched_terms("description", list(PENALTIES)), PENALTIES) + F.when(X.mentions("title", SOFT), -4).otherwise(0)
    return postings(spark, sf_dir).select("arrival", penalty.alias("penalty"))


@query()
def e3_required_years(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", experience.required_years("description").alias("years_required"))


#: Openings of requirements by part number, with the figure that counts: the size, the size and five, or another one; null for none.
ASKS = (
    ("{n}+ years of professional experience.", "p_size"), ("{n} to {n5} years of hands-on experience.", "p_size"), ("Area lead : {n}+ years", "p_size"),
    ("The firm is {n} years old. We look for 3 years of experience.", "3"), ("You bring 2 years of experience at least. Degree course: {n} years full time.", "2"),
    ("Term of the contract: {n} years.", "NULL"), ("{n} years of experience in total, {n5} years of Java experience.", "p_size + 5"), ("Experience of {n} yrs", "p_size"),
)


def _asks(asks=ASKS):
    """A text per part, by its number, from its size."""
    texts = [F.concat_ws("", *[{"n": F.col("p_size").cast("string"), "n5": (F.col("p_size") + 5).cast("string")}.get(piece, F.lit(piece)) for piece in re.split("[{}]", text)]) for text, *_ in asks]
    return F.get(F.array(*texts), F.col("p_partkey") % len(asks))


def _by_ask(asks, k: int) -> str:
    return f"CASE p_partkey % {len(asks)} {' '.join(f'WHEN {i} THEN {a[k]}' for i, a in enumerate(asks))} END"


@query(f"SELECT p_partkey, {_by_ask(ASKS, 1)}::INT AS years_required FROM part")
def e3_years_stated(spark, sf_dir):
    return dealt(table(spark, sf_dir, "part")).select("p_partkey", experience.required_years(_asks()).alias("years_required"))


#: Requirements by part number: the text and the (place, min, max, type, scope, confidence) of its figures.
STATEMENTS = (
    ("{n}+ years of professional experience.", [(0, "p_size", "NULL", "required", "overall", "high")]),
    ("{n} to {n5} years of hands-on experience.", [(0, "p_size", "p_size + 5", "range", "overall", "high")]),
    ("Up to {n} years of experience.", [(0, "p_size", "NULL", "maximum", "unknown", "low")]),
    ("{n}+ years of experience in Terraform.", [(0, "p_size", "NULL", "required", "skill_specific", "low")]),
    ("Ideally {n}-{n5} years of experience.", [(0, "p_size", "p_size + 5", "preferred", "overall", "low")]),
    ("Together we have {n} years of combined experience.", [(0, "p_size", "NULL", "ambiguous", "unknown", "low")]),
    ("A {n} year degree. At least {n5} years of experience, 3+ years React.", [(0, "p_size", "NULL", "not_experience", "unknown", "low"), (1, "p_size + 5", "NULL", "required", "overall", "high"), (2, "3", "NULL", "required", "skill_specific", "low")]),
    ("This post asks for {n} years of experience.", [(0, "p_size", "NULL", "required", "overall", "low")]),
)
EXPECTED = ", ".join(f"({k}, {place}, {low.replace('p_size', '0') if low != 'NULL' else 'NULL'}, {'false' if 'p_size' not in low else 'true'}, {'NULL' if high == 'NULL' else 5}, '{kind}', '{about}', '{sure}')" for k, (_, rows) in enumerate(STATEMENTS) for place, low, high, kind, about, sure in rows)


@query(f"SELECT p_partkey, place, CASE WHEN relative THEN p_size ELSE 0 END + low AS min_years, p_size + high AS max_years, kind AS requirement_type, about AS scope, sure AS confidence FROM part JOIN (VALUES {EXPECTED}) AS e(k, place, low, relative, high, kind, about, sure) ON p_partkey % {len(STATEMENTS)} = k")
def e4_statements(spark, sf_dir):
    """Every figure of years of a text, read and classified."""
    said = dealt(table(spark, sf_dir, "part")).select("p_partkey", F.posexplode(experience.statements(_asks(STATEMENTS))).alias("place", "s"))
    return said.select("p_partkey", "place", *(f"s.{c}" for c in ("min_years", "max_years", "requirement_type", "scope", "confidence")))


@query()
def e4_document_statements(spark, sf_dir):
    said = postings(spark, sf_dir).select("arrival", F.explode(experience.statements("description")).alias("s"))
    return said.select("arrival", "s.start", "s.min_years", "s.max_years", "s.requirement_type", "s.scope", "s.confidence", "s.evidence")


@query()
def e7_remote_scope(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", S.remote_scope("location", "title", "description").alias("remote_scope"))


#: Postings by customer number: location, description, and the scope, regions, eligibility, visa answer, contractors, zones and gap they state.
STATED = (
    ("Anywhere in the World", "Your clients sit in the US and India.", "worldwide", "US, India", "", "", "", "", 0.0),
    ("Berlin", "The desk is in town and the post is not remote; hybrid weeks, onsite days.", "onsite", "", "", "", "", "", None),
    ("Berlin", "Hybrid, with 2 days in the office. UTC+2 preferred.", "hybrid", "", "", "", "", "UTC+2", 3.5),
    ("", "We are fully remote and meet onsite twice a year.", "remote", "", "", "", "", "", None),
    ("Europe, Remote", "Sadly we cannot sponsor anyone.", "restricted", "", "", "no", "", "", None),
    ("", "Remote, yet you must reside in Canada; contracts run via Deel.", "restricted", "Canada", "Canada", "", "Deel", "", 11.5),
    ("", "Remote anywhere in the US.", "restricted", "US", "US", "", "", "", 11.5),
    ("Bengaluru, India", "Your contract is with an employer of record, Oyster.", "", "", "", "", "EOR, Oyster", "", None),
    ("Remote (Buenos Aires, Argentina)", "Visa sponsorship comes with the job.", "restricted", "", "", "yes", "", "", None),
    ("", "Nice people and good coffee.", "", "", "", "", "", "", None),
    ("", "UTC-10 UTC-9 UTC-8; for the United States or EMEA.", "", "US, EMEA", "", "", "", "UTC-10; UTC-9; UTC-8", 13.5),
    (None, None, "", "", "", "", "", "", None),
)
NAMES = ("scope", "regions", "eligibility", "visa", "eor", "timezones", "tz_gap")


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, float) else "'" + x.replace("'", "''") + "'"


@query(f"SELECT c_custkey, {', '.join(NAMES)} FROM customer JOIN (VALUES {', '.join(f'({k}, ' + ', '.join(map(_literal, row[2:])) + ')' for k, row in enumerate(STATED))}) AS s(k, {', '.join(NAMES)}) ON c_custkey % {len(STATED)} = k")
def e16_stated_signals(spark, sf_dir):
    """Scope, regions, eligibility, visa, contractors, zones and gap of stated texts."""
    at = lambda k: F.get(F.array(*[F.lit(row[k]) for row in STATED]), F.col("c_custkey") % len(STATED))
    rows = table(spark, sf_dir, "customer").select("c_custkey", at(0).alias("l"), F.lit("Engineer").alias("t"), at(1).alias("d"))
    return rows.select("c_custkey", S.remote_scope("l", "t", "d").alias("scope"), S.regions("d").alias("regions"), S.eligibility_regions("d").alias("eligibility"), S.visa("d").alias("visa"), S.eor("d").alias("eor"), S.time_zones("d").alias("timezones"), S.tz_gap(S.regions("d"), S.time_zones("d"), 5.5).alias("tz_gap"))


@query()
def e8_regions(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", S.regions("description").alias("regions"), S.eligibility_regions("description").alias("eligibility"))


def _re(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


@query(ctes("posting") + f" SELECT arrival, CASE WHEN regexp_matches(description, '{_re(S.VISA_NO)}') THEN 'no' WHEN regexp_matches(description, '{_re(S.VISA_YES)}') THEN 'yes' ELSE '' END AS visa FROM posting")
def e9_visa(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", S.visa("description").alias("visa"))


@query()
def e10_eor(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", S.eor("description").alias("eor"))


@query()
def e11_time_zones(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", S.time_zones("description").alias("timezones"))


@query()
def e12_tz_gap(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", S.tz_gap(S.regions("description"), S.time_zones("description"), 5.5).alias("tz_gap"))


@query("SELECT event_id, CASE WHEN value > 5.0 THEN round_even(-1.0 * (value - 5.0), 0)::INT ELSE 0 END AS penalty FROM events")
def e13_tz_penalty(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.bround(S.tz_penalty("value", -1.0)).cast("int").alias("penalty"))


PAY = {0: "$180,000 - $220,000 a year", 1: "$150k - $190k", 2: "$75 - $95 an hour", 3: "€90,000 per year", 4: "not disclosed", 5: "12 LPA", 6: "50000-80000 per month"}
PAID = {0: 220000.0, 1: 190000.0, 2: 197600.0, 3: 97200.0, 5: 13680.0}


@query(f"SELECT o_orderkey, CASE o_orderkey % 7 {' '.join(f'WHEN {k} THEN {v}::DOUBLE' for k, v in PAID.items())} END AS usd FROM orders")
def e14_pay_usd(spark, sf_dir):
    pay = F.element_at(F.create_map(*[F.lit(x) for p in PAY.items() for x in p]), (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(S.comp_max_usd(pay), 6).alias("usd"))


@query(ctes("posting") + f" SELECT arrival, array_to_string(list_distinct_ordered, '; ') AS emails FROM (SELECT arrival, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT arrival, regexp_extract_all(description, '{S.EMAIL}') AS l FROM posting))")
def e15_contacts(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", S.emails("description").alias("emails"))


@query()
def e15_phones(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", S.phones("description").alias("phones"))


@query()
def e16_enrich(spark, sf_dir):
    return scoring.enriched(postings(spark, sf_dir), 5.5).drop("description")


_AGE = "date_diff('day', o_orderdate::DATE, DATE '1997-06-01')"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 OR {_AGE} < 0 THEN '' WHEN {_AGE} = 0 THEN 'today' WHEN {_AGE} < 7 THEN {_AGE} || 'd ago' WHEN {_AGE} < 60 THEN {_AGE} // 7 || 'w ago' ELSE {_AGE} // 30 || 'mo ago' END AS label, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate::DATE END AS day, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 12 END AS years FROM orders")
def e19_posting_age(spark, sf_dir):
    """The age of a posting as it is told, its date by the start of the cell, and the years at the start of another."""
    form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    cell = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("posted "), form)).otherwise(F.concat(F.lit(" "), form))
    years = F.get(F.array(*map(F.lit, ("3+", " 12-15 Yrs", "Full Time", ""))), F.col("o_orderkey") % 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.posted_age(cell, F.lit("1997-06-01").cast("date")).alias("label"), S.date_prefix(cell).alias("day"), chain.stated_years(years).alias("years"))


@query(ctes("posting") + " SELECT CASE WHEN location = 'en' THEN 'home' WHEN location IN ('de','fr') THEN 'remote' ELSE 'abroad' END AS bucket, count(*) AS n, max(score) AS best FROM posting GROUP BY 1")
def e20_buckets(spark, sf_dir):
    bucket = F.when(F.col("location") == "en", "home").when(F.col("location").isin("de", "fr"), "remote").otherwise("abroad")
    return postings(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query(ctes("posting") + " SELECT arrival, CASE WHEN score >= 40 THEN 'A' WHEN score >= 25 THEN 'B' WHEN score >= 10 THEN 'C' ELSE 'D' END AS tier FROM posting")
def e21_tier(spark, sf_dir):
    score = F.col("score")
    return postings(spark, sf_dir).select("arrival", F.when(score >= 40, "A").when(score >= 25, "B").when(score >= 10, "C").otherwise("D").alias("tier"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS site, CASE WHEN len(regexp_extract_all(url, '[?&]page=')) = 1 THEN try_cast(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS INT) END AS p FROM pages)
SELECT page_id, CASE WHEN p > 0 AND count(*) OVER (PARTITION BY site, p) = 1 THEN p END AS position FROM p""")
def e22_positions(spark, sf_dir):
    site = F.regexp_extract("url", "^https?://([^/]+)", 1)
    position = F.when(F.regexp_count("url", F.lit("[?&]page=")) == 1, F.regexp_extract("url", "[?&]page=([^&#]*)", 1).try_cast("int"))
    df = table(spark, sf_dir, "pages").select("page_id", site.alias("site"), position.alias("p"))
    once = df.groupBy("site", "p").agg(F.count("*").alias("n")).where("n = 1 AND p > 0")
    return df.join(once.select("site", "p", F.col("p").alias("position")), ["site", "p"], "left").select("page_id", "position")


@query("SELECT page_id, regexp_extract(url, '/(\\d+)(?:[?#]|$)', 1) AS native_id, regexp_matches(url, '/\\d+(?:[?#]|$)') AS valid FROM pages")
def e23_native_id(spark, sf_dir):
    rx = r"/(\d+)(?:[?#]|$)"
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", rx, 1).alias("native_id"), F.col("url").rlike(rx).alias("valid"))


@query("SELECT o_orderkey, left(sha256(o_orderpriority || chr(31) || o_custkey), 12) AS query_fp, left(sha256(o_orderpriority), 12) AS keyword_fp FROM orders")
def e25_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.fingerprint("o_orderpriority", F.col("o_custkey").cast("string")).alias("query_fp"), X.fingerprint("o_orderpriority").alias("keyword_fp"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN contains(lower(p_type || ' ' || p_name), 'red') OR contains(lower(p_type || ' ' || p_name), 'bolt') ELSE contains(p_name, 'gear') END AS title_matches, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN p_partkey % 2 = 0 WHEN 2 THEN true ELSE p_partkey % 5 = 0 END AS location_matches FROM part")
def e26_mismatch(spark, sf_dir):
    """Whether results have a word of their search and its place, by any name of that."""
    key, size = F.col("p_partkey"), F.col("p_size")
    keyword = F.get(F.array(F.lit("Stack developer"), F.lit("Red/bolt Engineer"), F.lit("gear js")), size % 3)
    asked, text = F.get(F.array(*map(F.lit, ("Remote", "Bengaluru", "Gurgaon", "Oslo"))), size % 4), F.get(F.array(F.lit("anywhere"), F.when(key % 2 == 0, "Bangalore, KA"), F.lit("Gurugram"), F.when(key % 5 == 0, "Greater OSLO").otherwise("Bergen")), size % 4)
    return table(spark, sf_dir, "part").select("p_partkey", S.title_has_query(keyword, F.concat_ws(" ", "p_type", "p_name")).alias("title_matches"), S.place_is_query(asked, text).alias("location_matches"))


#: Months by order number: how they are written, and what is read.
MONTHS = (
    ("strftime(o_orderdate, '%b %Y')", "m"), ("strftime(o_orderdate, '%Y-%m')", "m"), ("'Present'", "24017"), ("'15 ' || strftime(o_orderdate, '%B %Y')", "m"), ("strftime(o_orderdate, '%m/%Y')", "m"),
    ("strftime(o_orderdate, '%Y') || '-19'", "NULL"), ("strftime(o_orderdate, '%Y')", "year(o_orderdate) * 12 + 1"), ("'soon'", "NULL"), ("''", "NULL"), ("strftime(o_orderdate, '%b, %Y - ') || '2150'", "m"),
)


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(MONTHS)} {' '.join(f'WHEN {k} THEN {right}' for k, (_, right) in enumerate(MONTHS))} END AS month_index FROM (SELECT *, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders)")
def e27_month_parse(spark, sf_dir):
    """Months as people write them: by name or number, with a day, with nothing but a year, today, and what can't be one."""
    at = lambda form: F.date_format("o_orderdate", form)
    forms = [at("MMM yyyy"), at("yyyy-MM"), F.lit(" Present "), F.concat(F.lit("15 "), at("MMMM yyyy")), at("MM/yyyy"), F.concat(at("yyyy"), F.lit("-19")), at("yyyy"), F.lit("soon"), F.lit(""), F.concat(at("MMM, yyyy - "), F.lit("2150"))]
    text = F.get(F.array(*forms), F.col("o_orderkey") % len(forms))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.month_index(text, F.lit("2001-05-20").cast("date")).alias("month_index"))


@query("SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:3], '; ') AS items FROM (SELECT p_partkey, [p_name, 'x' || p_size || ' y', repeat('z', 30), lower(p_type), p_type] AS l FROM part)")
def e28_list_hygiene(spark, sf_dir):
    """Lists of strings cleaned: control characters and white space, repeats in another case, blanks, caps of items and of characters."""
    values = F.array(F.concat(F.lit("\t"), F.upper("p_name"), F.lit("\x07")), F.lit(None).cast("string"), F.concat(F.lit("  x"), F.col("p_size"), F.lit("\r\n y ")), F.col("p_name"), F.lit(" \n "), F.repeat(F.lit("z"), 400), F.lower("p_type"), F.col("p_type"))
    named = F.transform(values, lambda v, i: F.when(i == 0, F.concat(F.lit("\t"), F.col("p_name"), F.lit("\x07"))).otherwise(v))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(R.signal_list(named, 3, 30), "; ").alias("items"))


# ---- the whole chain -----------------------------------------------------------------------------------------------------------

#: Postings by customer number: STATED texts with pay, dates and requirements of many kinds. For each text its score by CHAIN.
CHAIN = scoring.Profile({"remote": 4, "clients": 3, "desk": 2, "contract": 6, "utc": 5}, {"twice": -3}, hard_drop=("principal",), soft_drop=("junior",), blocklist=("BUILDING",), max_years=8)
LIMITS = Settings(min_score=2, max_age_days=20, min_comp_usd=40_000, remote_scopes=("worldwide", "remote"), home_regions=("India", "EMEA"), drop_no_visa=True, require_eor=False, drop_excluded=True)
ON_SITE = Settings(min_score=0, drop_undated=True, max_age_days=25, on_site_only=True, home_country=("berlin", "india"))


def _chain_score(text: str | None) -> int:
    low = (text or "").lower()
    return sum(w for t, w in (CHAIN.skills | CHAIN.penalties).items() if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low))


def _chain_row(k: int) -> str:
    place, text, scope, regions, eligibility, visa, eor, zones, _ = STATED[k]
    head = "Europe" if place == "Europe, Remote" else "India" if place and "India" in place and "remote" in place.lower() else ""
    remote_regions = head or ("" if scope == "worldwide" else eligibility)
    return f"({k}, {_literal(place)}, {_literal(text)}, '{scope}', '{remote_regions}', '{visa}', '{eor}', '{zones}', {_chain_score(text)})"


CHAINED = (
    f"s(k, place, said, scope, regions, visa, eor, zones, base) AS (VALUES {', '.join(map(_chain_row, range(len(STATED))))}), "
    "p AS (SELECT c_custkey AS id, c_mktsegment AS company, CASE WHEN c_custkey % 17 = 0 THEN 'Principal Engineer' WHEN c_custkey % 17 = 1 THEN 'Junior Engineer' ELSE 'Engineer' END AS title, "
    "(c_custkey * 7) % 31 AS age, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 20 + c_custkey % 40 END AS pay, c_custkey % 13 AS years, s.* FROM customer JOIN s ON c_custkey % 12 = k WHERE c_mktsegment <> 'BUILDING'), "
    "q AS (SELECT *, base + CASE WHEN title LIKE 'Junior%' THEN -4 ELSE 0 END AS score, title LIKE 'Principal%' OR years > 8 AS excluded, scope IN ('worldwide', 'remote', 'restricted') AS remote, id % 23 = 0 AS undated, id % 5 = 0 AS hires_home FROM p)"
)


def _chain_postings(spark, sf_dir):
    key = F.col("c_custkey")
    at = lambda k: F.get(F.array(*[F.lit(row[k]) for row in STATED]), key % len(STATED))
    title = F.when(key % 17 == 0, "Principal Engineer").when(key % 17 == 1, "Junior Engineer").otherwise("Engineer")
    asks = F.when(key % 13 > 0, F.concat((key % 13).cast("string"), F.lit("+ years of experience needed.")))
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_mktsegment").alias("company"), title.alias("title"), at(0).alias("location"), F.concat_ws("\n", at(1), asks).alias("description"), F.when(key % 9 > 0, F.concat(F.lit("USD "), 20 + key % 40, F.lit("k a year"))).alias("salary"),
        F.when(key % 23 == 0, "whenever").otherwise(F.concat(((key * 7) % 31).cast("string"), F.lit(" days ago"))).alias("posted_raw"), F.when(key % 5 == 0, "yes").alias("hires_home"), F.lit("board:x").alias("source"), F.concat(F.lit("http://j/"), key).alias("job_url"), F.lit("stated elsewhere").alias("experience"))


AS_OF = "2024-06-01"
STAGED = "CASE WHEN excluded THEN 'excluded' WHEN score < 2 THEN 'score' WHEN NOT undated AND age > 20 THEN 'stale' WHEN pay < 40 THEN 'salary' WHEN NOT (scope IN ('worldwide', 'remote') OR scope = 'restricted' AND (hires_home OR regions IN ('India', 'EMEA'))) THEN 'unreachable' WHEN visa = 'no' THEN 'visa' END"


@query(f"WITH {CHAINED} SELECT id, score + CASE WHEN excluded THEN -20 ELSE 0 END AS score, {STAGED} AS drop_stage FROM q")
def f15_all_stages(spark, sf_dir):
    """The first filter that each posting fails: exclusion, score, age, pay, reach, visa, contractor, arrangement, place."""
    rows = chain.staged(_chain_postings(spark, sf_dir), CHAIN, LIMITS, F.lit(AS_OF).cast("date"))
    return rows.select("id", "score", "drop_stage")


@query(f"WITH {CHAINED}, d AS (SELECT *, {STAGED} AS stage FROM q), n(place, name) AS (VALUES (0, 'excluded'), (1, 'score'), (2, 'stale'), (3, 'salary'), (4, 'unreachable'), (5, 'visa'), (6, 'eor'), (7, 'arrangement'), (8, 'geography')), e AS (SELECT d.*, coalesce((SELECT place FROM n WHERE name = stage), 9) AS last FROM d) SELECT name AS stage, count(*) AS entered, count(*) FILTER (WHERE last = n.place) AS dropped, count(*) FILTER (WHERE name = 'unreachable' AND last > n.place AND scope = 'restricted') AS rescued FROM e JOIN n ON last >= n.place GROUP BY 1")
def f15_stage_counts(spark, sf_dir):
    """How many postings came to each filter, went there, or were reachable only from home."""
    return chain.counts(chain.staged(_chain_postings(spark, sf_dir), CHAIN, LIMITS, F.lit(AS_OF).cast("date")))


@query(f"WITH {CHAINED} SELECT CASE WHEN excluded THEN 'excluded' WHEN score < 0 THEN 'score' WHEN undated OR age > 25 THEN 'stale' WHEN remote THEN 'arrangement' WHEN coalesce(place, '') <> '' AND NOT regexp_matches(lower(place), '(^|[^a-z0-9])(berlin|india)([^a-z0-9]|$)') THEN 'geography' END AS drop_stage, count(*) AS n FROM q GROUP BY 1")
def f15_on_site_chain(spark, sf_dir):
    """The chain of someone who looks for work on site, near home, and drops what has no date."""
    rows = chain.staged(_chain_postings(spark, sf_dir), CHAIN, ON_SITE, F.lit(AS_OF).cast("date"))
    return rows.groupBy("drop_stage").agg(F.count("*").alias("n"))


@query(f"WITH {CHAINED}, m AS (SELECT *, list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(coalesce(said, {chr(39)}{chr(39)})), {chr(39)}(^|[^a-z0-9]){t}([^a-z0-9]|$){chr(39)}) THEN {chr(39)}{t}{chr(39)} END' for t in CHAIN.skills)}], lambda x: x IS NOT NULL) AS hit FROM q) SELECT score + CASE WHEN excluded THEN -20 ELSE 0 END AS score, array_to_string(hit, ', ') AS matched_skills, false AS is_fullstack, title, company, coalesce(place, '') AS location, remote AS \"remote?\", scope AS remote_scope, CASE WHEN hires_home THEN 'yes' ELSE '' END AS hires_home, '' AS tz_gap, regions AS remote_regions, visa, eor, zones AS timezones, CASE WHEN years > 0 THEN years || '+' ELSE 'stated elsewhere' END AS experience_required, coalesce('USD ' || pay || 'k a year', '') AS salary, '' AS hr_email, '' AS hr_phone, 'board:x' AS source_site, 'http://j/' || id AS apply_url, CASE WHEN undated THEN 'whenever' ELSE age || ' days ago' END AS date_posted, '' AS req_number, '' AS grade, '' AS verified_live, '' AS search_query, '' AS search_rank FROM m")
def e18_output_columns(spark, sf_dir):
    """The 26 columns of the output."""
    return chain.output(chain.staged(_chain_postings(spark, sf_dir), CHAIN, LIMITS, F.lit(AS_OF).cast("date")))


@query("WITH s AS (SELECT o_orderkey, o_orderpriority AS company, CASE WHEN o_orderkey % 7 = 0 THEN 'Principal X' ELSE 'X' END AS title, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'worldwide' WHEN 2 THEN 'restricted' WHEN 3 THEN 'onsite' ELSE '' END AS scope, CASE o_orderkey % 4 WHEN 0 THEN 9 WHEN 1 THEN 2 END AS years, o_orderkey % 3 = 0 AS home, (o_orderkey * 5) % 29 AS age, o_orderkey % 11 = 0 AS undated FROM orders) SELECT o_orderkey FROM s WHERE company <> '5-LOW' AND (scope IS NULL OR scope = 'worldwide' OR scope = 'restricted' AND home) AND (undated OR age <= 20) AND title = 'X' AND coalesce(years <= 8, true)")
def f16_stored_rows(spark, sf_dir):
    """Stored rows that today's settings would still report."""
    key = F.col("o_orderkey")
    stored = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("company"), F.when(key % 7 == 0, "Principal X").otherwise("X").alias("title"), F.get(F.array(F.lit(None), *map(F.lit, ("worldwide", "restricted", "onsite", ""))), key % 5).alias("remote_scope"), F.lit("US").alias("remote_regions"),
        F.get(F.array(*map(F.lit, ("9+", " 2-4 Yrs", "Full Time", ""))), key % 4).alias("experience_required"), F.when(key % 3 == 0, "true").otherwise("").alias("hires_home"), F.when(key % 11 == 0, "n/a").otherwise(F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), ((key * 5) % 29).cast("int")), "yyyy-MM-dd")).alias("date_posted"))
    settings = Settings(max_age_days=20, remote_scopes=("worldwide", "remote"), blocklist=("5 low",), hard_drop=("principal",), max_years=8)
    return chain.applyable(stored, settings, F.lit(AS_OF).cast("date")).select("o_orderkey")


# ---- filters -----------------------------------------------------------------------------------------------------------------


@query(ctes("posting") + f" SELECT arrival FROM posting WHERE location IS NULL OR location = '' OR {_any_of('lower(location)', ('en', 'de'))}")
def f1_location_gate(spark, sf_dir):
    return postings(spark, sf_dir).where((X.blank("location") == "") | X.mentions("location", ("en", "de"))).select("arrival")


INCLUDE, EXCLUDE = ("er", "tion"), ("ment", "ung")


@query(ctes("posting") + f" SELECT arrival FROM posting WHERE ({' OR '.join(f'contains(lower(title), {chr(39)}{x}{chr(39)})' for x in INCLUDE)}) AND NOT ({' OR '.join(f'contains(lower(title), {chr(39)}{x}{chr(39)})' for x in EXCLUDE)})")
def f2_title_gate(spark, sf_dir):
    return postings(spark, sf_dir).where(scoring.dev_title("title", INCLUDE, EXCLUDE)).select("arrival")


@query(ctes("posting") + f" SELECT arrival, contains(lower(location), 'e') AS home_flag, location = '' OR {_any_of('lower(location)', ('en',))} AS in_home FROM posting")
def f3_home(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", X.contains_any("location", ("e",)).alias("home_flag"), ((X.blank("location") == "") | X.mentions("location", ("en",))).alias("in_home"))


@query(ctes("posting") + " SELECT arrival, max(location = 'es') OVER (PARTITION BY company) AS hires_home FROM posting")
def f4_hires_home(spark, sf_dir):
    rows = postings(spark, sf_dir).select("arrival", "company", "location")
    home = rows.groupBy("company").agg(F.bool_or(F.col("location") == "es").alias("hires_home"))
    return rows.join(home, "company").select("arrival", "hires_home")


@query(ctes("posting") + f" SELECT arrival FROM posting WHERE company NOT IN {BLOCKED}")
def f5_blocklist(spark, sf_dir):
    blocked = spark.createDataFrame([(x,) for x in BLOCKED], "name string")
    return postings(spark, sf_dir).withColumn("name", X.norm_company("company")).join(F.broadcast(blocked), "name", "left_anti").select("arrival")


@query(ctes("posting") + f" SELECT arrival FROM posting WHERE NOT {_any_of('lower(title)', HARD)}")
def f6_hard_drop(spark, sf_dir):
    return postings(spark, sf_dir).where(~X.mentions("title", HARD)).select("arrival")


@query()
def f7_experience_ceiling(spark, sf_dir):
    return postings(spark, sf_dir).where(F.coalesce(experience.required_years("description") <= 6, F.lit(True))).select("arrival")


@query(f"SELECT p_partkey FROM part WHERE coalesce({_by_ask(ASKS, 1)} <= 6, true)")
def f7_stated_ceiling(spark, sf_dir):
    return dealt(table(spark, sf_dir, "part")).where(F.coalesce(experience.required_years(_asks()) <= 6, F.lit(True))).select("p_partkey")


CONFIRMED = f"CASE p_partkey % {len(STATEMENTS)} {' '.join(f'WHEN {k} THEN {low}' for k, (_, rows) in enumerate(STATEMENTS) for _, low, _, _, _, sure in rows if sure == 'high')} END"


@query(f"SELECT p_partkey, CASE WHEN gap >= 2 THEN 'hard_drop' WHEN gap >= 1 THEN 'penalty' ELSE 'none' END AS action FROM (SELECT p_partkey, round({CONFIRMED} - round(CASE WHEN p_partkey % 9 <> 4 THEN p_partkey % 400 END / 12.0, 2), 2) AS gap FROM part)")
def f8_experience_gap(spark, sf_dir):
    """The confirmed minimum of a text against a candidate's months; either may be unknown."""
    months = F.when(F.col("p_partkey") % 9 != 4, F.col("p_partkey") % 400)
    rows = dealt(table(spark, sf_dir, "part")).select("p_partkey", experience.confirmed_minimum(_asks(STATEMENTS))["min_years"].alias("least"), months.alias("months"))
    return rows.select("p_partkey", experience.gap_action("least", "months").alias("action"))


@query(SCORED + " SELECT arrival, score FROM final WHERE score >= 8")
def f9_minimum_score(spark, sf_dir):
    return scored_postings(spark, sf_dir).where("score >= 8").select("arrival", "score")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR date_diff('day', o_orderdate::DATE, DATE '1999-06-30') <= 30")
def f10_freshness(spark, sf_dir):
    age = F.datediff(F.lit("1999-06-30").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").where(age.isNull() | (age <= 30)).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE coalesce(CASE o_orderkey % 7 {' '.join(f'WHEN {k} THEN {v}' for k, v in PAID.items())} END >= 100000, true)")
def f11_pay_floor(spark, sf_dir):
    return e14_pay_usd(spark, sf_dir).where(F.col("usd").isNull() | (F.col("usd") >= 100000)).select("o_orderkey")


SCOPE = "CASE arrival % 5 WHEN 0 THEN 'worldwide' WHEN 1 THEN 'restricted' WHEN 2 THEN 'onsite' WHEN 3 THEN '' ELSE 'hybrid' END"


@query(ctes("posting") + f" SELECT arrival FROM (SELECT *, {SCOPE} AS scope, max(location = 'es') OVER (PARTITION BY company) AS hires FROM posting) WHERE scope = 'worldwide' OR (scope = 'restricted' AND (hires OR location = 'en'))")
def f12_reachable(spark, sf_dir):
    rows = postings(spark, sf_dir).select("arrival", "company", "location", F.expr(SCOPE).alias("scope"))
    rows = rows.join(rows.groupBy("company").agg(F.bool_or(F.col("location") == "es").alias("hires")), "company")
    return rows.where("scope = 'worldwide' OR (scope = 'restricted' AND (hires OR location = 'en'))").select("arrival")


@query(ctes("posting") + f" SELECT arrival FROM posting WHERE NOT regexp_matches(description, '{_re(S.VISA_NO)}')")
def f13_visa_refusals(spark, sf_dir):
    return postings(spark, sf_dir).where(S.visa("description") != "no").select("arrival")


@query(ctes("posting") + f" SELECT arrival FROM posting WHERE {SCOPE} NOT IN ('worldwide', 'remote', 'restricted')")
def f14_arrangement(spark, sf_dir):
    return postings(spark, sf_dir).where(~F.coalesce(F.expr(SCOPE).isin(*S.REMOTE_SCOPES), F.lit(False))).select("arrival")


@query(SCORED + """, staged AS (SELECT *, CASE WHEN excluded THEN 'excluded' WHEN score < 4 THEN 'score' WHEN location = 'es' THEN 'location' WHEN arrival % 11 = 0 THEN 'age' ELSE 'kept' END AS drop_stage FROM final)
SELECT drop_stage, count(*) AS n, max(score) AS best FROM staged GROUP BY 1""")
def f15_filter_chain(spark, sf_dir):
    stage = F.when(F.col("excluded"), "excluded").when(F.col("score") < 4, "score").when(F.col("location") == "es", "location").when(F.col("arrival") % 11 == 0, "age").otherwise("kept")
    return scored_postings(spark, sf_dir).groupBy(stage.alias("drop_stage")).agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query(ctes("posting") + " SELECT arrival, score FROM posting WHERE score >= 20 AND starts_with(company, 'src1') AND contains(lower(title || ' ' || description), 'license')")
def f17_screen_view(spark, sf_dir):
    rows = postings(spark, sf_dir).where((F.col("score") >= 20) & F.col("company").startswith("src1"))
    return rows.where(F.lower(F.concat_ws(" ", "title", "description")).contains("license")).select("arrival", "score")


@query(ctes("posting") + """, c AS (SELECT count(*) FILTER (WHERE score < 20) AS score, count(*) FILTER (WHERE location <> 'en') AS location, count(*) FILTER (WHERE company = 'src0') AS company FROM posting)
SELECT CASE WHEN greatest(score, location, company) = 0 THEN NULL WHEN score >= location AND score >= company THEN 'score' WHEN location >= company THEN 'location' ELSE 'company' END AS worst, greatest(score, location, company) AS removed FROM c""")
def f18_worst_filter(spark, sf_dir):
    c = postings(spark, sf_dir).agg(F.count_if(F.col("score") < 20).alias("score"), F.count_if(F.col("location") != "en").alias("location"), F.count_if(F.col("company") == "src0").alias("company"))
    most = F.greatest("score", "location", "company")
    worst = F.when(most == 0, F.lit(None)).when((F.col("score") >= F.col("location")) & (F.col("score") >= F.col("company")), "score").when(F.col("location") >= F.col("company"), "location").otherwise("company")
    return c.select(worst.alias("worst"), most.alias("removed"))


@query(ctes("posting") + " SELECT arrival, score FROM posting p WHERE score >= 30 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.arrival AND event_type = 'purchase') ORDER BY score DESC, arrival LIMIT 50")
def f19_candidates(spark, sf_dir):
    applied = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("arrival")).distinct()
    return ranking.top(postings(spark, sf_dir).where("score >= 30").join(applied, "arrival", "left_anti").select("arrival", "score"), 50)


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'score' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'age' WHEN o_orderstatus = 'P' THEN 'years' ELSE 'kept' END AS reason FROM orders")
def f20_curated(spark, sf_dir):
    reason = F.when(F.col("o_totalprice") < 100000, "score").when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "age").when(F.col("o_orderstatus") == "P", "years").otherwise("kept")
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def f21_grades(spark, sf_dir):
    return table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


HINTS = (("tion", "held"), ("ung", "family"), ("er", "held"), ("ment", "target"))


@query(ctes("posting") + f", h(hint, source) AS (VALUES {', '.join(map(str, HINTS))}) SELECT arrival, array_to_string(list_sort(list(DISTINCT source)), ',') AS admitted_by FROM posting JOIN h ON contains(lower(title), hint) GROUP BY arrival")
def f22_title_admits(spark, sf_dir):
    """Hints are a fixed list: tested in place, one pass, no join."""
    low = F.lower("title")
    by = F.array_compact(F.array(*[F.when(low.contains(h), F.lit(s)) for h, s in HINTS]))
    return postings(spark, sf_dir).select("arrival", F.array_join(F.array_sort(F.array_distinct(by)), ",").alias("admitted_by")).where("admitted_by <> ''")


PLACES = {"north": ("en", "de"), "south": ("es", "fr"), "all": ("en", "de", "es", "fr")}


@query(ctes("posting") + " SELECT arrival FROM posting WHERE location IN ('es', 'fr')")
def f23_places(spark, sf_dir):
    chosen = F.array_distinct(F.flatten(F.array(*[F.array(*map(F.lit, PLACES[n])) for n in ("south",)])))
    return postings(spark, sf_dir).where(F.array_contains(chosen, F.col("location"))).select("arrival")


# ---- keys, ranking, merging ----------------------------------------------------------------------------------------------------

NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT c_custkey, regexp_replace({NORM.format('c_name || ' + chr(39) + ' Technologies Inc.' + chr(39))}, '(\\s+({'|'.join(X.COMPANY_SUFFIXES)}))+$', '') AS company_key, array_to_string(list_sort(string_split({NORM.format('c_mktsegment || ' + chr(39) + ' And ' + chr(39) + ' || c_name')}, ' ')), ' ') AS title_key FROM customer")
def d1_key_pieces(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.company_key(F.concat("c_name", F.lit(" Technologies Inc."))).alias("company_key"), X.title_key(F.concat_ws(" And ", "c_mktsegment", "c_name")).alias("title_key"))


URL = "regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(trim({0}), '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '[?#].*$', ''), '/+$', '')), '^www\\.', '')"


@query(f"SELECT page_id, {URL.format('url')} AS canonical FROM pages")
def d2_canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url("url").alias("canonical"))


JOB_KEY = f"CASE WHEN {NORM.format('company')} <> '' AND {NORM.format('title')} <> '' THEN 'ct|' || {NORM.format('company')} || '|' || array_to_string(list_sort(string_split({NORM.format('title')}, ' ')), ' ') END"


@query(ctes("posting") + f" SELECT arrival, {JOB_KEY} AS key FROM posting")
def d3_job_key(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", X.job_key("company", "title").alias("key"))


DEDUPED = f", k AS (SELECT *, coalesce({JOB_KEY}, '__row' || arrival) AS key FROM posting), d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, arrival) = 1)"


@query(ctes("posting") + DEDUPED + " SELECT arrival, title, score FROM d")
def d4_rank_dedupe(spark, sf_dir):
    rows = postings(spark, sf_dir).select("arrival", "title", "score", X.job_key("company", "title").alias("key"))
    return ranking.best_per_key(rows, "key").select("arrival", "title", "score")


@query(ctes("posting") + DEDUPED.replace("FROM posting)", "FROM (SELECT * FROM posting WHERE arrival % 2 = 0 UNION ALL SELECT * FROM posting WHERE arrival % 3 = 0))") + " SELECT arrival, score FROM d WHERE score >= 10")
def d5_merge_runs(spark, sf_dir):
    rows = postings(spark, sf_dir).select("arrival", "score", X.job_key("company", "title").alias("key"))
    return ranking.merged([rows.where("arrival % 2 = 0"), rows.where("arrival % 3 = 0")], "key", keep=F.col("score") >= 10).select("arrival", "score")


@query("SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02')")
def d6_only_new(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    seen = events.where(F.col("ts") < at("2024-01-02")).select("user_id").distinct()
    return events.where(F.col("ts") >= at("2024-01-10")).select("user_id").distinct().join(seen, "user_id", "left_anti")


LEDGER = "g AS (SELECT user_id AS key, event_type = 'error' AS gone, ts AS moment, event_id FROM events WHERE event_type IN ('signup', 'error')), n AS (SELECT key, max_by(gone, (moment, event_id)) AS gone, max(moment) AS moment FROM g GROUP BY 1)"


def _ledger(spark, sf_dir):
    """key, gone, at, tie: signups as entries, errors as removals."""
    log = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error"))
    return log.select(F.col("user_id").alias("key"), (F.col("event_type") == "error").alias("gone"), F.col("ts").alias("at"), F.col("event_id").alias("tie"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id")
def d7_applied_ledger(spark, sf_dir):
    """What a ledger of entries and removals comes to: the last word on every key, removals too."""
    last = ranking.last_entries(_ledger(spark, sf_dir))
    return last.select(F.col("key").alias("user_id"), F.when(F.col("gone"), "error").otherwise("signup").alias("last_type"), F.col("at").alias("last_ts"))


@query(f"WITH {LEDGER} SELECT key, moment FROM n WHERE NOT gone")
def d7_standing_entries(spark, sf_dir):
    """The keys of the ledger that stand: those whose last word is no removal."""
    return ranking.ledger_state(_ledger(spark, sf_dir)).select("key", F.col("at").alias("moment"))


@query(f"WITH {LEDGER} SELECT event_id, user_id, coalesce(NOT n.gone, false) AS applied FROM events LEFT JOIN n ON n.key = user_id WHERE event_type = 'view'")
def d7_flagged_view(spark, sf_dir):
    """A view with a flag for what the ledger holds."""
    events = table(spark, sf_dir, "events")
    return ranking.flagged(events.where("event_type = 'view'").select("event_id", "user_id"), ranking.ledger_state(_ledger(spark, sf_dir)), "user_id")


@query("SELECT user_id, max_by(value, (ts, event_id)) AS value, count(*) AS changes FROM events GROUP BY user_id")
def d8_tracking_upsert(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("changes"))


@query("SELECT c_custkey, CASE WHEN o.live IS NULL THEN 'unknown' WHEN o.live THEN 'open' ELSE 'closed' END AS status FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus <> 'F', (o_orderdate, o_orderkey)) AS live FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def d9_watchlist(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.col("o_orderstatus") != "F", F.struct("o_orderdate", "o_orderkey")).alias("live"))
    status = F.when(F.col("live").isNull(), "unknown").when(F.col("live"), "open").otherwise("closed")
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("SELECT l_partkey, min(l_orderkey * 100 + l_linenumber) AS first_arrival FROM lineitem GROUP BY 1")
def d10_first_seen(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("first_arrival"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'")
def d11_live_only(spark, sf_dir):
    live = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(live, "l_orderkey", "left_semi")


# ---- views and sorts -------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 100")
def w1_newest_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_totalprice"), "o_orderkey").limit(100)
    return rows.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


@query(ctes("posting") + " SELECT arrival, score FROM posting ORDER BY score DESC, arrival LIMIT 25")
def w2_top_n(spark, sf_dir):
    return ranking.top(postings(spark, sf_dir).select("arrival", "score"), 25)


@query(ctes("posting") + " SELECT company, arrival, score, row_number() OVER (PARTITION BY company ORDER BY score DESC, arrival) AS rank FROM posting WHERE company <> 'src0' QUALIFY rank <= 8")
def w3_top_per_employer(spark, sf_dir):
    rows = postings(spark, sf_dir).where("company <> 'src0'").select("company", "arrival", "score")
    return ranking.top_per(rows, "company", 8).withColumn("rank", F.col("rank").cast("long"))


@query(SCORED + f", k AS (SELECT *, coalesce({JOB_KEY}, '__row' || arrival) AS key FROM final WHERE score >= 4), d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, arrival) = 1) SELECT arrival, title, company, score, matched_skills FROM d ORDER BY score DESC, arrival LIMIT 200")
def flagship_shortlist(spark, sf_dir):
    """Score, filter, de-duplicate and rank: texts are read once and only keys, scores and titles are shuffled."""
    rows = scored_postings(spark, sf_dir).where("score >= 4").select("arrival", "title", "company", "score", "matched_skills", X.job_key("company", "title").alias("key"))
    return ranking.top(ranking.best_per_key(rows, "key").drop("key"), 200)
