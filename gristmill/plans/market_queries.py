"""Queries over the market: frequencies, fragments, lift, reach, guards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators import guards, market
from gristmill.registry import query
from gristmill.sources.tables import ctes, market_rows, table

M = ctes("market")
SENIOR = ("large", "standard")
KEYWORDS = ["red", "blue", "small ring", "widget", "promo", "bolt", "ring", "economy red"]
PEOPLE = {"p1": ["red", "widget", "brand#3"], "p2": ["blue", "bolt", "brand#7", "ring"], "p3": ["green", "gear"]}
FRAGS = f"f AS (SELECT title, company, n, r, unnest(list_distinct(list_concat(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END))) AS fragment FROM (SELECT title, company, n, r, list_filter(string_split(title, ' '), lambda x: x NOT IN {SENIOR}) AS w FROM (SELECT title, company, count(*) AS n, count(*) FILTER (WHERE score >= 20) AS r FROM market GROUP BY 1, 2)))"


def people(spark):
    return spark.createDataFrame([(p, s) for p, skills in PEOPLE.items() for s in skills], "person string, skill string")


OWNED = "owned(person, skill) AS (VALUES " + ", ".join(f"('{p}', '{s}')" for p, ss in PEOPLE.items() for s in ss) + ")"


@query(M + f", {FRAGS} SELECT fragment, sum(n) AS listings, sum(r) AS reachable, count(DISTINCT company) AS companies FROM f GROUP BY fragment")
def m2_fragment_index(spark, sf_dir):
    return market.fragment_index(market_rows(spark, sf_dir), SENIOR)


@query(M + f", {FRAGS} SELECT DISTINCT title, fragment FROM f")
def m1_fragments(spark, sf_dir):
    titles = market_rows(spark, sf_dir).select("title").distinct()
    return titles.select("title", F.explode(market.fragments("title", SENIOR)).alias("fragment"))


@query(M + " SELECT skill, count(*) AS n FROM (SELECT unnest(skills) AS skill FROM market) GROUP BY skill")
def m3_vocabulary(spark, sf_dir):
    return market.vocabulary(market_rows(spark, sf_dir))


@query(M + " SELECT skill, round(ln((SELECT count(*) FROM market) / (1 + count(*))), 6) AS idf FROM (SELECT unnest(skills) AS skill FROM market) GROUP BY skill")
def m4_idf(spark, sf_dir):
    rows = market_rows(spark, sf_dir)
    total = rows.agg(F.count("*").alias("total"))
    return market.vocabulary(rows).crossJoin(F.broadcast(total)).select("skill", F.round(market.idf(F.col("n"), F.col("total")), 6).alias("idf"))


MATCH = f"{OWNED}, e AS (SELECT row_id, unnest(skills) AS skill FROM market), v AS (SELECT skill, ln((SELECT count(*) FROM market) / (1 + count(*))) AS idf FROM e GROUP BY skill), m AS (SELECT person, row_id, count(*) AS shared, sum(idf) AS evidence FROM e JOIN owned USING (skill) JOIN v USING (skill) GROUP BY 1, 2 HAVING count(*) >= 2), k AS (SELECT * FROM m QUALIFY max(evidence) OVER (PARTITION BY person) < 7.0 OR evidence >= 7.0)"


@query(M + f", {MATCH} SELECT person, count(*) AS rows, sum(shared) AS shared, round(sum(evidence), 3) AS evidence FROM k GROUP BY person")
def m5_matching_rows(spark, sf_dir):
    rows = market.matching_rows(market_rows(spark, sf_dir), people(spark))
    return rows.groupBy("person").agg(F.count("*").alias("rows"), F.sum("shared").alias("shared"), F.round(F.sum("evidence"), 3).alias("evidence"))


@query(M + f", {FRAGS}, {FRAGS.replace('f AS (SELECT title', 'g AS (SELECT title', 1).replace('FROM market', 'FROM market WHERE list_contains(skills, ' + chr(39) + 'red' + chr(39) + ')')}, a AS (SELECT fragment, sum(n) AS n FROM f GROUP BY 1), b AS (SELECT fragment, sum(n) AS weight, count(DISTINCT company) AS companies FROM g GROUP BY 1), t AS (SELECT count(*) AS total, count(*) FILTER (WHERE list_contains(skills, 'red')) AS own FROM market) SELECT fragment, weight, companies, round(n / total, 6) AS share, round((weight / own) / (n / total), 6) AS lift FROM a JOIN b USING (fragment) CROSS JOIN t")
def m6_fragment_lift(spark, sf_dir):
    rows = market_rows(spark, sf_dir)
    out = market.lift(rows, rows.where(F.array_contains("skills", "red")).select("row_id"), SENIOR)
    return out.select("fragment", "weight", "companies", F.round("share", 6).alias("share"), F.round("lift", 6).alias("lift"))


@query()
def m6_keywords(spark, sf_dir):
    """Distinctive fragments of the rows with one skill: floors, then greedy suppression."""
    found = m6_fragment_lift(spark, sf_dir).where("companies >= 5 AND share <= 0.25 AND lift > 1").select(F.lit("red").alias("person"), F.col("fragment").alias("keyword"), (-F.col("lift") * F.sqrt("weight")).alias("quality"))
    return market.suppressed(found, "person", "keyword", "quality", 12)


@query(M + f", {FRAGS}, i AS (SELECT fragment, sum(n) AS listings, sum(r) AS reachable, count(DISTINCT company) AS companies FROM f GROUP BY 1) SELECT fragment, listings, reachable, companies, CASE WHEN companies < 5 THEN 'thin' WHEN listings > 0.25 * (SELECT count(*) FROM market) THEN 'broad' ELSE 'admitted' END AS admission FROM i")
def m7_admission(spark, sf_dir):
    rows = market_rows(spark, sf_dir)
    total = rows.agg(F.count("*").alias("total"))
    kind = F.when(F.col("companies") < 5, "thin").when(F.col("listings") > 0.25 * F.col("total"), "broad").otherwise("admitted")
    return market.fragment_index(rows, SENIOR).crossJoin(F.broadcast(total)).select("fragment", "listings", "reachable", "companies", kind.alias("admission"))


@query(M + f", {FRAGS}, t AS (SELECT title, count(*) AS n FROM market GROUP BY 1), c AS (SELECT DISTINCT f.fragment, t.title, t.n, len(string_split(t.title, ' ')) AS words, CASE WHEN regexp_matches(t.title, '^({'|'.join(SENIOR)}) ') THEN 1 ELSE 0 END AS senior FROM f JOIN t ON contains(t.title, f.fragment)) SELECT fragment, title AS canonical FROM c QUALIFY row_number() OVER (PARTITION BY fragment ORDER BY senior, n DESC, words, title) = 1")
def m8_canonical_titles(spark, sf_dir):
    """The best title that contains each fragment, as a substring."""
    titles = market_rows(spark, sf_dir).groupBy("title").agg(F.count("*").alias("n"))
    frags = titles.select(F.explode(market.fragments("title", SENIOR)).alias("fragment")).distinct()
    met = titles.select("title", "n", F.explode(market.inner_runs("title")).alias("fragment")).join(frags, "fragment")
    order = F.struct(F.col("title").rlike(f"^({'|'.join(SENIOR)}) ").cast("int").alias("senior"), (-F.col("n")).alias("n"), F.size(F.split("title", " ")).alias("words"), "title")
    return met.groupBy("fragment").agg(F.min(order).alias("best")).select("fragment", F.col("best.title").alias("canonical"))


@query(M + " SELECT w AS hint, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(title, ' '))) AS w FROM market) GROUP BY w HAVING count(*) >= 50")
def m9_title_words(spark, sf_dir):
    titles = market_rows(spark, sf_dir).groupBy("title").agg(F.count("*").alias("n"))
    return titles.select("n", F.explode(F.array_distinct(F.split("title", " "))).alias("hint")).groupBy("hint").agg(F.sum("n").alias("n")).where("n >= 50")


CONCEPT_WORDS = ("gear", "skills")


@query(M + f", {OWNED} SELECT person, skill FROM owned WHERE skill IN (SELECT unnest(skills) FROM market) OR len(list_intersect(string_split(skill, ' '), {list(CONCEPT_WORDS)})) = 0")
def m10_clean_skills(spark, sf_dir):
    """Skills without those that only name a concept, unless the market knows the term."""
    known = market.vocabulary(market_rows(spark, sf_dir)).select("skill", F.lit(True).alias("known"))
    concept = F.arrays_overlap(F.split("skill", " "), F.array(*map(F.lit, CONCEPT_WORDS)))
    return people(spark).join(known, "skill", "left").where(F.coalesce("known", F.lit(False)) | ~concept).select("person", "skill")


REACH = "k(keyword) AS (VALUES " + ", ".join(f"('{k}')" for k in KEYWORDS) + ")"


@query(M + f", {REACH} SELECT keyword, count(*) AS listings, count(*) FILTER (WHERE score >= 20) AS reachable, round(avg(score), 6) AS mean FROM market JOIN k ON contains(title, keyword) GROUP BY keyword")
def m11_keyword_profile(spark, sf_dir):
    return market.keyword_reach(market_rows(spark, sf_dir), KEYWORDS).withColumn("mean", F.round("mean", 6))


@query(M + f", {REACH} SELECT keyword, count(*) AS listings, round(avg(score), 6) AS mean FROM market JOIN k ON contains(title, keyword) GROUP BY keyword")
def a15_keyword_yield(spark, sf_dir):
    return m11_keyword_profile(spark, sf_dir).select("keyword", "listings", "mean")


@query(M + " SELECT count(*) AS rows, round(avg(score), 6) AS relevance, round(count(*) FILTER (WHERE score >= 20) / count(*), 6) AS reachable, count(*) FILTER (WHERE score < 20) AS waste, ceil(count(*) / 25) * 0.05 AS spend FROM market WHERE contains(title, 'red') OR contains(title, 'small ring')")
def m12_what_it_buys(spark, sf_dir):
    rows = market_rows(spark, sf_dir).where(F.col("title").contains("red") | F.col("title").contains("small ring"))
    low = F.col("score") < 20
    return rows.agg(F.count("*").alias("rows"), F.round(F.avg("score"), 6).alias("relevance"), F.round(F.count_if(~low) / F.count("*"), 6).alias("reachable"), F.count_if(low).alias("waste"), (F.ceil(F.count("*") / 25) * 0.05).alias("spend"))


@query(M + ", e AS (SELECT unnest(skills) AS skill, company, contains(title, 'red') AS bought FROM market) SELECT skill, count(*) AS listings, count(DISTINCT company) AS employers, round(count(*) FILTER (WHERE bought) / count(*), 6) AS share FROM e GROUP BY skill HAVING count(*) >= 15 AND count(DISTINCT company) >= 8 AND count(*) FILTER (WHERE bought) < 0.1 * count(*)")
def m14_orphan_skills(spark, sf_dir):
    e = market_rows(spark, sf_dir).select(F.explode("skills").alias("skill"), "company", F.col("title").contains("red").alias("bought"))
    per = e.groupBy("skill", "company").agg(F.count("*").alias("n"), F.count_if("bought").alias("b"))
    out = per.groupBy("skill").agg(F.sum("n").alias("listings"), F.count("*").alias("employers"), F.sum("b").alias("b"))
    return out.where("listings >= 15 AND employers >= 8 AND b < 0.1 * listings").select("skill", "listings", "employers", F.round(F.col("b") / F.col("listings"), 6).alias("share"))


@query(M + ", e AS (SELECT unnest(skills) AS skill, contains(title, 'ring') AS t FROM market), n AS (SELECT count(*) AS total, count(*) FILTER (WHERE contains(title, 'ring')) AS own FROM market) SELECT skill, round((count(*) FILTER (WHERE t) / own) / (count(*) / total), 6) AS lift FROM e CROSS JOIN n GROUP BY skill, own, total")
def m15_skill_lift(spark, sf_dir):
    rows = market_rows(spark, sf_dir).select("skills", F.col("title").contains("ring").alias("t"))
    sizes = rows.agg(F.count("*").alias("total"), F.count_if("t").alias("own"))
    e = rows.select(F.explode("skills").alias("skill"), "t").groupBy("skill").agg(F.count("*").alias("n"), F.count_if("t").alias("k"))
    return e.crossJoin(F.broadcast(sizes)).select("skill", F.round((F.col("k") / F.col("own")) / (F.col("n") / F.col("total")), 6).alias("lift"))


@query(M + ", v AS (SELECT skill, count(*) AS n FROM (SELECT unnest(skills) AS skill FROM market) GROUP BY 1) SELECT skill, round(n / (SELECT count(*) FROM market) * ln((SELECT count(*) FROM market) / (1 + n)), 6) AS evidence, n >= 20 AND ln((SELECT count(*) FROM market) / (1 + n)) >= 1.2 AS worth FROM v")
def m17_anchor_evidence(spark, sf_dir):
    rows = market_rows(spark, sf_dir)
    v = market.vocabulary(rows).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))
    weight = market.idf(F.col("n"), F.col("total"))
    return v.select("skill", F.round(F.col("n") / F.col("total") * weight, 6).alias("evidence"), ((F.col("n") >= 20) & (weight >= 1.2)).alias("worth"))


SHARES = f"{REACH}, e AS (SELECT row_id, title, unnest(skills) AS skill FROM market), b AS (SELECT skill, count(*) / (SELECT count(*) FROM market) AS base FROM e GROUP BY 1), m AS (SELECT keyword, count(*) AS m FROM market JOIN k ON contains(title, keyword) GROUP BY 1), n AS (SELECT keyword, skill, count(*) AS n FROM e JOIN k ON contains(title, keyword) GROUP BY 1, 2)"


@query(M + f", {SHARES} SELECT keyword, skill, round((n + 20 * base) / (m + 20), 6) AS share FROM n JOIN m USING (keyword) JOIN b USING (skill)")
def m20_shrunk_shares(spark, sf_dir):
    rows = market_rows(spark, sf_dir)
    hit = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.col("title"), k))
    total = rows.agg(F.count("*").alias("total"))
    grouped = rows.groupBy("title", "skills").agg(F.count("*").alias("c")).withColumn("hit", hit)
    base = grouped.select("c", F.explode("skills").alias("skill")).groupBy("skill").agg(F.sum("c").alias("b")).crossJoin(F.broadcast(total))
    m = grouped.select("c", F.explode("hit").alias("keyword")).groupBy("keyword").agg(F.sum("c").alias("m"))
    n = grouped.select("c", "skills", F.explode("hit").alias("keyword")).select("c", "keyword", F.explode("skills").alias("skill")).groupBy("keyword", "skill").agg(F.sum("c").alias("n"))
    return n.join(m, "keyword").join(base, "skill").select("keyword", "skill", F.round((F.col("n") + 20 * (F.col("b") / F.col("total"))) / (F.col("m") + 20), 6).alias("share"))


@query()
def m21_budget_order(spark, sf_dir):
    rows = market_rows(spark, sf_dir)
    hit = rows.select("company", F.explode(F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.col("title"), k))).alias("keyword"))
    bought = hit.groupBy("keyword", "company").agg(F.count("*").alias("n")).groupBy("keyword").agg(F.sum("n").alias("listings"), F.count("*").alias("companies"))
    shares = m20_shrunk_shares(spark, sf_dir).join(m4_idf(spark, sf_dir), "skill").join(bought, "keyword")
    return market.budget_order(shares.select(F.lit("all").alias("person"), "keyword", "skill", "share", "idf", "listings", "companies", (F.col("keyword") == "small ring").alias("held")))


@query(M + f", {SHARES}, s AS (SELECT keyword, skill, (n + 20 * base) / (m + 20) AS share FROM n JOIN m USING (keyword) JOIN b USING (skill)), o AS (SELECT *, max(share) OVER (PARTITION BY skill ORDER BY keyword ROWS UNBOUNDED PRECEDING) AS best FROM s) SELECT keyword, skill, round(best, 6) AS covered FROM o")
def m23_prefix_coverage(spark, sf_dir):
    w = Window.partitionBy("skill").orderBy("keyword").rowsBetween(Window.unboundedPreceding, 0)
    return m20_shrunk_shares(spark, sf_dir).select("keyword", "skill", F.round(F.max("share").over(w), 6).alias("covered"))


FRACTIONS = (0.05, 0.25, 0.5, 1.0)
_AT = ", ".join(f"({f}, '{round(f * 65536):04x}')" for f in FRACTIONS if f < 1)
SIZES = f"cuts(fraction, bound) AS (VALUES {_AT}, (1.0, 'g')), sm AS (SELECT fraction, market.* FROM market JOIN cuts ON left(md5(row_id::VARCHAR), 4) < bound), fr AS (SELECT fraction, company, unnest(list_distinct(list_concat(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END))) AS fragment FROM (SELECT fraction, company, list_filter(string_split(title, ' '), lambda x: x NOT IN {SENIOR}) AS w FROM sm)), ok AS (SELECT fraction, fragment FROM fr GROUP BY 1, 2 HAVING count(DISTINCT company) >= 5), z AS (SELECT fraction, count(*) AS rows FROM sm GROUP BY 1), u AS (SELECT fraction, skill, count(*) AS n FROM (SELECT fraction, unnest(skills) AS skill FROM sm) GROUP BY 1, 2)"


@query(M + f", {SIZES}, w AS (SELECT skill, n / rows AS share FROM u JOIN z USING (fraction) WHERE fraction = 1), e AS (SELECT z.fraction, avg(abs(coalesce(u.n / rows, 0) - share)) AS error, count(u.n) AS skills FROM z CROSS JOIN w LEFT JOIN u ON u.fraction = z.fraction AND u.skill = w.skill GROUP BY 1) SELECT z.fraction::DOUBLE AS fraction, rows, skills, count(ok.fragment) AS fragments, round(count(ok.fragment) FILTER (WHERE ok.fragment IN (SELECT fragment FROM ok WHERE fraction = 1)) / (SELECT count(*) FROM ok WHERE fraction = 1), 6) AS recall, round(error, 6) AS error FROM z JOIN e USING (fraction) LEFT JOIN ok USING (fraction) GROUP BY z.fraction, rows, skills, error")
def m24_size_curve(spark, sf_dir):
    """What samples of the market know, against the whole: a sampling operator."""
    found = market.size_curve(market_rows(spark, sf_dir), FRACTIONS, SENIOR)
    return found.select("fraction", "rows", "skills", "fragments", F.round("recall", 6).alias("recall"), F.round("error", 6).alias("error"))


@query(M + f", {OWNED}, o AS (SELECT person, list(skill) AS own FROM owned GROUP BY 1) SELECT person, (SELECT count(*) FROM market) AS rows, count(*) AS kept FROM o JOIN market ON len(list_intersect(skills, own)) = 0 GROUP BY person")
def m24_held_out(spark, sf_dir):
    """What of the market would be left for each person had their field never been seen."""
    return market.held_out(market_rows(spark, sf_dir), people(spark))


@query(M + ", a AS (SELECT DISTINCT row_id FROM market WHERE contains(title, 'red')), b AS (SELECT DISTINCT row_id FROM market WHERE contains(title, 'widget')) SELECT (SELECT count(*) FROM a JOIN b USING (row_id)) AS common, round((SELECT count(*) FROM a JOIN b USING (row_id)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 6) AS jaccard")
def m27_stability(spark, sf_dir):
    rows = market_rows(spark, sf_dir).select("row_id", F.col("title").contains("red").alias("a"), F.col("title").contains("widget").alias("b")).groupBy("row_id").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    both, any_ = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") | F.col("b"))
    return rows.agg(both.alias("common"), F.round(both / any_, 6).alias("jaccard"))


FREQ = "e AS (SELECT company AS run, unnest(skills) AS term FROM market), r AS (SELECT company AS run, count(*) AS rows FROM market GROUP BY 1), h AS (SELECT run, term, count(*) AS hits FROM e GROUP BY 1, 2), f AS (SELECT term, sum(hits) AS hits, sum(rows) AS seen FROM h JOIN r USING (run) GROUP BY term)"


def _frequencies(spark, sf_dir):
    return market.term_frequency(market_rows(spark, sf_dir).withColumnRenamed("company", "run"))


@query(M + f", {FREQ} SELECT * FROM f")
def a10_term_frequency(spark, sf_dir):
    return _frequencies(spark, sf_dir)


@query(M + f", {FREQ} SELECT term, hits, (SELECT max(seen) FROM f) AS seen FROM f")
def a11_whole_market(spark, sf_dir):
    f = _frequencies(spark, sf_dir)
    return f.drop("seen").crossJoin(F.broadcast(f.agg(F.max("seen").alias("seen"))))


BAND = "CASE WHEN seen >= 200 THEN CASE " + " ".join(f"WHEN hits / seen >= {a} THEN {b}" for a, b in market.BANDS) + " ELSE 5 END END"


@query(M + f", {FREQ} SELECT term, {BAND} AS separation FROM f")
def a12_separation(spark, sf_dir):
    return _frequencies(spark, sf_dir).select("term", market.separation("hits", "seen").alias("separation"))


BLENDED = f"b AS (SELECT term, length(term) % 5 + 1 AS c, {BAND} AS s FROM f), w AS (SELECT term, c, CASE WHEN s IS NULL THEN c ELSE greatest(1, least(5, round_even(sqrt(c * s), 0)::INT)) END AS weight FROM b)"


@query(M + f", {FREQ}, {BLENDED} SELECT term, weight FROM w")
def a13_blend(spark, sf_dir):
    return _frequencies(spark, sf_dir).select("term", market.blend(F.length("term") % 5 + 1, market.separation("hits", "seen")).cast("long").alias("weight"))


@query(M + f", {FREQ}, {BLENDED} SELECT term, c AS before, weight AS after FROM w WHERE c <> weight")
def a14_reweight(spark, sf_dir):
    return a13_blend(spark, sf_dir).select("term", (F.length("term") % 5 + 1).cast("long").alias("before"), F.col("weight").alias("after")).where("before <> after")


@query("WITH x AS (SELECT p_size, p_retailprice FROM part), r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rx, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS ry FROM x) SELECT round(corr(rx, ry), 6) AS rho FROM r")
def a16_spearman(spark, sf_dir):
    return market.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(F.round("rho", 6).alias("rho"))


@query(M + ", x AS (SELECT row_id, unnest(skills) AS skill FROM market), n AS (SELECT skill, count(*) AS n FROM x GROUP BY 1), p AS (SELECT a, b, count(*) AS common FROM (SELECT a, unnest(skills) AS b FROM (SELECT unnest(skills) AS a, skills FROM market)) WHERE a < b GROUP BY 1, 2 HAVING count(*) >= 5) SELECT p.a, p.b, common, round(common * (SELECT count(*) FROM market) / (i.n * j.n), 6) AS lift FROM p JOIN n i ON i.skill = p.a JOIN n j ON j.skill = p.b")
def a30_cooccurrence(spark, sf_dir):
    """Pairs are made inside each row's short skill list and counted; rows with equal skills are counted first."""
    grouped = market_rows(spark, sf_dir).groupBy(F.array_sort("skills").alias("skills")).agg(F.count("*").alias("c"))
    n = grouped.select("c", F.explode("skills").alias("skill")).groupBy("skill").agg(F.sum("c").alias("n"))
    pairs = grouped.select("c", F.explode("skills").alias("a"), "skills").select("c", "a", F.explode("skills").alias("b")).where("a < b").groupBy("a", "b").agg(F.sum("c").alias("common")).where("common >= 5")
    total = grouped.agg(F.sum("c").alias("total"))
    return pairs.join(n.select(F.col("skill").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("skill").alias("b"), F.col("n").alias("nb")), "b").crossJoin(F.broadcast(total)).select("a", "b", "common", F.round(F.col("common") * F.col("total") / (F.col("na") * F.col("nb")), 6).alias("lift"))


@query(M + ", e AS (SELECT unnest(skills) AS term, score FROM market), b AS (SELECT avg(score) AS base FROM market) SELECT term, CASE WHEN count(*) >= 30 THEN round(1 - avg(score) / base, 6) END AS precision FROM e CROSS JOIN b GROUP BY term, base")
def a31_exclusion_precision(spark, sf_dir):
    rows = market_rows(spark, sf_dir)
    base = rows.agg(F.avg("score").alias("base"))
    e = rows.select(F.explode("skills").alias("term"), "score").groupBy("term").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).crossJoin(F.broadcast(base))
    return e.select("term", F.when(F.col("n") >= 30, F.round(1 - F.col("mean") / F.col("base"), 6)).alias("precision"))


@query(M + f", {REACH} SELECT count(DISTINCT keyword) AS keywords, count(DISTINCT row_id) AS listings, count(*) FILTER (WHERE score < 20) AS wasted FROM market JOIN k ON contains(title, keyword)")
def a37_plan_quality(spark, sf_dir):
    hit = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.col("title"), k))
    rows = market_rows(spark, sf_dir).select("row_id", "score", hit.alias("hit")).where(F.size("hit") > 0)
    used = rows.select(F.explode("hit").alias("k")).groupBy("k").count().agg(F.count("*").alias("keywords"))
    per = rows.groupBy("row_id").agg(F.sum(F.when(F.col("score") < 20, F.size("hit")).otherwise(0)).alias("w")).agg(F.count("*").alias("listings"), F.sum("w").alias("wasted"))
    return used.crossJoin(per)


# ---- guards: each rule only rejects, and gives way for a person who would be left with nothing --------------------------------------

CANDIDATES = "cand AS (SELECT c_custkey % 30 AS person, lower(c_mktsegment) || ' ' || (c_custkey % 4) AS q, count(*) AS n, count(DISTINCT c_nationkey) AS companies FROM customer GROUP BY 1, 2)"


def _candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 30).alias("person"), F.concat_ws(" ", F.lower("c_mktsegment"), F.col("c_custkey") % 4).alias("q"), "c_nationkey")
    return rows.groupBy("person", "q").agg(F.count("*").alias("n"), F.size(F.collect_set("c_nationkey")).cast("long").alias("companies"))


def _guard(rule: str) -> str:
    return f"WITH {CANDIDATES} SELECT person, q FROM cand QUALIFY ({rule}) OR max(CASE WHEN {rule} THEN 1 ELSE 0 END) OVER (PARTITION BY person) = 0"


#: Searches proposed for people with what the rules ask about them: a family by its word, held titles, orphans; and the people's records.
GATED, KNOWN = ["machinery"], ("building", "machinery", "household")
FAMILY = "CASE WHEN split_part(q, ' ', 1) IN " + str(KNOWN) + " THEN split_part(q, ' ', 1) END"
ASKED = f"{CANDIDATES}, asked AS (SELECT *, {FAMILY} AS family, (person + n) % 5 = 0 AS held, q LIKE '% 3' AS orphan FROM cand)"
RECORDS = (
    "sup AS (SELECT person, list(DISTINCT family) AS supported FROM asked WHERE family IS NOT NULL AND n >= 2 GROUP BY person), "
    "records AS (SELECT p.person, p.person % 7 = 0 AS thin, coalesce(supported, []) AS supported, CASE WHEN p.person % 3 = 0 THEN ['machinery'] ELSE [] END AS transition, p.person % 4 AS other, "
    "CASE WHEN p.person % 11 = 0 THEN ['machinery'] ELSE [] END AS titles, CASE WHEN p.person % 2 = 0 THEN 'machinery' END AS target FROM (SELECT DISTINCT person FROM asked WHERE person <> 5) p LEFT JOIN sup USING (person))"
)


def _asked(spark, sf_dir):
    word = F.split_part("q", F.lit(" "), F.lit(1))
    return _candidates(spark, sf_dir).select("*", F.when(word.isin(*KNOWN), word).alias("family"), ((F.col("person") + F.col("n")) % 5 == 0).alias("held"), F.col("q").like("% 3").alias("orphan"))


def _records(asked):
    some = lambda cond: F.when(cond, F.array(F.lit("machinery"))).otherwise(F.array().cast("array<string>"))
    person = F.col("person")
    supported = F.array_sort(F.collect_set(F.when(F.col("n") >= 2, F.col("family"))))
    return asked.where("person <> 5").groupBy("person").agg(supported.alias("supported")).select("person", (person % 7 == 0).alias("thin"), "supported", some(person % 3 == 0).alias("transition"), (person % 4).alias("other"), some(person % 11 == 0).alias("titles"), F.when(person % 2 == 0, "machinery").alias("target"))


def _open(rule: str, rows: str = "asked", columns: str = "person, q") -> str:
    return f"SELECT {columns} FROM {rows} QUALIFY ({rule}) OR max(CASE WHEN {rule} THEN 1 ELSE 0 END) OVER (PARTITION BY person) = 0"


#: Replacements by part: the last two words of a market title for its first two, some with an operator or a level word.
LEVELS, ROLES = ("large", "economy"), ("widget", "ring")
FINAL = (
    "parts AS (SELECT p_partkey % 30 AS person, string_split(lower(p_type) || ' ' || p_name, ' ') AS w, p_size FROM part), "
    "fin AS (SELECT DISTINCT person, CASE WHEN p_size % 9 = 0 THEN '-' ELSE '' END || w[len(w) - 1] || CASE WHEN p_size % 7 = 0 THEN '' ELSE ' ' || w[len(w)] END AS q, CASE WHEN p_size % 5 > 0 THEN w[1] || ' ' || w[2] END AS fragment, person % 2 = 0 AS exempt FROM parts), "
    "counted AS (SELECT title, count(*) AS n FROM market GROUP BY title), allq AS (SELECT DISTINCT q FROM fin UNION SELECT DISTINCT fragment FROM fin WHERE fragment IS NOT NULL), "
    "share AS (SELECT q, coalesce(sum(n), 0) / (SELECT sum(n) FROM counted) AS share FROM allq LEFT JOIN counted ON contains(' ' || title || ' ', ' ' || q || ' ') GROUP BY q)"
)
TERMS = lambda column, terms: f"regexp_matches({column}, '(^|[^a-z0-9])({'|'.join(terms)})([^a-z0-9]|$)')"
RULE = lambda q, share: f"CASE WHEN len(string_split({q}, ' ')) < 2 THEN 'degenerate' WHEN regexp_matches({q}, '(^|\\s)-\\w') THEN 'search_operator' WHEN coalesce({share}, 0) > 0.25 THEN 'catalogue' WHEN {TERMS(q, LEVELS)} THEN 'level_or_entry' WHEN {TERMS(q, ROLES)} AND NOT exempt THEN 'role_term_unexempted' ELSE 'accepted' END"


def _final(spark, sf_dir):
    w = F.split(F.concat_ws(" ", F.lower("p_type"), "p_name"), " ")
    size, last = F.col("p_size"), F.element_at(w, -1)
    q = F.concat(F.when(size % 9 == 0, "-").otherwise(""), F.element_at(w, -2), F.when(size % 7 == 0, "").otherwise(F.concat(F.lit(" "), last)))
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 30).alias("person"), q.alias("q"), F.when(size % 5 > 0, F.concat_ws(" ", F.element_at(w, 1), F.element_at(w, 2))).alias("fragment"))
    return rows.distinct().withColumn("exempt", F.col("person") % 2 == 0)


def _shares(spark, sf_dir, queries):
    asked = queries.select("q").union(queries.select("fragment").where("fragment IS NOT NULL"))
    return guards.market_share(asked, market_rows(spark, sf_dir).select("title"))


@query(M + f", {FINAL} SELECT person, q, {RULE('q', 'share')} AS verdict FROM fin LEFT JOIN share USING (q) WHERE fragment IS NOT NULL")
def q1_query_contract(spark, sf_dir):
    queries = _final(spark, sf_dir).where("fragment IS NOT NULL")
    rows = queries.join(_shares(spark, sf_dir, queries), "q", "left")
    return rows.select("person", "q", guards.contract("q", F.coalesce("share", F.lit(0.0)), LEVELS, ROLES, F.col("exempt")).alias("verdict"))


@query(M + f", {FINAL}, j AS (SELECT f.*, CASE WHEN fragment IS NULL THEN 'own' ELSE {RULE('f.q', 's.share')} END AS rule, {RULE('f.fragment', 't.share')} = 'accepted' AS good FROM fin f LEFT JOIN share s ON f.q = s.q LEFT JOIN share t ON f.fragment = t.q), k AS ({_open("rule IN ('own', 'accepted') OR good", 'j', '*')}) SELECT DISTINCT person, CASE WHEN rule NOT IN ('own', 'accepted') AND good THEN fragment ELSE q END AS q, CASE WHEN rule NOT IN ('own', 'accepted') AND good THEN 'fragment' ELSE rule END AS rule FROM k")
def q1_revalidated(spark, sf_dir):
    queries = _final(spark, sf_dir)
    return guards.revalidated(queries, _shares(spark, sf_dir, queries), LEVELS, ROLES)


@query(f"WITH {ASKED} " + _open("held OR family IS NOT NULL OR (n >= 10 AND companies >= 3)"))
def q2_thin_family(spark, sf_dir):
    return guards.without_thin(_asked(spark, sf_dir).withColumnRenamed("n", "postings")).select("person", "q")


@query(f"WITH {ASKED}, {RECORDS}, o AS (SELECT a.*, thin, supported, transition FROM asked a LEFT JOIN records USING (person)) " + _open("NOT orphan OR NOT coalesce(NOT thin AND len(supported) + len(transition) > 0, false) OR family IS NULL OR coalesce(list_contains(list_concat(supported, transition), family), true)", "o"))
def q3_orphan_titles(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    return guards.without_orphans(asked, _records(asked)).select("person", "q")


@query(f"WITH {ASKED}, {RECORDS}, o AS (SELECT a.*, r.* EXCLUDE (person) FROM asked a LEFT JOIN records r USING (person)) " + _open("family IS NULL OR family <> 'machinery' OR NOT coalesce(NOT thin AND len(list_filter(supported, lambda x: x <> 'machinery')) > 0 AND other >= 2, false) OR coalesce(list_contains(supported, family), false) OR coalesce(list_contains(titles, family), false) OR (coalesce(target = family, false) AND coalesce(list_contains(transition, family), false))", "o"))
def q4_family_veto(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    return guards.without_vetoed(asked, _records(asked), GATED).select("person", "q")


@query(f"WITH {ASKED} SELECT person, q, max(CASE WHEN held THEN 'held_title' WHEN companies >= 2 THEN 'corroborated_target' END) AS reason FROM asked WHERE n < 2 AND {TERMS('q', ('building', 'machinery'))} AND (held OR companies >= 2) GROUP BY person, q")
def q5_restore(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    none = asked.select("q").distinct().select("q", F.lit(0.0).alias("share"))
    rows = asked.select("person", "q", F.when(F.col("held"), "held_title").otherwise("stated_target").alias("source"), (F.col("companies") >= 2).alias("strong"))
    return guards.restored(rows, asked.where("n >= 2"), none, ("building", "machinery"))


@query(f"WITH {ASKED}, src AS (SELECT person, q AS hint, 'held_titles' AS source, 1 AS priority FROM asked WHERE held UNION ALL SELECT person, family, 'role_families', 2 FROM asked WHERE n >= 2 UNION ALL SELECT person, split_part(q, ' ', 1), 'own_hints', 3 FROM asked WHERE companies >= 2), h AS (SELECT person, hint, min_by(source, priority) AS source FROM src WHERE hint IS NOT NULL AND length(hint) >= 5 AND hint <> 'furniture' GROUP BY 1, 2) SELECT * FROM h UNION ALL SELECT DISTINCT person, 'engineer', 'floor' FROM asked WHERE person NOT IN (SELECT person FROM h)")
def q6_gate_build(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    parts = [(F.when(F.col("held"), F.col("q")), "held_titles", 1), (F.when(F.col("n") >= 2, F.col("family")), "role_families", 2), (F.when(F.col("companies") >= 2, F.split_part("q", F.lit(" "), F.lit(1))), "own_hints", 3)]
    hints = asked.select("person", F.explode(F.array(*[F.struct(h.alias("hint"), F.lit(s).alias("source"), F.lit(p).alias("priority")) for h, s, p in parts])).alias("s")).select("person", "s.*")
    return guards.title_gate(hints, ["engineer"], ("furniture",))


@query(f"WITH {CANDIDATES}, s AS (SELECT person, split_part(q, ' ', 1) AS family, sum(n) AS n FROM cand GROUP BY 1, 2) SELECT person, family, n, n >= 0.25 * sum(n) OVER (PARTITION BY person) AS core FROM s")
def q7_core_families(spark, sf_dir):
    s = _candidates(spark, sf_dir).groupBy("person", F.split_part("q", F.lit(" "), F.lit(1)).alias("family")).agg(F.sum("n").alias("n"))
    return s.withColumn("core", F.col("n") >= 0.25 * F.sum("n").over(Window.partitionBy("person")))


@query(_guard("n >= 100"))
def q8_fail_open(spark, sf_dir):
    return guards.fail_open(_candidates(spark, sf_dir), F.col("n") >= 100).select("person", "q")


@query(M + f", {REACH}, t AS (SELECT title, count(*) AS c FROM market GROUP BY 1), h AS (SELECT keyword, title, c FROM t JOIN k ON contains(title, keyword)), n AS (SELECT keyword, sum(c) AS n FROM h GROUP BY 1), p AS (SELECT a.keyword AS a, b.keyword AS b, sum(a.c) AS common FROM h a JOIN h b ON a.title = b.title AND a.keyword < b.keyword GROUP BY 1, 2) SELECT count(*) AS pairs, round(avg(coalesce(common, 0) / (x.n + y.n - coalesce(common, 0))), 6) AS mean_jaccard FROM n x JOIN n y ON x.keyword < y.keyword LEFT JOIN p ON p.a = x.keyword AND p.b = y.keyword")
def m23_redundancy(spark, sf_dir):
    """Mean overlap of the listings that the keywords buy, over all pairs of keywords; equal titles are counted first."""
    hit = F.filter(F.array(*map(F.lit, sorted(KEYWORDS))), lambda k: F.contains(F.col("title"), k))
    titles = market_rows(spark, sf_dir).groupBy("title").agg(F.count("*").alias("n")).select("n", hit.alias("hit")).where("size(hit) > 0")
    n = titles.select("n", F.explode("hit").alias("k")).groupBy("k").agg(F.sum("n").alias("n"))
    both = titles.select("n", F.explode("hit").alias("a"), "hit").select("n", "a", F.explode("hit").alias("b")).where("a < b").groupBy("a", "b").agg(F.sum("n").alias("both"))
    pairs = n.select(F.col("k").alias("a"), F.col("n").alias("na")).join(n.select(F.col("k").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b")).join(both, ["a", "b"], "left")
    shared = F.coalesce("both", F.lit(0))
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg(shared / (F.col("na") + F.col("nb") - shared)), 6).alias("mean_jaccard"))


def _spelled(spark, sf_dir):
    """Order lines as market rows whose skills are written in two ways: singular, plural, or both."""
    items, part = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    words, line = F.split("p_name", " "), F.col("l_linenumber")
    plural = F.transform(words, lambda w: F.concat(w, F.lit("s")))
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.when(line % 5 == 0, F.concat(words, plural)).when(line % 2 == 0, plural).otherwise(words).alias("skills"))


SPELLED = "r AS (SELECT row_number() OVER () AS id, CASE WHEN l_linenumber % 5 = 0 THEN list_concat(w, list_transform(w, lambda x: x || 's')) WHEN l_linenumber % 2 = 0 THEN list_transform(w, lambda x: x || 's') ELSE w END AS skills FROM (SELECT l_linenumber, string_split(p_name, ' ') AS w FROM lineitem JOIN part ON l_partkey = p_partkey)), e AS (SELECT id, unnest(skills) AS skill FROM r), n AS (SELECT skill, count(*) AS n FROM e GROUP BY 1)"


@query(f"WITH {SPELLED}, f AS (SELECT a.skill, b.skill AS form, a.n, b.n AS listings FROM n a JOIN n b ON b.skill = a.skill || 's' OR a.skill = b.skill || 's' WHERE b.n >= 5), t AS (SELECT f.skill, f.form, count(*) AS together FROM f JOIN e x ON x.skill = f.skill JOIN e y ON y.skill = f.form AND y.id = x.id GROUP BY 1, 2) SELECT skill, form, listings, coalesce(together, 0) AS together, round(coalesce(together, 0) * (SELECT count(*) FROM r) / (n * listings), 6) AS lift FROM f LEFT JOIN t USING (skill, form)")
def a30_surface_variants(spark, sf_dir):
    """The other spellings of every skill that the market uses, with how often both stand together."""
    return market.expanded(_spelled(spark, sf_dir)).select("skill", "form", "listings", "together", F.round("lift", 6).alias("lift"))
