"""Queries over runs: funnels, plans, spans, counterfactuals, audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.text import job_key
from gristmill.operators import audits, comparison, counterfactuals, funnels, inventories, overlap
from gristmill.plans.posting_queries import JOB_KEY
from gristmill.registry import query
from gristmill.sources.tables import ctes, plan_units, postings, results, results_of, table

R, P, B = ctes("result"), ctes("plan"), ctes("plan", "result")


@query(R + " SELECT source, count(*) AS rows, count(*) FILTER (WHERE score >= 10) AS gated, count(*) FILTER (WHERE score >= 25) AS eligible, count(*) FILTER (WHERE score >= 45) AS final FROM result GROUP BY GROUPING SETS ((source), ())")
def a1_funnel_by_source(spark, sf_dir):
    at = lambda n: F.col("score") >= n
    return funnels.funnel(results(spark, sf_dir), "source", {"gated": at(10), "eligible": at(25), "final": at(45)})


#: Results some of which have no key and not all identifiers of their own.
NAMED = "i AS (SELECT source, arrival, CASE WHEN position = 7 THEN NULL ELSE key END AS key, CASE WHEN position > 1 THEN 'r' || arrival END AS ref, CASE WHEN unit_id % 3 = 0 THEN '' ELSE 'x' END AS org FROM result)"


def _named(spark, sf_dir):
    rows = results(spark, sf_dir)
    native = F.map_filter(F.create_map(F.lit("ref"), F.when(F.col("position") > 1, F.concat(F.lit("r"), "arrival")), F.lit("org"), F.when(F.col("unit_id") % 3 == 0, "").otherwise("x")), lambda _, v: v.isNotNull())
    return rows.select("source", "arrival", F.when(F.col("position") != 7, F.col("key")).alias("key"), native.alias("native"))


@query(R + f", {NAMED}, f AS (SELECT key, min_by(source, arrival) AS source FROM i WHERE key IS NOT NULL GROUP BY key) SELECT source, count(*) AS rows, count(DISTINCT key) AS keys, (SELECT count(*) FROM f WHERE f.source = i.source) AS newly, count(*) FILTER (WHERE key IS NULL) AS unkeyed FROM i GROUP BY source")
def a2_identity_profile(spark, sf_dir):
    """Rows, keys, keys that no earlier source had, and rows without a key, by source."""
    return inventories.identity(_named(spark, sf_dir))


@query(R + f", {NAMED} SELECT source, 'ref' AS field, count(ref) AS filled FROM i GROUP BY 1 UNION ALL SELECT source, 'org', count(*) FILTER (WHERE org <> '') FROM i GROUP BY 1")
def a2_native_fill(spark, sf_dir):
    """How many rows of a source carry each of its own identifiers."""
    return inventories.native_fill(_named(spark, sf_dir))


@query(R + ", c AS (SELECT *, CASE WHEN arrival = min(arrival) OVER (PARTITION BY key) THEN 'new' WHEN arrival > min(arrival) OVER (PARTITION BY key, unit_id) THEN 'repeat-in-unit' ELSE 'repeat-of-earlier' END AS acquired FROM result) SELECT source, acquired, count(*) AS n FROM c GROUP BY 1, 2")
def a3_acquired(spark, sf_dir):
    return funnels.acquired(results(spark, sf_dir)).groupBy("source", "acquired").agg(F.count("*").alias("n"))


@query(R + " SELECT unit_id, string_agg(position || CASE WHEN score >= 45 THEN 'F' WHEN score >= 25 THEN 'E' ELSE 'r' END, ' ' ORDER BY position, CASE WHEN score >= 45 THEN 'F' WHEN score >= 25 THEN 'E' ELSE 'r' END) AS trace FROM result GROUP BY unit_id")
def a5_reach_trace(spark, sf_dir):
    token = F.concat(F.col("position"), F.when(F.col("score") >= 45, "F").when(F.col("score") >= 25, "E").otherwise("r"))
    ordered = F.array_sort(F.collect_list(F.struct("position", token.alias("token"))))
    return results(spark, sf_dir).groupBy("unit_id").agg(F.array_join(F.transform(ordered, lambda x: x["token"]), " ").alias("trace"))


@query(B + " SELECT p.unit_id, count(arrival) AS raw, CASE WHEN count(arrival) > 0 THEN count(*) FILTER (WHERE score >= 25) END AS eligible, max(score) AS best FROM plan p LEFT JOIN result r ON p.unit_id = r.unit_id GROUP BY p.unit_id")
def a6_unit_funnel(spark, sf_dir):
    units = results(spark, sf_dir).groupBy("unit_id").agg(F.count("*").alias("raw"), F.count_if(F.col("score") >= 25).alias("eligible"), F.max("score").alias("best"))
    return plan_units(spark, sf_dir).select("unit_id").join(units, "unit_id", "left").select("unit_id", F.coalesce("raw", F.lit(0)).alias("raw"), "eligible", "best")


@query(B + " SELECT provider, (position - 1) // 5 AS bucket, count(*) AS n, count(*) FILTER (WHERE score >= 25) AS eligible FROM result JOIN plan USING (unit_id) GROUP BY 1, 2")
def a7_position_buckets(spark, sf_dir):
    rows = results(spark, sf_dir).select("unit_id", "score", F.floor((F.col("position") - 1) / 5).alias("bucket"))
    return rows.join(plan_units(spark, sf_dir).select("unit_id", "provider"), "unit_id").groupBy("provider", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 25).alias("eligible"))


_STATES = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'planned' END ELSE 'skipped_budget' END"
STATED_UNITS = f"u AS (SELECT o_orderkey AS unit_id, o_orderpriority AS provider, {_STATES} AS status, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice::DECIMAL(18,2) END AS ceiling FROM orders), c AS (SELECT l_orderkey AS unit_id, CASE l_linenumber WHEN 1 THEN 'estimate' WHEN 2 THEN 'run_record' ELSE 'account' END AS source, l_extendedprice::DECIMAL(18,2) AS usd FROM lineitem)"


def _stated_units(spark, sf_dir):
    """(units with status and ceiling, what was observed of their costs)."""
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(state == "F", "completed").when(state == "O", F.when(key % 5 == 0, "failed").otherwise("planned")).otherwise("skipped_budget")
    units = table(spark, sf_dir, "orders").select(key.alias("unit_id"), F.col("o_orderpriority").alias("provider"), status.alias("status"), F.when(key % 7 > 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("ceiling"))
    source = F.when(F.col("l_linenumber") == 1, "estimate").when(F.col("l_linenumber") == 2, "run_record").otherwise("account")
    return units, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), source.alias("source"), F.col("l_extendedprice").cast("decimal(18,2)").alias("usd"))


@query(f"WITH {STATED_UNITS} SELECT provider, count(*) AS planned, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped_budget') AS skipped_budget, count(*) FILTER (WHERE status = 'planned') AS unvisited, coalesce(sum(ceiling), 0) AS bounded, count(*) FILTER (WHERE ceiling IS NULL) AS unbounded, coalesce(sum(ceiling) FILTER (WHERE status IN ('completed', 'failed')), 0) AS attempted_bounded, count(*) FILTER (WHERE ceiling IS NULL AND status IN ('completed', 'failed')) AS attempted_unbounded FROM u GROUP BY GROUPING SETS ((provider), ())")
def a8_plan_summary(spark, sf_dir):
    """States and exposure of a plan by provider, and of the whole."""
    return funnels.plan_summary(_stated_units(spark, sf_dir)[0])


@query(f"WITH {STATED_UNITS} SELECT provider, source, sum(usd) AS usd, count(DISTINCT c.unit_id) AS units, count(*) AS readings FROM c JOIN u USING (unit_id) WHERE status IN ('completed', 'failed') GROUP BY GROUPING SETS ((provider, source), (source))")
def a8_observed_costs(spark, sf_dir):
    """What was observed to be spent, by the source of the reading."""
    return funnels.observed_costs(*_stated_units(spark, sf_dir))


@query("SELECT CASE WHEN value < 5 THEN 'timeout' WHEN value < 20 THEN 'quota' ELSE 'other' END AS category, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def a9_failures(spark, sf_dir):
    category = F.when(F.col("value") < 5, "timeout").when(F.col("value") < 20, "quota").otherwise("other")
    return table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(category.alias("category")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT l_returnflag AS a, l_partkey AS k FROM lineitem GROUP BY 1, 2), n AS (SELECT a, count(*) AS n FROM p GROUP BY a), i AS (SELECT x.a, y.a AS b, count(*) AS common FROM p x JOIN p y USING (k) WHERE x.a < y.a GROUP BY 1, 2) SELECT i.a, i.b, common, round(common / n.n, 6) AS directional, round(common / (n.n + m.n - common), 6) AS jaccard FROM i JOIN n ON i.a = n.a JOIN n m ON i.b = m.a")
def a17_set_overlap(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("s"))  # at most three flags a part
    n = sets.select(F.explode("s").alias("a")).groupBy("a").agg(F.count("*").alias("n"))
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    m = n.select(F.col("a").alias("b"), F.col("n").alias("m"))
    return pairs.join(n, "a").join(m, "b").select("a", "b", "common", F.round(F.col("common") / F.col("n"), 6).alias("directional"), F.round(F.col("common") / (F.col("n") + F.col("m") - F.col("common")), 6).alias("jaccard"))


@query("WITH t AS (SELECT source, n_chars > 2000 AS p, quality = 1 AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p) AS pp, count(*) FILTER (WHERE y) AS yy FROM t GROUP BY source) SELECT source, round(tp / nullif(pp, 0), 6) AS precision, round(tp / nullif(yy, 0), 6) AS recall, round(2.0 * tp / nullif(pp + yy, 0), 6) AS f1 FROM c")
def a18_precision_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") > 2000).alias("p")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("y")), "doc_id")
    c = rows.groupBy("source").agg(F.count_if(F.col("p") & F.col("y")).alias("tp"), F.count_if("p").alias("pp"), F.count_if("y").alias("yy"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return c.select("source", ratio(F.col("tp"), F.col("pp")).alias("precision"), ratio(F.col("tp"), F.col("yy")).alias("recall"), ratio(F.lit(2.0) * F.col("tp"), F.col("pp") + F.col("yy")).alias("f1"))


@query("WITH t AS (SELECT l_suppkey AS board, l_partkey % 50 AS title, count(*) AS n, count(DISTINCT l_returnflag) AS span FROM lineitem GROUP BY 1, 2) SELECT board, count(*) AS titles, max(span) AS max_span, round(sum(n) FILTER (WHERE span > 1) / sum(n), 6) AS spanning_share, round(count(*) / sum(n), 6) AS collapse_ratio FROM t GROUP BY board")
def a19_board_hygiene(spark, sf_dir):
    titles = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("board"), (F.col("l_partkey") % 50).alias("title")).agg(F.count("*").alias("n"), F.size(F.collect_set("l_returnflag")).cast("long").alias("span"))
    return titles.groupBy("board").agg(F.count("*").alias("titles"), F.max("span").alias("max_span"), F.round(F.sum(F.when(F.col("span") > 1, F.col("n"))) / F.sum("n"), 6).alias("spanning_share"), F.round(F.count("*") / F.sum("n"), 6).alias("collapse_ratio"))


@query(R + " SELECT source, count(*) AS n, sum(score) AS total, min(score) AS low, quantile_cont(score, 0.5) AS median, max(score) AS high, quantile_disc(score, 0.95)::DOUBLE AS p95 FROM result GROUP BY source")
def a21_distributions(spark, sf_dir):
    return results(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.min("score").alias("low"), F.percentile("score", 0.5).alias("median"), F.max("score").alias("high"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY score)").alias("p95"))


@query(R + ", g AS (SELECT source, key, count(*) AS n, count(DISTINCT unit_id) AS ids FROM result GROUP BY 1, 2) SELECT source, sum(n) AS rows, sum(n) - count(*) AS collapsed, count(*) FILTER (WHERE ids > 1) AS several_ids, round((sum(n) - count(*)) / sum(n), 6) AS ratio FROM g GROUP BY source")
def a24_collapsed(spark, sf_dir):
    g = results(spark, sf_dir).groupBy("source", "key").agg(F.count("*").alias("n"), (F.min("unit_id") < F.max("unit_id")).alias("several"))
    return g.groupBy("source").agg(F.sum("n").alias("rows"), (F.sum("n") - F.count("*")).alias("collapsed"), F.count_if("several").alias("several_ids"), F.round((F.sum("n") - F.count("*")) / F.sum("n"), 6).alias("ratio"))


@query(B + " SELECT keyword, place, count(*) AS n, avg(score) AS mean, round(count(*) FILTER (WHERE position > 1) / count(*), 6) AS filled FROM result JOIN plan USING (unit_id) GROUP BY GROUPING SETS ((keyword), (place))")
def a25_rollup(spark, sf_dir):
    rows = results(spark, sf_dir).select("unit_id", "score", "position").join(plan_units(spark, sf_dir).select("unit_id", "keyword", "place"), "unit_id")
    return rows.groupingSets([["keyword"], ["place"]], "keyword", "place").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.round(F.count_if(F.col("position") > 1) / F.count("*"), 6).alias("filled"))


@query("WITH p AS (SELECT source AS title, CASE WHEN doc_id % 4 > 0 THEN lang ELSE ' ' END AS company, CASE WHEN doc_id % 7 > 0 THEN 'x' END AS salary, text AS description FROM documents), f AS (SELECT unnest(['title', 'company', 'salary', 'description']) AS field, unnest([title, company, salary, description]) AS v FROM p) SELECT field, round(100 * count(*) FILTER (WHERE trim(coalesce(v, '')) <> '') / greatest(1, count(*)), 1) AS percent FROM f GROUP BY field")
def a25_completeness(spark, sf_dir):
    """How many of the rows state each field, in percent."""
    key = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("title"), F.when(key % 4 > 0, F.col("lang")).otherwise(" ").alias("company"), F.when(key % 7 > 0, "x").alias("salary"), F.col("text").alias("description"))
    return audits.completeness(rows, ("title", "company", "salary", "description"))


@query(B + " SELECT keyword, count(*) AS n, min(score) AS low, quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS p75, max(score) AS high, round(avg(score), 6) AS mean FROM result JOIN plan USING (unit_id) GROUP BY keyword")
def a25_score_distribution(spark, sf_dir):
    """How the scores of each keyword's rows are spread."""
    rows = results(spark, sf_dir).select("unit_id", "score").join(plan_units(spark, sf_dir).select("unit_id", "keyword"), "unit_id")
    at = lambda p, name: F.percentile("score", p).alias(name)
    return rows.groupBy("keyword").agg(F.count("*").alias("n"), F.min("score").alias("low"), at(0.25, "p25"), at(0.5, "median"), at(0.75, "p75"), F.max("score").alias("high"), F.round(F.avg("score"), 6).alias("mean"))


SPANS = "s AS (SELECT user_id, floor(epoch(ts) / 60)::BIGINT AS lo, floor(epoch(ts) / 60)::BIGINT + floor(value * 10)::BIGINT AS hi FROM events)"
ISLANDS = "m AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY user_id ORDER BY lo, hi) = 1 THEN 1 ELSE 0 END AS fresh FROM s WHERE lo < hi), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m), l AS (SELECT user_id, island, max(hi) - min(lo) AS len FROM i GROUP BY 1, 2)"


def _spans(spark, sf_dir):
    minute = F.floor(F.unix_timestamp("ts") / 60)
    return table(spark, sf_dir, "events").select("user_id", minute.alias("lo"), (minute + F.floor(F.col("value") * 10)).alias("hi"))


@query(f"WITH {SPANS}, {ISLANDS} SELECT user_id, sum(len) AS length, count(*) AS islands FROM l GROUP BY user_id")
def a26_interval_union(spark, sf_dir):
    return funnels.islands(_spans(spark, sf_dir), ["user_id"], "lo", "hi")


@query(f"WITH {SPANS.replace('user_id, floor(epoch', 'event_type AS user_id, floor(epoch').replace('value * 10', 'value * 0.2')}, {ISLANDS} SELECT user_id AS event_type, sum(len) AS busy FROM l GROUP BY 1")
def a27_busy_time(spark, sf_dir):
    minute = F.floor(F.unix_timestamp("ts") / 60)
    spans = table(spark, sf_dir, "events").select("event_type", minute.alias("lo"), (minute + F.floor(F.col("value") * 0.2)).alias("hi"))
    return funnels.islands(spans, ["event_type"], "lo", "hi", hot=True).select("event_type", F.col("length").alias("busy"))


RATES = {"1-URGENT": 0.05, "2-HIGH": 0.04, "3-MEDIUM": 0.03}


@query(P + f", r(provider, rate) AS (VALUES {', '.join(map(str, RATES.items()))}) SELECT provider, count(*) AS searches, round(count(*) * rate::DOUBLE, 6) AS cost, sum(ceiling) AS bounded FROM plan LEFT JOIN r USING (provider) GROUP BY provider, rate")
def a28_plan_cost(spark, sf_dir):
    rates = spark.createDataFrame(list(RATES.items()), "provider string, rate double")
    units = plan_units(spark, sf_dir).groupBy("provider").agg(F.count("*").alias("searches"), F.sum("ceiling").alias("bounded"))
    return units.join(F.broadcast(rates), "provider", "left").select("provider", "searches", F.round(F.col("searches") * F.col("rate"), 6).alias("cost"), "bounded")


@query("SELECT c_custkey % 20 AS tile, count(*) AS planned, count(o.k) AS done, count(*) - count(o.k) AS remaining FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o.k GROUP BY 1")
def a29_run_progress(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("k")).distinct()
    plan = table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left")
    return plan.groupBy((F.col("c_custkey") % 20).alias("tile")).agg(F.count("*").alias("planned"), F.count("k").alias("done"), (F.count("*") - F.count("k")).alias("remaining"))


@query(f"WITH {SPANS}, e AS (SELECT user_id, lo AS moment, 1 AS step FROM s UNION ALL SELECT user_id, hi, -1 FROM s), o AS (SELECT user_id, sum(step) OVER (PARTITION BY user_id ORDER BY moment, step ROWS UNBOUNDED PRECEDING) AS open FROM e) SELECT user_id, max(open) AS peak FROM o GROUP BY user_id")
def a32_peak_concurrency(spark, sf_dir):
    return funnels.peak_overlap(_spans(spark, sf_dir), ["user_id"], "lo", "hi")


#: Order lines as what two systems read in documents (orders), by group (return flag), beside the truth.
TOLD = "cells AS (SELECT DISTINCT l_orderkey AS doc, l_returnflag AS grp FROM lineitem), v AS (SELECT l_orderkey AS doc, l_returnflag AS grp, l_partkey AS value, l_discount > 0.01 AS t, CASE WHEN l_orderkey % 3 = 0 THEN l_discount > 0.01 ELSE l_quantity > 10 END AS a, CASE WHEN l_orderkey % 3 = 1 THEN l_quantity > 10 WHEN l_orderkey % 3 = 0 THEN l_quantity > 20 ELSE l_discount > 0.01 END AS b FROM lineitem), x AS (SELECT doc, grp, value, bool_or(t) AS t, bool_or(a) AS a, bool_or(b) AS b FROM v GROUP BY 1, 2, 3), k AS (SELECT doc, grp, bool_and(t = a) AS a_ok, bool_and(t = b) AS b_ok, bool_and(a = b) AS same FROM x GROUP BY 1, 2), c AS (SELECT doc, grp, CASE WHEN doc % 13 > 0 THEN a_ok END AS a_ok, CASE WHEN doc % 13 > 0 THEN b_ok END AS b_ok, CASE WHEN doc % 13 = 0 THEN 'unscorable' WHEN a_ok AND b_ok THEN 'both correct' WHEN a_ok THEN 'a correct / b wrong' WHEN b_ok THEN 'a wrong / b correct' WHEN same THEN 'both wrong, same way' ELSE 'both wrong, differently' END AS category FROM k)"
DRIVING = ("A", "R")


def _verdicts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("grp"), F.concat(F.lit(" P "), F.col("l_partkey")).alias("value"), "l_discount", "l_quantity")
    right, large, third = F.col("l_discount") > 0.01, F.col("l_quantity") > 10, F.col("doc") % 3
    a = lines.where(F.when(third == 0, right).otherwise(large)).withColumn("value", F.lower("value"))
    b = lines.where(F.when(third == 1, large).when(third == 0, F.col("l_quantity") > 20).otherwise(right)).withColumn("value", F.replace("value", F.lit(" P "), F.lit("p  ")))
    return comparison.aligned(lines.select("doc", "grp").distinct(), lines.where(right), a, b, lines.where("doc % 13 = 0").select("doc"))


@query(f"WITH {TOLD} SELECT grp, category, count(*) AS n FROM c GROUP BY 1, 2")
def a33_two_systems(spark, sf_dir):
    """What two systems read against the truth, by group: both right, one, or both wrong in the same way or not."""
    return comparison.by_group(_verdicts(spark, sf_dir))


@query(f"WITH {TOLD}, d AS (SELECT doc, bool_and(a_ok) AS a, bool_and(b_ok) AS b, count(*) FILTER (WHERE a_ok AND NOT b_ok) AS worse, count(*) FILTER (WHERE a_ok) AS na, count(*) FILTER (WHERE b_ok) AS nb FROM c WHERE grp IN {DRIVING} AND a_ok IS NOT NULL GROUP BY 1) SELECT count(*) AS documents, count(*) FILTER (WHERE a) AS a_correct, count(*) FILTER (WHERE b) AS b_correct, count(*) FILTER (WHERE a AND b) AS both_correct, count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE b AND NOT a) AS b_only, count(*) FILTER (WHERE NOT a AND NOT b) AS neither, sum(worse) AS regressions, sum(nb) >= sum(na) AND sum(worse) = 0 AS qualifies FROM d")
def a33_totals(spark, sf_dir):
    """How many documents each system has right in all groups that count, and whether the second may replace the first."""
    return comparison.totals(_verdicts(spark, sf_dir), DRIVING)


@query(f"WITH {TOLD} SELECT doc, grp FROM c WHERE grp IN {DRIVING} AND category = 'a correct / b wrong'")
def a33_regressions(spark, sf_dir):
    """Where the first system is right and the second is not."""
    return comparison.regressions(_verdicts(spark, sf_dir), DRIVING)


@query(P + " SELECT provider, sum(ceiling) FILTER (WHERE status <> 'F') AS remaining, min(ceiling) FILTER (WHERE ceiling > 0) AS cheapest FROM plan GROUP BY provider")
def a35_outstanding(spark, sf_dir):
    c = F.col("ceiling")
    return plan_units(spark, sf_dir).groupBy("provider").agg(F.sum(F.when(F.col("status") != "F", c)).alias("remaining"), F.min(F.when(c > 0, c)).alias("cheapest"))


@query(R + " SELECT source, key, max(score) AS score, max_by(arrival, (score, -arrival)) AS arrival FROM result GROUP BY 1, 2")
def a36_history(spark, sf_dir):
    return results(spark, sf_dir).groupBy("source", "key").agg(F.max("score").alias("score"), F.max_by("arrival", F.struct(F.col("score"), -F.col("arrival"))).alias("arrival"))


# ---- inventories -----------------------------------------------------------------------------------------------------------------


#: Order lines as candidates (R) and production (A): some without a key or an identifier of their own.
STOCK = "l AS (SELECT 'b' || (l_suppkey % 5) AS board, 'p' || (l_suppkey % 4) AS provider, CASE WHEN l_partkey % 17 > 0 THEN l_partkey || '-' || (l_suppkey % 3) END AS key, CASE WHEN l_linenumber > 1 THEN 'n' || (l_orderkey % 500) END AS native, l_returnflag AS f FROM lineitem), c AS (SELECT * FROM l WHERE f = 'R'), p AS (SELECT DISTINCT provider, key, native FROM l WHERE f = 'A')"


@query(f"WITH {STOCK}, m AS (SELECT c.*, c.key IN (SELECT key FROM p WHERE key IS NOT NULL) AS k, EXISTS (FROM p WHERE p.key = c.key AND p.provider = c.provider AND p.native = c.native) AS same, c.native IS NOT NULL AND EXISTS (FROM p WHERE p.key = c.key AND p.provider = c.provider AND p.native IS NOT NULL) AS rival, EXISTS (FROM p WHERE p.provider = c.provider AND p.native = c.native) AS n FROM c) SELECT board, count(*) AS gated, count(*) FILTER (WHERE key IS NULL) AS unkeyed, count(native) AS native_id, count(*) FILTER (WHERE k) AS key_overlap, count(*) FILTER (WHERE k AND same) AS key_and_native, count(*) FILTER (WHERE k AND NOT same AND rival) AS key_native_distinct, count(*) FILTER (WHERE k AND NOT same AND NOT rival) AS key_not_comparable, count(*) FILTER (WHERE n) AS native_overlap, count(*) FILTER (WHERE n AND NOT same) AS native_key_distinct, count(DISTINCT key) AS source_unique FROM m GROUP BY board")
def d12_inventory_overlap(spark, sf_dir):
    """What each board shares with production by key and by native identity, and where the two disagree or can't be compared."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("b"), F.col("l_suppkey") % 5).alias("board"), F.concat(F.lit("p"), F.col("l_suppkey") % 4).alias("provider"), F.when(F.col("l_partkey") % 17 > 0, F.concat_ws("-", "l_partkey", F.col("l_suppkey") % 3)).alias("key"),
        F.when(F.col("l_linenumber") > 1, F.concat(F.lit("n"), F.col("l_orderkey") % 500)).alias("native"), "l_returnflag")
    return inventories.overlap(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"))


@query(R + ", b AS (SELECT CASE WHEN position < 7 THEN key ELSE 'row 0 ' || arrival END AS key, score, arrival, 0 AS side, NULL AS board FROM result WHERE source = 'A' UNION ALL SELECT CASE WHEN position < 7 THEN key ELSE 'row 1 ' || arrival END, score - 3, arrival, 1, 'b' || (unit_id % 4) FROM result WHERE source = 'R'), k AS (SELECT key, max_by(board, (score, -side, -arrival)) AS board, max_by(side, (score, -side, -arrival)) AS side, max((score, -side, -arrival)) AS v, max(score) AS score, min(side) = 0 AS base FROM b GROUP BY key), r AS (SELECT *, row_number() OVER (ORDER BY v DESC) AS rank FROM k) SELECT board, count(*) FILTER (WHERE NOT base) AS final_new, count(*) FILTER (WHERE NOT base AND score > 0) AS final_new_positive, count(*) FILTER (WHERE NOT base AND rank <= 500) AS top_n_new, count(*) FILTER (WHERE base) AS final_replaces, count(*) FILTER (WHERE base AND rank <= 500) AS top_n_replaces, min(rank) FILTER (WHERE NOT base) AS best_new_rank FROM r WHERE side = 1 GROUP BY board")
def d13_usefulness(spark, sf_dir):
    """What candidate boards would add to a result, and where in it their first new key would stand."""
    rows = results(spark, sf_dir).withColumn("key", F.when(F.col("position") < 7, F.col("key")))
    found = rows.where("source = 'R'").select("key", (F.col("score") - 3).alias("score"), "arrival", F.concat(F.lit("b"), F.col("unit_id") % 4).alias("board"))
    return inventories.usefulness(rows.where("source = 'A'"), found, 500)


@query("SELECT CASE WHEN a AND r THEN 'both' WHEN a THEN 'already-free' ELSE 'paid-only' END AS part, count(*) AS companies, sum(n) AS rows FROM (SELECT l_suppkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS r, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def d14_company_split(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"))
    return rows.groupBy(F.when(F.col("a") & F.col("r"), "both").when(F.col("a"), "already-free").otherwise("paid-only").alias("part")).agg(F.count("*").alias("companies"), F.sum("n").alias("rows"))


@query("SELECT user_id, max_by(event_id, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END * value, -event_id)) AS best FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' GROUP BY user_id")
def d15_rescore(spark, sf_dir):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").where((F.col("ts") >= at("2024-01-03")) & (F.col("ts") < at("2024-01-10")))
    score = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1) * F.col("value")
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct(score, -F.col("event_id"))).alias("best"))


@query("SELECT DISTINCT p_brand FROM part WHERE p_type = 'PROMO' AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)")
def d17_clashes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where("p_type = 'PROMO'").select("p_brand").distinct().join(part.where("p_size > 48").select("p_brand").distinct(), "p_brand", "left_anti")


@query(B + ", u AS (SELECT unit_id, keyword, place, list(DISTINCT key) AS keys FROM plan JOIN result USING (unit_id) GROUP BY ALL) SELECT a.unit_id AS remote, b.unit_id AS twin, len(list_intersect(a.keys, b.keys)) AS shared FROM u a JOIN u b ON a.keyword = b.keyword AND a.place = 0 AND b.place <> 0 AND b.unit_id < a.unit_id")
def d18_twins(spark, sf_dir):
    keys = results(spark, sf_dir).groupBy("unit_id").agg(F.collect_set("key").alias("keys"))
    units = plan_units(spark, sf_dir).select("unit_id", "keyword", "place").join(keys, "unit_id")
    return overlap.twins(units.where("place = 0"), units.where("place <> 0"))


#: Parts as searches: sites, keywords, places of markets, with and without remote.
SEARCHES = "s AS (SELECT p_partkey AS id, 'site' || p_size % 2 AS site, CASE p_size % 4 WHEN 0 THEN p_name || ' developer' WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN p_name ELSE split_part(p_name, ' ', 1) || ' engineer' END AS keyword, '' AS company, p_partkey % 9 AS place, CASE WHEN p_partkey % 9 < 7 THEN p_partkey % 9 % 3 END AS market, p_partkey % 5 = 0 AS remote FROM part UNION ALL SELECT -1 - n_nationkey, 'site0', 'Developer', '', n_nationkey % 9, 0, false FROM nation WHERE n_nationkey < 4)"
BARE = "list_filter(string_split(lower(keyword), ' '), lambda x: x NOT IN ('developer', 'engineer'))"


@query(f"WITH {SEARCHES}, w AS (SELECT *, {BARE} AS w FROM s), p AS (SELECT a.site, a.company, a.place AS pa, b.place AS pb, a.market, a.market IS NOT DISTINCT FROM b.market AS same, a.keyword AS ka, b.keyword AS kb, a.remote <> b.remote AS apart, len(list_intersect(a.w, b.w)) AS common, len(a.w) AS na, len(b.w) AS nb FROM w a JOIN w b ON a.site = b.site AND a.company = b.company AND a.id < b.id), o AS (SELECT 'structural' AS kind, site, company, market::VARCHAR AS place, ka AS a, ka AS b FROM p WHERE ka = kb AND pa <> pb AND same AND market IS NOT NULL UNION ALL SELECT 'remote', site, company, pa::VARCHAR, ka, ka FROM p WHERE ka = kb AND pa = pb AND apart UNION ALL SELECT 'nested', site, company, pa::VARCHAR, CASE WHEN na < nb OR na = nb AND ka < kb THEN ka ELSE kb END, CASE WHEN na < nb OR na = nb AND ka < kb THEN kb ELSE ka END FROM p WHERE ka <> kb AND pa = pb AND common = least(na, nb)) SELECT kind, site, company, place, a, b, count(*) AS pairs FROM o GROUP BY ALL")
def d19_plan_overlap(spark, sf_dir):
    """Searches that may bring the same rows, of three kinds, with the number of their pairs."""
    part, size, key = table(spark, sf_dir, "part"), F.col("p_size"), F.col("p_partkey")
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    keyword = F.when(size % 4 == 0, F.concat("p_name", F.lit(" developer"))).when(size % 4 == 1, word(2)).when(size % 4 == 2, F.col("p_name")).otherwise(F.concat(word(1), F.lit(" engineer")))
    searches = part.select(F.concat(F.lit("site"), size % 2).alias("site"), keyword.alias("keyword"), F.lit("").alias("company"), (key % 9).cast("string").alias("place"), F.when(key % 9 < 7, key % 9 % 3).cast("string").alias("market"), (key % 5 == 0).alias("remote"))
    plain = table(spark, sf_dir, "nation").where("n_nationkey < 4").select(F.lit("site0").alias("site"), F.lit("Developer").alias("keyword"), F.lit("").alias("company"), (F.col("n_nationkey") % 9).cast("string").alias("place"), F.lit("0").alias("market"), F.lit(False).alias("remote"))
    return overlap.plan_overlap(searches.union(plain))


# ---- plan order --------------------------------------------------------------------------------------------------------------------

GAIN = "g AS (SELECT p.provider, p.plan_index, coalesce(sum((score >= 45)::INT), 0)::BIGINT AS gain FROM plan p LEFT JOIN result r USING (unit_id) GROUP BY ALL)"


def _gains(spark, sf_dir):
    gain = results(spark, sf_dir).groupBy("unit_id").agg(F.count_if(F.col("score") >= 45).alias("gain"))
    return plan_units(spark, sf_dir).select("unit_id", "provider", "plan_index").join(gain, "unit_id", "left").select("provider", "plan_index", F.coalesce("gain", F.lit(0)).alias("gain"))


STREAK = "r AS (SELECT *, sum((gain > 0)::INT) OVER (PARTITION BY provider ORDER BY plan_index ROWS UNBOUNDED PRECEDING) AS run FROM g), s AS (SELECT provider, plan_index, CASE WHEN gain > 0 THEN 0 ELSE sum((gain = 0)::INT) OVER (PARTITION BY provider, run ORDER BY plan_index ROWS UNBOUNDED PRECEDING) END AS streak FROM r)"


@query(B + f", {GAIN}, {STREAK} SELECT * FROM s")
def w4_streaks(spark, sf_dir):
    return funnels.streaks(_gains(spark, sf_dir), ["provider"], "plan_index", "gain").select("provider", "plan_index", "streak")


#: Searches of a month and a provider as units of a plan, and what they brought; lines flagged A are free.
UNITS = "o AS (SELECT o_orderkey, o_orderpriority AS provider, (year(o_orderdate) * 12 + month(o_orderdate)) * 5 + ascii(o_orderpriority) AS unit_id, o_totalprice::DECIMAL(18,2) AS ceiling FROM orders WHERE o_orderdate IS NOT NULL), u AS (SELECT unit_id, unit_id AS plan_index, provider, sum(ceiling)::DECIMAL(28,2) AS ceiling FROM o GROUP BY 1, 2, 3), b AS (SELECT r.key, CASE WHEN source <> 'A' THEN o.unit_id END AS unit_id, score, arrival, position, CASE WHEN source <> 'A' THEN provider END AS provider FROM result r JOIN o ON r.unit_id = o_orderkey)"
TOP, DEPTH = 20, 6


def _bought(spark, sf_dir):
    """(rows, units) of UNITS."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL").select("o_orderkey", F.col("o_orderpriority").alias("provider"), ((F.year("o_orderdate") * 12 + F.month("o_orderdate")) * 5 + F.ascii("o_orderpriority")).cast("long").alias("search"), F.col("o_totalprice").cast("decimal(18,2)").alias("ceiling"))
    units = orders.groupBy(F.col("search").alias("unit_id"), F.col("search").alias("plan_index"), "provider").agg(F.sum("ceiling").alias("ceiling"))
    # Keys and arrivals, which repeat what a line has in other columns, are made behind the join, so its shuffle doesn't carry them.
    rows = results_of(table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "search"), "l_orderkey"), "search")
    return rows.select("key", F.when(F.col("source") != "A", F.col("search")).alias("unit_id"), "score", "arrival", "position"), units


#: The state after each step: what stands in the top, with the rank and the first unit of each key.
STEPS = f"p AS (SELECT key, unit_id, score, arrival FROM b WHERE unit_id IS NOT NULL), born AS (SELECT key, min(unit_id) AS born FROM p GROUP BY key), best AS (SELECT u.unit_id AS step, key, max((score, -arrival)) AS v FROM u JOIN p ON p.unit_id <= u.unit_id GROUP BY 1, 2), t AS (SELECT step, key, row_number() OVER (PARTITION BY step ORDER BY v DESC) AS i FROM best QUALIFY i <= {TOP}), s AS (SELECT unit_id AS step, lag(unit_id) OVER (ORDER BY unit_id) AS was FROM u)"


@query(B + f", {UNITS}, {STEPS}, c AS (SELECT s.step, n.key, n.i, o.i AS old, born FROM s JOIN t n ON n.step = s.step JOIN born ON born.key = n.key LEFT JOIN t o ON o.step = s.was AND o.key = n.key), g AS (SELECT s.step, count(*) AS displaced FROM s JOIN t o ON o.step = s.was WHERE NOT EXISTS (FROM t n WHERE n.step = s.step AND n.key = o.key) GROUP BY 1), raw AS (SELECT unit_id, count(*) AS raw, count(*) FILTER (WHERE score >= 25) AS eligible, count(DISTINCT key) FILTER (WHERE born = unit_id) AS fresh FROM p JOIN born USING (key) GROUP BY 1) SELECT u.unit_id, coalesce(any_value(raw), 0) AS raw, coalesce(any_value(eligible), 0) AS eligible, coalesce(any_value(fresh), 0) AS fresh, count(c.key) FILTER (WHERE old IS NULL) AS entered, coalesce(any_value(displaced), 0) AS displaced, count(c.key) FILTER (WHERE old <> i) AS moved, count(c.key) FILTER (WHERE old IS NULL AND born = c.step) AS entered_new FROM u LEFT JOIN c ON c.step = unit_id LEFT JOIN g ON g.step = unit_id LEFT JOIN raw ON raw.unit_id = u.unit_id GROUP BY u.unit_id")
def w5_observations(spark, sf_dir):
    """What each step of the plan brought, and what it changed in the top of all steps up to it."""
    rows, units = _bought(spark, sf_dir)
    rows = rows.where("unit_id IS NOT NULL")
    first = rows.groupBy("key").agg(F.min("unit_id").alias("first"))
    new = first.groupBy(F.col("first").alias("unit_id")).agg(F.count("*").alias("fresh"))
    brought = rows.groupBy("unit_id").agg(F.count("*").alias("raw"), F.count_if(F.col("score") >= 25).alias("eligible")).join(new, "unit_id", "left")
    steps = counterfactuals.steps_of_top(rows.withColumnRenamed("unit_id", "step"), units.select(F.col("unit_id").alias("step")), [], TOP)
    steps = steps.select(F.col("step").cast("long").alias("unit_id"), "entered", "displaced", "moved", "entered_new")
    return steps.join(brought, "unit_id", "left").select("unit_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "eligible", "fresh")), "entered", "displaced", "moved", "entered_new")


STEPPED = "t AS (SELECT o_orderkey AS plan_index, o_orderpriority AS provider, o_custkey % 4 = 0 AS remote, coalesce(count(*) FILTER (WHERE l_quantity >= 45), 0) AS marginal, coalesce(count(*) FILTER (WHERE l_quantity >= 48), 0) AS entered FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3)"
_RUNS = "CASE WHEN {c} > 0 THEN 0 ELSE plan_index_no - coalesce(max(CASE WHEN {c} > 0 THEN plan_index_no END) OVER ({by}ORDER BY plan_index ROWS UNBOUNDED PRECEDING), 0) END"
LENGTHS, REMOTE = (3, 5, 8), (1, 4)


@query(f"WITH {STEPPED}, n AS (SELECT *, row_number() OVER (ORDER BY plan_index) AS plan_index_no, row_number() OVER (PARTITION BY provider ORDER BY plan_index) AS own_no FROM t), s AS (SELECT 'marginal_streak' AS policy, 'all' AS scope, 'stop' AS action, plan_index, {_RUNS.format(c='marginal', by='')} AS evidence FROM n UNION ALL SELECT 'top_stable', 'all', 'stop', plan_index, {_RUNS.format(c='entered', by='')} FROM n UNION ALL SELECT 'provider_marginal_streak', provider, 'skip', plan_index, {_RUNS.format(c='marginal', by='PARTITION BY provider ').replace('plan_index_no', 'own_no')} FROM n UNION ALL SELECT 'remote_after_places', provider, 'skip remote', plan_index, sum((remote AND marginal = 0)::INT) OVER (PARTITION BY provider ORDER BY plan_index ROWS UNBOUNDED PRECEDING) FROM n), c(policy, n) AS (VALUES {', '.join(f'({chr(39)}{p}{chr(39)}, {n})' for p, ns in (('marginal_streak', LENGTHS), ('top_stable', LENGTHS), ('provider_marginal_streak', LENGTHS), ('remote_after_places', REMOTE)) for n in ns)}) SELECT policy, n, scope, action, plan_index, evidence FROM s JOIN c USING (policy) WHERE evidence >= n QUALIFY row_number() OVER (PARTITION BY policy, n, scope ORDER BY plan_index) = 1")
def w6_stop_policies(spark, sf_dir):
    """Where policies would first have stopped a plan or skipped a provider, each once for its scope."""
    gain = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plan_index")).agg(F.count_if(F.col("l_quantity") >= 45).alias("marginal"), F.count_if(F.col("l_quantity") >= 48).alias("entered"))
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_index"), F.col("o_orderpriority").alias("provider"), (F.col("o_orderstatus") != "P").alias("completed"), (F.col("o_custkey") % 4 == 0).alias("remote"))
    return inventories.policies(steps.join(gain, "plan_index", "left").na.fill(0, ["marginal", "entered"]), LENGTHS, REMOTE)


FULL = "whole AS (SELECT key, row_number() OVER (ORDER BY max((score, -arrival)) DESC) AS rank, count(DISTINCT unit_id) = 1 AND count(*) = count(unit_id) AS alone FROM b GROUP BY key)"
#: For each scenario and key the best row that is left (v), ranked anew; then what is lost.
LOSS = f"again AS (SELECT *, row_number() OVER (PARTITION BY scenario, unit_id, provider, depth ORDER BY v DESC) AS i FROM left_over), loss AS (SELECT k.scenario, k.unit_id, k.provider, k.depth, count(*) FILTER (WHERE i IS NULL) AS lost, count(*) FILTER (WHERE i IS NULL AND alone) AS marginal_lost, count(*) FILTER (WHERE rank <= {TOP} AND (i IS NULL OR i > {TOP})) AS top_lost, min(rank) FILTER (WHERE i IS NULL) AS best_lost_rank FROM (SELECT * FROM cases, whole) k LEFT JOIN again a ON a.key = k.key AND a.scenario = k.scenario AND a.unit_id IS NOT DISTINCT FROM k.unit_id AND a.provider IS NOT DISTINCT FROM k.provider AND a.depth IS NOT DISTINCT FROM k.depth GROUP BY ALL)"


@query(B + f", {UNITS}, w AS (SELECT *, max_by(arrival, (score, -arrival)) OVER (PARTITION BY key) AS top, max_by(coalesce(unit_id, -1), (score, -arrival)) OVER (PARTITION BY key) AS winner, count(*) OVER (PARTITION BY key) = count(unit_id) OVER (PARTITION BY key) AND min(unit_id) OVER (PARTITION BY key) = max(unit_id) OVER (PARTITION BY key) AS alone FROM b) SELECT provider, CASE WHEN arrival = top THEN 'kept' WHEN winner = -1 THEN 'free' WHEN winner = unit_id THEN 'same_unit' ELSE 'other_paid' END AS outcome, arrival = top AND alone AS marginal, count(*) AS n FROM w WHERE unit_id IS NOT NULL GROUP BY ALL")
def a4_dedupe_outcome(spark, sf_dir):
    """What became of every paid row: kept, or lost to a free source, its own unit or another."""
    rows, units = _bought(spark, sf_dir)
    found = inventories.outcomes(rows).groupBy("unit_id", "outcome", "marginal").agg(F.count("*").alias("n"))
    return found.join(units.select("unit_id", "provider"), "unit_id").groupBy("provider", "outcome", "marginal").agg(F.sum("n").alias("n"))


@query(B + f", {UNITS}, {FULL}, cases AS (SELECT DISTINCT 'x' AS scenario, 0 AS unit_id, provider, 0 AS depth FROM u), left_over AS (SELECT scenario, c.unit_id, c.provider, depth, key, max((score, -arrival)) AS v FROM cases c JOIN b ON b.provider IS DISTINCT FROM c.provider GROUP BY ALL), {LOSS} SELECT provider, lost, marginal_lost, top_lost, best_lost_rank FROM loss")
def w7_counterfactual(spark, sf_dir):
    """What the result lacks without each provider alone."""
    rows, units = _bought(spark, sf_dir)
    named = rows.join(units.select("unit_id", "provider"), "unit_id", "left")
    return counterfactuals.skipped(named, TOP, "provider")


@query(B + f", {UNITS}, {FULL}, cases AS (SELECT 'stop-after' AS scenario, unit_id, provider, NULL::INT AS depth, plan_index FROM u UNION ALL SELECT 'skip-alone', unit_id, provider, NULL, plan_index FROM u UNION ALL SELECT 'depth', NULL, provider, depth, NULL FROM (SELECT DISTINCT provider FROM u), (SELECT unnest(range(1, {DEPTH + 1}))::INT AS depth)), left_over AS (SELECT scenario, c.unit_id, c.provider, depth, key, max((score, -arrival)) AS v FROM cases c JOIN b ON CASE scenario WHEN 'stop-after' THEN coalesce(b.unit_id <= c.unit_id, true) WHEN 'skip-alone' THEN b.unit_id IS DISTINCT FROM c.unit_id ELSE b.provider IS DISTINCT FROM c.provider OR position <= depth END GROUP BY ALL), {LOSS} SELECT loss.*, CASE scenario WHEN 'stop-after' THEN (SELECT coalesce(sum(ceiling), 0) FROM u WHERE u.unit_id > loss.unit_id) WHEN 'skip-alone' THEN (SELECT sum(ceiling) FROM u WHERE u.unit_id = loss.unit_id) ELSE 0 END AS exposure_avoided FROM loss")
def w8_depth_report(spark, sf_dir):
    """Every unit's stop-after and skip-alone, and every provider's depths: lost keys, top losses and exposure."""
    return counterfactuals.report(*_bought(spark, sf_dir), DEPTH, TOP)


@query(P + ", s AS (SELECT provider, plan_index, sum(ceiling) OVER (PARTITION BY provider ORDER BY plan_index ROWS UNBOUNDED PRECEDING) AS spent FROM plan) SELECT provider, plan_index, spent FROM s WHERE spent <= 5000000")
def w10_affordable_prefix(spark, sf_dir):
    return funnels.affordable_prefix(plan_units(spark, sf_dir), "provider", "plan_index", "ceiling", 5_000_000).select("provider", "plan_index", "spent")


@query("SELECT r_name, n_name, k, row_number() OVER (PARTITION BY r_name ORDER BY k, n_name) AS i FROM region JOIN nation ON n_regionkey = r_regionkey CROSS JOIN (SELECT unnest(range(0, 6)) AS k) QUALIFY i <= 20")
def w11_plan_product(spark, sf_dir):
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).withColumn("k", F.col("k").cast("long"))
    return places.withColumn("i", F.row_number().over(Window.partitionBy("r_name").orderBy("k", "n_name")).cast("long")).where("i <= 20")


@query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts::DATE = DATE '2024-01-05')")
def t5_resume_ledger(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = events.where(F.to_date("ts") == F.lit("2024-01-05").cast("date")).select("user_id").distinct()
    return events.groupBy("user_id").agg(F.count("*").alias("n")).join(done, "user_id", "left_anti")


@query(ctes("posting") + " SELECT company, count(*) AS n, arg_max(arrival, (score, -arrival)) AS best FROM posting GROUP BY company")
def t6_plan_order(spark, sf_dir):
    """Arrival comes from the plan, so out-of-order results need no buffer: the order is part of the aggregate."""
    return postings(spark, sf_dir).groupBy("company").agg(F.count("*").alias("n"), F.max_by("arrival", F.struct(F.col("score"), -F.col("arrival"))).alias("best"))


# ---- audits by their whole rules -----------------------------------------------------------------------------------------------------

DRIFT = "d AS (SELECT year(o_orderdate) AS run, o_orderpriority AS ns, o_custkey % 40 AS id, CASE WHEN o_orderkey % 50 = 0 THEN 'url' ELSE 'ct' END AS kind, 'c' || (o_custkey % 2 + (o_orderkey % 31 = 0)::INT) AS company, o_orderstatus AS title FROM orders WHERE o_orderkey % 3 > 0 OR o_custkey % 40 < 10)"


@query(f"WITH {DRIFT}, i AS (SELECT ns, id, count(DISTINCT run) > 1 AS recurs, count(DISTINCT (kind, company, title)) > 1 AS drifts, bool_or(kind <> 'ct') AS other, count(DISTINCT company) = 1 AS c1, count(DISTINCT title) = 1 AS t1, (SELECT count(DISTINCT ns) FROM d e WHERE e.id = d.id) > 1 AS shared FROM d GROUP BY ns, id), w AS (SELECT ns, count(*) FILTER (WHERE n > 1) AS within_run FROM (SELECT ns, id, run, count(DISTINCT (kind, company, title)) AS n FROM d GROUP BY ALL) GROUP BY ns), k AS (SELECT ns, count(*) FILTER (WHERE n > 1) AS several_ids FROM (SELECT ns, kind, company, title, count(DISTINCT id) AS n FROM d GROUP BY ALL) GROUP BY ns) "
       "SELECT ns, count(*) AS native_ids, count(*) FILTER (WHERE recurs) AS recurring, count(*) FILTER (WHERE recurs AND drifts) AS drifted, count(*) FILTER (WHERE recurs AND drifts AND NOT other AND c1) AS by_title, count(*) FILTER (WHERE recurs AND drifts AND NOT other AND NOT c1 AND t1) AS by_company, count(*) FILTER (WHERE recurs AND drifts AND NOT other AND NOT c1 AND NOT t1) AS by_both, count(*) FILTER (WHERE recurs AND drifts AND other) AS by_kind, count(*) FILTER (WHERE shared) AS shared_ids, any_value(within_run) AS within_run, any_value(several_ids) AS several_ids FROM i JOIN w USING (ns) JOIN k USING (ns) GROUP BY ns")
def a22_drift_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0 OR o_custkey % 40 < 10")
    company = F.concat(F.lit("c"), F.col("o_custkey") % 2 + (F.col("o_orderkey") % 31 == 0).cast("int"))
    return audits.identity_drift(rows.select(F.year("o_orderdate").alias("run"), F.col("o_orderpriority").alias("ns"), (F.col("o_custkey") % 40).alias("id"), F.when(F.col("o_orderkey") % 50 == 0, "url").otherwise("ct").alias("kind"), company.alias("company"), F.col("o_orderstatus").alias("title")))


@query("WITH r AS (SELECT l_returnflag AS source, l_partkey || '-' || (l_suppkey % 3) AS key, l_suppkey AS url, CASE WHEN l_linenumber < 6 THEN l_shipdate::DATE END AS day FROM lineitem), b AS (SELECT DISTINCT key FROM r WHERE source = 'A'), c AS (SELECT source, key, count(DISTINCT url) > 1 AS collides FROM r GROUP BY 1, 2), k AS (SELECT source, count(*) FILTER (WHERE collides) AS collisions, count(*) FILTER (WHERE key NOT IN (SELECT key FROM b)) AS marginal FROM c GROUP BY source) "
       "SELECT source, count(*) AS rows, count(*) FILTER (WHERE DATE '1999-06-30' - day BETWEEN 0 AND 14) AS fresh14, count(*) FILTER (WHERE DATE '1999-06-30' - day BETWEEN 0 AND 21) AS fresh21, count(*) FILTER (WHERE day IS NULL) AS undated, count(*) FILTER (WHERE day > DATE '1999-06-30') AS future, any_value(collisions) AS collisions, any_value(marginal) AS marginal FROM r JOIN k USING (source) GROUP BY source")
def a20_snapshot_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.concat_ws("-", F.col("l_partkey"), F.col("l_suppkey") % 3).alias("key"), F.col("l_suppkey").alias("url"), F.when(F.col("l_linenumber") < 6, F.col("l_shipdate").cast("date")).alias("day"))
    return audits.snapshot(rows, rows.where("source = 'A'"), F.lit("1999-06-30").cast("date"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 100")
def w1_best_match(spark, sf_dir):
    from gristmill.operators import ranking

    rows = ranking.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, "o_totalprice", "o_orderkey")
    return rows.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 4 > 0 THEN p_size END NULLS LAST, p_retailprice DESC, p_partkey) AS place FROM part ORDER BY place LIMIT 100")
def w1_least_experience(spark, sf_dir):
    """Least experience first, unstated last, each tied by score; ranks are of the hundred rows that are left."""
    order = [F.asc_nulls_last("years"), F.desc("p_retailprice"), F.col("p_partkey")]
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.when(F.col("p_size") % 4 > 0, F.col("p_size")).alias("years")).orderBy(*order).limit(100)
    return rows.select("p_partkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


#: Endings of titles by part number, against the location they stand for.
TITLES = (("{n} - Berlin, Germany", "Berlin, Germany", "{n}"), ("{n} (Berlin)", "Berlin, Germany", "{n}"), ("{n} | Germany", "Berlin, Germany", "{n}"), ("{n}, Remote", "Paris", "{n}"), ("{n} in Rome", "Paris", "{n} in Rome"), ("{n} UK", "UK", "{n} UK"))


@query(f"SELECT p_partkey, replace(CASE p_partkey % {len(TITLES)} {' '.join(f'WHEN {k} THEN {chr(39)}{t[2]}{chr(39)}' for k, t in enumerate(TITLES))} END, '{{n}}', p_name) AS base FROM part")
def e24_own_location(spark, sf_dir):
    from gristmill.functions.text import base_title

    at = lambda k: F.get(F.array(*[F.lit(t[k]) for t in TITLES]), F.col("p_partkey") % len(TITLES))
    return table(spark, sf_dir, "part").select("p_partkey", base_title(F.replace(at(0), F.lit("{n}"), F.col("p_name")), at(1)).alias("base"))


@query(B + ", o AS (SELECT key, list(DISTINCT provider) AS origins, max(score) AS best FROM result JOIN plan USING (unit_id) GROUP BY key), t AS (SELECT key FROM o ORDER BY best DESC, key LIMIT 50), c(scenario, gone) AS (VALUES ('top two', ['1-URGENT', '2-HIGH']), ('third', ['3-MEDIUM']), ('four', ['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'])), x AS (SELECT scenario, key, best, len(list_filter(origins, lambda p: NOT list_contains(gone, p))) AS rest, len(origins) AS had FROM o CROSS JOIN c) SELECT scenario, count(*) FILTER (WHERE rest = 0) AS lost, count(*) AS keys, max(best) FILTER (WHERE rest = 0) AS best, count(*) FILTER (WHERE rest > 0 AND rest < had AND key IN (SELECT key FROM t)) AS at_risk FROM x GROUP BY scenario")
def w9_removals(spark, sf_dir):
    origins = results(spark, sf_dir).join(plan_units(spark, sf_dir).select("unit_id", "provider"), "unit_id").groupBy("key").agg(F.collect_set("provider").alias("origins"), F.max("score").alias("best"))
    return funnels.removal(origins, {"top two": ["1-URGENT", "2-HIGH"], "third": ["3-MEDIUM"], "four": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]}, 50)


@query(R + ", p AS (SELECT a.source, a.score AS a, b.score AS b FROM result a JOIN result b ON b.unit_id = a.unit_id + 1 AND a.position = b.position), m AS (SELECT source, v, count(*) FILTER (WHERE side = 1) AS na, count(*) FILTER (WHERE side = 2) AS nb FROM (SELECT source, a AS v, 1 AS side FROM p UNION ALL SELECT source, b, 2 FROM p) GROUP BY 1, 2), t AS (SELECT source, count(*) AS pairs, count(*) FILTER (WHERE a = b) AS equal FROM p GROUP BY 1) SELECT source, pairs, equal, round(sum(na * nb) / (pairs::DOUBLE * pairs), 6) AS chance FROM t JOIN m USING (source) GROUP BY source, pairs, equal")
def a34_agreement_and_chance(spark, sf_dir):
    """Agreement at equal positions beside what the two sequences' values alone would give: the product of their shares, summed."""
    rows = results(spark, sf_dir).select("unit_id", "position", "source", "score")
    pairs = rows.join(rows.select((F.col("unit_id") - 1).alias("unit_id"), "position", F.col("score").alias("other")), ["unit_id", "position"])
    values = pairs.select("source", F.explode(F.array(F.struct(F.col("score").alias("v"), F.lit(1).alias("side")), F.struct(F.col("other").alias("v"), F.lit(2).alias("side")))).alias("x")).select("source", "x.*")
    shares = values.groupBy("source", "v").agg(F.count_if(F.col("side") == 1).alias("na"), F.count_if(F.col("side") == 2).alias("nb")).groupBy("source").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("both"), F.sum("na").alias("pairs"))
    equal = pairs.groupBy("source").agg(F.count_if(F.col("score") == F.col("other")).alias("equal"))
    return shares.join(equal, "source").select("source", "pairs", "equal", F.round(F.col("both") / (F.col("pairs").cast("double") * F.col("pairs")), 6).alias("chance"))


@query(ctes("posting") + f", l AS (SELECT arrival, {{key}} AS now, CASE WHEN arrival % 10 = 0 THEN 'ct|old|' || arrival ELSE {{key}} END AS stored FROM posting) SELECT CASE WHEN now IS NULL THEN 'unkeyed' WHEN stored = now THEN 'same' ELSE 'changed' END AS verdict, count(*) AS n FROM l GROUP BY 1".replace("{key}", JOB_KEY))
def a23_recomputed_keys(spark, sf_dir):
    """Keys of a ledger against the keys that the stored company and title give today."""
    now = job_key("company", "title")
    rows = postings(spark, sf_dir).select("arrival", now.alias("now"), F.when(F.col("arrival") % 10 == 0, F.concat(F.lit("ct|old|"), F.col("arrival"))).otherwise(now).alias("stored"))
    return rows.groupBy(F.when(F.col("now").isNull(), "unkeyed").when(F.col("stored") == F.col("now"), "same").otherwise("changed").alias("verdict")).agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT s_suppkey, lower(trim(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS n, max(l_quantity) AS best FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL), known AS (SELECT lower(replace(s_name, '#', '')) AS token FROM supplier WHERE s_nationkey = 3), s AS (SELECT s_suppkey, best, unnest(list_distinct([replace(n, ' ', ''), replace(n, ' ', '-'), split_part(n, ' ', 1)])) AS slug FROM b) SELECT s_suppkey, slug, best FROM s WHERE s_suppkey NOT IN (SELECT s_suppkey FROM s WHERE slug IN (SELECT token FROM known))")
def d16_slug_candidates(spark, sf_dir):
    """Names under which an employer's board may stand, for employers none of whose names is known yet."""
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_quantity").alias("best"))
    supplier = table(spark, sf_dir, "supplier")
    name = F.trim(F.regexp_replace(F.lower("s_name"), "[^a-z0-9]+", " "))
    slugs = F.array_distinct(F.array(F.replace(name, F.lit(" "), F.lit("")), F.replace(name, F.lit(" "), F.lit("-")), F.split_part(name, F.lit(" "), F.lit(1))))
    rows = supplier.select("s_suppkey", F.explode(slugs).alias("slug"))
    known = supplier.where("s_nationkey = 3").select(F.lower(F.replace("s_name", F.lit("#"), F.lit(""))).alias("slug"))
    covered = rows.join(known, "slug", "left_semi").select("s_suppkey").distinct()
    return rows.join(covered, "s_suppkey", "left_anti").join(best, "s_suppkey").select("s_suppkey", "slug", "best")


@query("WITH f AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 50 = 0), p AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag = 'N' AND l_partkey % 40 = 0), c AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R') SELECT CASE WHEN s IN (SELECT s FROM f) THEN 'already-free' WHEN s IN (SELECT s FROM p) THEN 'paid-only' ELSE 'new' END AS part, count(*) AS companies FROM c GROUP BY 1")
def d14_three_way(spark, sf_dir):
    """Companies of one source: free already, known from paid searches alone, or new."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("company"), "l_returnflag", "l_partkey")
    return inventories.companies_split(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A' AND l_partkey % 50 = 0"), lines.where("l_returnflag = 'N' AND l_partkey % 40 = 0"))


@query(R + ", f AS (SELECT key, max(score) AS f FROM result WHERE source = 'R' GROUP BY 1), k AS (SELECT key, max(score) AS k FROM result WHERE source = 'A' GROUP BY 1), j AS (SELECT * FROM f FULL JOIN k USING (key)) SELECT count(*) FILTER (WHERE f IS NOT NULL AND k IS NOT NULL) AS shared, count(*) FILTER (WHERE k IS NULL) AS found_only, count(*) FILTER (WHERE f IS NULL) AS known_only, count(*) FILTER (WHERE f >= 40 AND k >= 40) AS shared_useful, count(*) FILTER (WHERE f >= 40 AND k IS NULL) AS new_useful, round(100 * count(*) FILTER (WHERE f >= 40 AND k >= 40) / greatest(1, count(*) FILTER (WHERE k >= 40)), 1) AS of_useful, round(100 * count(*) FILTER (WHERE f IS NOT NULL AND k IS NOT NULL) / greatest(1, count(k)), 1) AS of_all FROM j")
def d14_recovery(spark, sf_dir):
    """How much of what one source knows another finds again."""
    rows = results(spark, sf_dir)
    return inventories.recovery(rows.where("source = 'R'"), rows.where("source = 'A'"), 40)
