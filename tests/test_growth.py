"""Steps whose time once grew out of bounds: what makes them cheap, and that it changes nothing."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions import signals as S
from gristmill.functions.text import located
from gristmill.operators import audits, counterfactuals, derivation, gate, inventories, market, overlap
from gristmill.plans import all_queries
from gristmill.sources.tables import market_rows
from tests.test_oracle import SF


@pytest.mark.parametrize("text", ["Not a fully remote job", "globally  DISTRIBUTED", "3 days a week in the office", "ON-SıTE", "worK from home", "any time zone", "must be located", "unable to ſponsor", "a remoteness", "we can sponsor you", "plain prose"])
def test_signals_look_for_patterns_only_behind_their_words(spark, text):
    lists = (S.NOT_REMOTE, S.STRONG_REMOTE, S.HYBRID, S.ONSITE, S.REMOTE, S.WORLDWIDE, S.RESTRICTION, S.VISA_NO, S.VISA_YES)
    row = spark.createDataFrame([(text,)], "t string")
    plain = [F.col("t").rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns)) for patterns in lists]
    assert row.select(F.array(*[S._any(F.col("t"), p) for p in lists])).first()[0] == row.select(F.array(*plain)).first()[0]
    assert all(set(lists) <= set(S.NEEDED) and p.startswith(r"\b") and any(w in re.sub(r"\\.", " ", p) for w in S.NEEDED[patterns]) for patterns in lists for p in patterns)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_vocabulary_is_met_in_two_searches(spark):
    row = spark.createDataFrame([("Nodejs and andkafka, react native",)], "t string")
    found = row.select(audits.vocabulary_hits("t", ["node.js", "kafka", "react", "react native"]))
    assert _plan(found).count("regexp_extract_all") <= 4  # each is printed twice
    assert found.first()[0] == "kafka=glued;node.js=boundary:nodejs;react native=boundary"


def test_the_gate_reads_documents_once_and_partners_stay_in_theirs(spark):
    docs = spark.createDataFrame([(1, "Skills\nNLP"), (1, "natural language processing"), (2, "natural language processing"), (None, "Skills\nnlp"), (None, "natural language processing")], "doc_id long, text string")
    terms = ["natural language processing", "nlp"]
    kept = gate.gated(gate.hits(docs, terms), gate.abbreviations(gate.vocabulary_of(spark, terms)))
    assert _plan(kept).count("MapInArrow") == 1
    assert {(r.doc_id, r.term, r.centrality) for r in kept.collect()} == {(1, "nlp", 3), (1, "natural language processing", 4), (None, "nlp", 3)}


@pytest.mark.parametrize("name", ["c10_structural_gate", "e4_statements", "f8_experience_gap", "e3_years_stated"])
def test_texts_of_parts_are_dealt_before_they_are_read(spark, name):
    assert "Repartition" in _plan(all_queries()[0][name](spark, SF))


def test_the_sentence_of_an_occurrence_is_cut_out_once(spark):
    assert _plan(all_queries()[0]["c3_status"](spark, SF)).count("[.;!?]") <= 4


def test_places_of_matches_are_not_gathered_in_an_array_that_grows(spark):
    found = spark.createDataFrame([("a the b the",), ("",), (None,), ("none",)], "t string").select(located("t", "the", 2, 1))
    assert "concat(namedlambdavariable().out, array(" not in re.sub(r"#\d+|_\d+", "", _plan(found)).replace("lambda acc", "namedlambdavariable()")
    assert [[tuple(x) for x in r[0]] for r in found.collect()] == [[("the", 2, 5, "a ", " "), ("the", 8, 11, "b ", "")], [], [], []]


def test_steps_join_first_arrivals_only_to_what_can_enter_the_top(spark, monkeypatch):
    plans = []
    bucketed = counterfactuals.bucketed
    monkeypatch.setattr(counterfactuals, "bucketed", lambda rows, *rest: plans.append(_plan(rows)) or bucketed(rows, *rest))
    events = spark.createDataFrame([(1, "a", 5, 1), (1, None, 9, 2), (2, "b", 7, 3), (3, "a", 8, 4)], "step long, key string, score int, arrival long")
    steps = spark.createDataFrame([(1,), (2,), (3,)], "step long")
    rows = counterfactuals.steps_of_top(events, steps, [], 1).orderBy("step").collect()
    assert [(r.entered, r.displaced, r.entered_new) for r in rows] == [(1, 0, 1), (1, 1, 1), (1, 1, 0)]
    assert plans[0].index("Join") < plans[0].index("Window")


MARKET = [(k % 23, ("large red ring", "red ring bolt", "hot bolt", "blue ring clerk", "standard hot bolt pin")[k % 5], k % 30, f"c{k * k % 7}", [("red", "ring"), ("bolt",), ("red", "bolt", "red"), ()][k % 4]) for k in range(60)] + [(None, "red ring", 1, "c1", None), (61, None, 1, None, ["red"])]


def _market(spark, rows=MARKET):
    return spark.createDataFrame([(i, t, s, c, None if k is None else list(k)) for i, t, s, c, k in rows], "row_id long, title string, score int, company string, skills array<string>")


def _kept(monkeypatch):
    """Plans of what the market's operators write."""
    plans, stored = [], market.stored
    monkeypatch.setattr(market, "stored", lambda df: plans.append(_plan(df)) or stored(df), raising=False)
    return plans


def test_what_a_part_says_is_put_together_before_lines_meet_it(spark):
    plan = _plan(market_rows(spark, SF))
    assert plan.index("Join") < plan.index("concat_ws") and plan.index("Join") < plan.index("array_distinct")
    assert plan.index("p_type") > plan.rindex("Join")


def test_a_size_curve_reads_the_market_twice_for_all_sizes(spark, monkeypatch):
    rows, sizes, plans = _market(spark), (0.9, 0.05, 0.25, 0.5, 1.0), _kept(monkeypatch)
    curve = market.size_curve(rows, sizes, ("large", "standard"), 2)
    assert sum(p.count("LogicalRDD") for p in [*plans, _plan(curve)]) == 2
    firms = lambda part: {r.fragment for r in market.fragment_index(part, ("large", "standard")).where("companies >= 2").collect()}
    shares = lambda part, n: {r.skill: r.n / n for r in market.vocabulary(part).collect()} if n else {}
    whole, right = firms(rows), shares(rows, rows.count())
    for got in curve.collect():
        part = market.nested_sample(rows, got.fraction)
        n = part.count()
        used, found = shares(part, n), firms(part)
        assert (got.rows, got.skills, got.fragments) == (n, len(used), len(found))
        assert got.recall == pytest.approx(len(found & whole) / len(whole)) and got.error == pytest.approx(sum(abs(used.get(k, 0) - v) for k, v in right.items()) / len(right))
    assert sorted(r.fraction for r in curve.collect()) == sorted(sizes)


def test_rows_meet_people_by_their_lists_and_count_together_in_bounded_tasks(spark, monkeypatch):
    import math

    rows, plans = _market(spark), _kept(monkeypatch)
    owned = [("p", "red"), ("p", "bolt"), ("p", "bolt"), ("q", "ring"), ("q", "red"), ("r", "absent")]
    people = spark.createDataFrame(owned, "person string, skill string")
    found = market.matching_rows(rows, people, 2, 3.0)
    assert not [p for p in [*plans, _plan(found)] if "Generate" in p and "LogicalRDD" in p.split("Generate")[-1]]
    uses = [(i, k) for i, *_, skills in MARKET for k in skills or ()]
    n = {k: sum(x == k for _, x in uses) for _, k in uses}
    met = {}
    for i, k in uses:
        for person, skill in owned:
            if skill == k:
                a, b = met.get((person, i), (0, 0.0))
                met[person, i] = a + 1, b + math.log(len(MARKET) / (1 + n[k]))
    met = {k: v for k, v in met.items() if v[0] >= 2}
    top = {p: max(v[1] for k, v in met.items() if k[0] == p) for p, _ in met}
    right = {k: (a, pytest.approx(b)) for k, (a, b) in met.items() if top[k[0]] < 3 or b >= 3}
    assert {(r.person, r.row_id): (r.shared, r.evidence) for r in found.collect()} == right and len(right) > 5
    monkeypatch.setattr(market, "AT_ONCE", 2)
    dealt = market.matching_rows(rows, people, 2, 3.0)
    assert max(int(x) for x in re.findall(r"RepartitionByExpression \[.*?\], (\d+)", _plan(dealt))) > 20


@pytest.mark.parametrize(("name", "passes"), [("m23_specialists", 2), ("m22_redundancy_deferral", 1)])
def test_what_needs_no_companies_makes_no_pairs_of_titles_and_companies(spark, monkeypatch, name, passes):
    plans, stored = [], derivation.stored
    monkeypatch.setattr(derivation, "stored", lambda df: plans.append(_plan(df)) or stored(df))
    plans.append(_plan(all_queries()[0][name](spark, SF)))
    assert not [p for p in plans if re.search(r"Aggregate \[(title|term)#\d+, company", p)]
    assert sum("l_quantity#" in p for p in plans) == passes  # once by lists of skills, and once more where employers are asked for


def test_tables_of_a_market_are_those_of_its_rows_and_shares_do_without_companies(spark):
    rows = _market(spark).drop("row_id")
    tables = derivation.market_of(rows, ("large", "standard"))
    held = [(t, c, sorted(set(k or ()))) for _, t, _, c, k in MARKET]
    skills = {k for *_, found in held for k in found}
    right = {k: (sum(k in found for *_, found in held), len({c for _, c, found in held if k in found and c is not None})) for k in skills}
    assert {r.skill: (r.n, r.employers) for r in tables.employers.collect()} == right
    assert {r.skill: r.n for r in tables.skills.collect()} == {k: n for k, (n, _) in right.items()}
    assert {(r.title, r.skill): r.n for r in tables.uses.collect()} == {(t, k): sum(t == u and k in found for u, _, found in held) for t, _, each in held for k in each}
    assert {r.title: r.n for r in tables.titles.collect()} == {t: sum(t == u for u, *_ in held) for t, *_ in held} and tables.total.first()[0] == len(held)
    index = {r.fragment: (r.listings, r.companies) for r in tables.index.collect()}
    assert index == {r.fragment: (r.listings, r.companies) for r in market.fragment_index(rows, ("large", "standard")).collect()}
    asked = spark.createDataFrame([("p", "red ring"), ("p", "bolt"), ("q", "absent")], "person string, keyword string")
    own = spark.createDataFrame([("p", "red"), ("p", "bolt"), ("q", "red")], "person string, skill string")
    full, bare = derivation.shares(asked, own, tables), derivation.shares(asked, own, tables, companies=False)
    assert sorted(map(tuple, full.drop("companies").collect())) == sorted(map(tuple, bare.collect())) and full.where("companies > 0").count() > 1


def test_outcomes_of_paid_rows_with_ties_repeats_and_no_key(spark):
    rows = [(1, "a", 5, 10), (2, "a", 7, 11), (2, "a", 7, 12), (None, "b", 9, 13), (1, "b", 9, 14), (3, "c", 1, 15), (3, "c", None, 16), (4, None, 2, 17), (5, "d", 3, 18), (5, "d", 3, 18), (6, "e", None, 19)]
    found = inventories.outcomes(spark.createDataFrame(rows, "unit_id long, key string, score int, arrival long")).collect()
    assert sorted((r.arrival, r.outcome, r.marginal) for r in found) == [
        (10, "other_paid", False), (11, "kept", False), (12, "same_unit", False), (14, "free", False), (15, "kept", True), (16, "same_unit", False), (17, "kept", True), (18, "kept", True), (18, "kept", True), (19, "kept", True)]


def test_outcomes_shuffle_the_lines_to_their_orders_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = all_queries()[0]["a4_dedupe_outcome"](spark, SF)
        found.collect()
        tree = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Scan parquet.*l_orderkey", tree)) == 1


def test_twins_are_dealt_over_tasks_by_pairs_and_come_out_in_blocks(spark, tmp_path):
    """Few bytes make many pairs: they may not end up in the tasks that the bytes are worth, nor in an order that a file can't pack."""
    rng = random.Random(9)
    ids = rng.sample(range(70_000), 3000)
    orders = [(k, rng.choice([0, 7, 1, 2, 3, 40, 41, 47, 80]), "1", "F", 1.0) for k in ids]
    lines = [(k, n, rng.randrange(30), 1, 1.0, "A") for k in ids for n in range(rng.randrange(1, 8))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    keys = {}
    for k, _, part, *_ in lines:
        keys.setdefault(k, set()).add(part)
    right = sorted((a, b, len(keys[a] & keys[b])) for a, c, *_ in orders if c % 7 == 0 for b, e, *_ in orders if b < a and e % 7 and c % 40 == e % 40)
    got = all_queries()[0]["d18_twins"](spark, str(tmp_path)).withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()).orderBy("_row").collect()
    assert sorted((r.remote, r.twin, r.shared) for r in got) == right and {n for *_, n in right} >= {0, 1, 2}
    assert len({r["_task"] for r in got}) >= 8
    starts = sum(x.twin != y.twin or x["_task"] != y["_task"] for x, y in zip(got, got[1:]))
    assert starts < len({(b, a >> 15) for a, b, _ in right})


def test_sets_of_few_keys_without_a_common_one_are_seldom_compared(spark):
    """Pairs grow with the square of the units: a comparison of two sets costs more than making and writing a pair."""
    rng = random.Random(5)
    sets = spark.createDataFrame([(n, [f"{rng.randrange(2000)}-{rng.randrange(3)}" for _ in range(rng.randrange(1, 8))]) for n in range(700)] + [(700, []), (701, ["7-1"] * 3)], "id long, keys array<string>")
    side = lambda name: sets.select(F.struct("id", *overlap.masks("keys"), "keys").alias(name))
    met = side("t").crossJoin(side("r")).select(overlap.may_share("t", "r").alias("open"), F.arrays_overlap("t.keys", "r.keys").alias("share")).groupBy("open", "share").count().collect()
    n = {(r.open, r.share): r["count"] for r in met}
    assert (False, True) not in n and n[True, True] > 700
    assert n[True, False] < 0.02 * n[False, False]


def test_what_a_row_of_the_join_of_twins_makes_is_bounded(spark):
    """Rows made from one row of a join stay in memory until its last match: lists that meet are short, and are taken apart behind the join."""
    units = spark.range(40_000).select(F.col("id").alias("unit_id"), F.lit(3).alias("keyword"), F.array(F.col("id").cast("string")).alias("keys"))
    held = overlap._pieces(units, 64).select(F.size("held").alias("n"), F.explode("held.id").alias("id")).agg(F.max("n"), F.count("*"), F.countDistinct("id")).first()
    assert tuple(held) == (64, 40_000, 40_000)
    tree = [x.strip(" :+-*()0123456789") for x in overlap.twins(units.where("unit_id % 7 = 0"), units.where("unit_id % 7 > 0"))._jdf.queryExecution().sparkPlan().toString().split("\n")]
    at = {n: next(i for i, x in enumerate(tree) if x.startswith(n)) for n in ("Coalesce", "SortMergeJoin")}
    assert sum(x.startswith("Generate") for x in tree[: at["Coalesce"]]) == 2
    assert not any(x.startswith("Generate") for x in tree[at["Coalesce"] : at["SortMergeJoin"]])
