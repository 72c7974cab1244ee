"""Counterfactuals and steps of the top against ranking again for every scenario."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import counterfactuals as C
from gristmill.operators import funnels

ROWS = "key string, unit_id long, score double, arrival long, position int"
UNITS = "unit_id long, plan_index long, provider string, ceiling decimal(10,2)"


def rank(rows):
    out = []
    for key, *_ in sorted(rows, key=lambda r: (-r[2], r[3])):
        if key not in out:
            out.append(key)
    return out


def made(seed, units=300, rows=2500, keys=400, ruler=False):
    rng = random.Random(seed)
    plan = [(100 + 3 * u, 1000 - 2 * u, f"p{u % 3}", u) for u in range(units)]
    out = []
    for a in range(rows):
        unit = rng.choice(plan)[0] if rng.random() < 0.9 else None
        unit = plan[5][0] if ruler and rng.random() < 0.5 else unit
        out.append((f"k{rng.randrange(keys)}", unit, float(rng.randrange(12)), a, rng.choice([None, 1, 2, 3, 4, 5])))
    return out, plan


@pytest.mark.parametrize("seed,k,ruler", [(1, 20, False), (2, 5, True)])
def test_steps_equal_ranking_every_prefix(spark, seed, k, ruler):
    rows, plan = made(seed, ruler=ruler)
    index = {u: i for u, i, *_ in plan}
    paid = [r for r in rows if r[1] is not None]
    final = rank(rows)[:k]
    events = spark.createDataFrame(paid, ROWS).withColumn("step", F.element_at(F.create_map(*[F.lit(x) for p in index.items() for x in p]), F.col("unit_id")))
    steps = spark.createDataFrame([(i,) for i in index.values()], "step long")
    goal = spark.createDataFrame([(x,) for x in final], "key string")
    got = {int(r["step"]): (r["entered"], r["displaced"], r["moved"], r["entered_new"], r["held"]) for r in C.steps_of_top(events, steps, [], k, goal, buckets=7).collect()}
    before, seen = [], set()
    assert sorted(got) == sorted(index.values())
    for i in sorted(index.values()):
        now = rank([r for r in paid if index[r[1]] <= i])[:k]
        mine = {r[0] for r in paid if index[r[1]] == i}
        entered = [x for x in now if x not in before]
        moved = sum(x in before and before.index(x) != n for n, x in enumerate(now))
        assert got[i] == (len(entered), len(set(before) - set(now)), moved, sum(x in mine and x not in seen for x in entered), len(set(now) & set(final))), i
        before, seen = now, seen | mine


@pytest.mark.parametrize("seed,ruler", [(3, False), (4, True), (5, None)])
def test_report_equals_ranking_every_scenario(spark, seed, ruler):
    rows, plan = made(seed, 40, 300, 130, bool(ruler))
    if ruler is None:  # a provider that brought nothing, and no free rows
        plan.append((9999, 5000, "idle", 7))
        rows = [r for r in rows if r[1] is not None]
    k, depth = 10, 4
    index, provider, price = {u: i for u, i, *_ in plan}, {u: p for u, _, p, _ in plan}, {u: c for u, *_, c in plan}
    full = rank(rows)
    origins = {}
    for key, unit, *_ in rows:
        origins.setdefault(key, set()).add(unit)

    def loss(keep):
        left = rank([r for r in rows if keep(r)])
        lost = [x for x in full if x not in left]
        return len(lost), sum(len(origins[x]) == 1 and None not in origins[x] for x in lost), len(set(full[:k]) - set(left[:k])), full.index(lost[0]) + 1 if lost else None

    right = set()
    for u, i, p, c in plan:
        right.add(("skip-alone", u, p, None, *loss(lambda r, u=u: r[1] != u), float(c)))
        right.add(("stop-after", u, p, None, *loss(lambda r, i=i: r[1] is None or index[r[1]] <= i), float(sum(price[x] for x in index if index[x] > i))))
    for p in set(provider.values()):
        for d in range(1, depth + 1):
            right.add(("depth", None, p, d, *loss(lambda r, p=p, d=d: r[1] is None or provider[r[1]] != p or (r[4] is not None and r[4] <= d)), 0.0))
    report = C.report(spark.createDataFrame(rows, ROWS), spark.createDataFrame([(u, i, p, c) for u, i, p, c in plan], UNITS.replace("decimal(10,2)", "long")), depth, k)
    got = {(*tuple(r)[:8], float(r["exposure_avoided"])) for r in report.collect()}
    assert got == right


def test_skipped_groups(spark):
    rows, plan = made(6, 30, 300, 150)
    provider = {u: p for u, _, p, _ in plan}
    full = rank(rows)
    got = {r["provider"]: tuple(r)[1:] for r in C.skipped(spark.createDataFrame([(*r, provider.get(r[1])) for r in rows], ROWS + ", provider string"), 15, "provider").collect()}
    for p in set(provider.values()):
        left = rank([r for r in rows if provider.get(r[1]) != p])
        lost = [x for x in full if x not in left]
        alone = sum(len({r[1] for r in rows if r[0] == x}) == 1 for x in lost)
        assert got[p] == (len(lost), alone, len(set(full[:15]) - set(left[:15])), full.index(lost[0]) + 1 if lost else None)


@pytest.mark.parametrize("buckets", [1, 2, 5, 40])
def test_buckets_follow_the_order(spark, buckets):
    rng = random.Random(buckets)
    rows = [(None,)] * 3 + [(rng.choice([1, 2, 2, 2, 50, 900]) * rng.randrange(1, 40),) for _ in range(300)]
    got = funnels.bucketed(spark.createDataFrame(rows, "x long"), "x", buckets).orderBy(F.col("x").asc_nulls_first(), "_bucket").collect()
    assert [r["_bucket"] for r in got] == sorted(r["_bucket"] for r in got) and len({(r["x"], r["_bucket"]) for r in got}) == len({r["x"] for r in got})
    if buckets == 40:
        assert len({r["_bucket"] for r in got}) > 20
    assert funnels.bucketed(spark.createDataFrame([], "x long"), "x", buckets).count() == 0


def test_streaks_over_buckets(spark):
    rng = random.Random(3)
    rows = [(g, i, int(rng.random() < 0.2)) for g in ("a", "b", None) for i in range(90)] + [("c", i, 0) for i in range(20)]
    got = {(r["g"], r["i"]): r["streak"] for r in funnels.streaks(spark.createDataFrame(rows, "g string, i long, gain int"), ["g"], "i", "gain").collect()}
    run = 0
    for g, i, gain in rows:
        run = 0 if gain else (run if i else 0) + 1
        assert got[g, i] == run
