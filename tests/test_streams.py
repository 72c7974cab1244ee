"""Streams over several batches, restarted in between, give what one batch over everything gives, and nothing twice."""

import datetime
import random

from gristmill.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)


def test_milestones_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), k) for k in range(70)] + [("c", 500), ("c", 501)]
    path, base = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([], "source string, arrival long").write.parquet(path)
    for lo in range(0, len(rows), 12):  # every round is a new start of the query
        spark.createDataFrame(rows[lo : lo + 12], "source string, arrival long").coalesce(1).write.mode("append").parquet(path)
        out = jobs.milestones(jobs.ingest(spark, path, "source string, arrival long"), "source", "arrival", (1, 5, 20), base)
    got = sorted(map(tuple, out.collect()), key=repr)
    right = [(s, t, mine[t - 1]) for s in ("a", "b", "c", None) for t in (1, 5, 20) if len(mine := sorted(k for x, k in rows if x == s)) >= t]
    assert got == sorted(right, key=repr)
    spark.createDataFrame([("a", -1)], "source string, arrival long").coalesce(1).write.mode("append").parquet(path)  # comes late, emits nothing
    again = jobs.milestones(jobs.ingest(spark, path, "source string, arrival long"), "source", "arrival", (1, 5, 20), base)
    assert sorted(map(tuple, again.collect()), key=repr) == got


def test_transitions_with_late_rows(spark, tmp_path):
    rng = random.Random(4)
    schema = "k string, ts timestamp_ntz, id long, v string"
    rows = [(rng.choice(["x", "y", "z"]), T0 + datetime.timedelta(minutes=3 * i), i, rng.choice(["open", "closed", "gone"])) for i in range(80)]
    mixed = [r for i in range(0, 80, 8) for r in rng.sample(rows[i : i + 8], 8)]  # late by less than half an hour
    path, base = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([], schema).write.parquet(path)
    seen = []
    for lo in range(0, 80, 10):
        spark.createDataFrame(mixed[lo : lo + 10], schema).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.ingest(spark, path, schema)
        got = [tuple(r) for r in jobs.transitions(stream, "k", "ts", "id", "v", base, "30 MINUTES").collect()]
        assert set(seen) <= set(got) and len(got) == len(set(got))
        seen = got
    final = sorted(map(tuple, jobs.settled(spark, dict(stream.dtypes), ("k", "ts", "id", "v"), base).collect()))
    right, last = [], {}
    for k, _, i, v in rows:
        if last.get(k, v) != v:
            right.append((k, i, v, last[k]))
        last[k] = v
    assert final == sorted(right) and len(seen) < len(final)
    spark.createDataFrame([("x", T0, 1000, "other")], schema).coalesce(1).write.mode("append").parquet(path)  # too late: kept apart
    jobs.transitions(jobs.ingest(spark, path, schema), "k", "ts", "id", "v", base, "30 MINUTES")
    assert spark.read.parquet(base + "/late").where("id = 1000").count() == 1
    assert sorted(map(tuple, jobs.settled(spark, dict(stream.dtypes), ("k", "ts", "id", "v"), base).collect())) == final
