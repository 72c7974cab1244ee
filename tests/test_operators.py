"""Golden cases of the signal functions and properties of ranking and spans."""

import datetime

import pytest
from pyspark.sql import functions as F

from gristmill.functions import experience
from gristmill.functions import signals as S
from gristmill.functions import text as X
from gristmill.operators import funnels, market, ranking, scoring


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("text,usd", [("$180,000 - $220,000 a year", 220000), ("$150k - $190k", 190000), ("$75 - $95 an hour", 197600), ("€90,000 per year", 97200), ("not disclosed", None), ("50000-80000 per month", None), ("", None), (None, None)])
def test_pay(spark, text, usd):
    got = one(spark, S.comp_max_usd("t"), t=text)
    assert got == pytest.approx(usd) if usd else got is None


@pytest.mark.parametrize("location,title,description,scope", [
    ("Anywhere in the World", "Dev", "", "worldwide"), ("Remote", "Dev", "", "remote"), ("New York, NY (HQ), Remote", "Dev", "", "restricted"), ("Berlin", "Dev", "This role is not remote.", "onsite"),
    ("Berlin", "Dev", "hybrid, with occasional remote days", "hybrid"), ("", "Dev", "", ""), ("Remote", "Dev", "You must be based in Canada", "restricted"), (None, None, None, ""),
])
def test_scope(spark, location, title, description, scope):
    assert one(spark, S.remote_scope("l", "t", "d"), l=location, t=title, d=description) == scope


@pytest.mark.parametrize("text,answer", [("We cannot sponsor visas", "no"), ("visa sponsorship available", "yes"), ("no word", ""), (None, "")])
def test_visa(spark, text, answer):
    assert one(spark, S.visa("t"), t=text) == answer


@pytest.mark.parametrize("regions,zones,gap", [("Europe", "", 4.5), ("US", "", 11.5), ("", "UTC-8", 13.5), ("US", "CET", 4.5), ("", "", None)])
def test_gap(spark, regions, zones, gap):
    assert one(spark, S.tz_gap("r", "z", 5.5), r=regions, z=zones) == gap


@pytest.mark.parametrize("text,years", [("8+ years of experience", 8), ("3 years experience and 5 years in Java", 5), ("founded 5 years ago", None), ("minimum 16 years of formal education", None), (None, None)])
def test_years(spark, text, years):
    assert one(spark, experience.required_years("t"), t=text) == years


@pytest.mark.parametrize("raw,day", [("2024-02-03T10:00", datetime.date(2024, 2, 3)), ("30+ days ago", datetime.date(2024, 5, 2)), ("2 weeks ago", datetime.date(2024, 5, 18)), ("Just posted", datetime.date(2024, 6, 1)), ("soon", None), ("", None)])
def test_posted(spark, raw, day):
    assert one(spark, S.posted_on("t", F.lit("2024-06-01").cast("date")), t=raw) == day


def test_keys(spark):
    assert one(spark, X.company_key("c"), c="Acme Labs Pvt. Ltd.") == "acme"
    assert one(spark, X.title_key("c"), c="Engineer, Backend") == "backend engineer"
    assert one(spark, X.canonical_url("c"), c="https://WWW.Example.com/Jobs/1/?utm=x#y") == "example.com/jobs/1"
    assert one(spark, X.job_key("c", "t", "u"), c="", t="x", u="http://a.b/c") == "url|a.b/c"
    assert one(spark, X.job_key("c", "t"), c=None, t=None) is None


def test_terms_on_boundaries(spark):
    df = spark.createDataFrame([("lead c# node.js",), ("leadership",), (None,)], "d string")
    got = [r[0] for r in df.select(scoring.matched_terms("d", ["c#", "lead", "node.js"])).collect()]
    assert got == [["c#", "lead", "node.js"], [], []]


def test_unkeyed_rows_never_collapse(spark):
    df = spark.createDataFrame([(1, "k", 5), (2, "k", 5), (3, None, 1), (4, None, 1)], "arrival long, key string, score int")
    assert sorted(r["arrival"] for r in ranking.best_per_key(df, "key").collect()) == [1, 3, 4]


def test_merge_filters_after_dedupe(spark):
    df = spark.createDataFrame([(1, "k", 9), (2, "k", 7), (3, "j", 2)], "arrival long, key string, score int")
    other = df.select("arrival", "key", "score", F.lit("x").alias("extra")).where("arrival = 2")
    assert [r["arrival"] for r in ranking.merged([df, other], "key", keep=F.col("score") >= 3).collect()] == [1]


def test_islands(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 8), ("a", 8, 9), ("a", 20, 22), ("a", 30, 30)], "p string, lo long, hi long")
    row = funnels.islands(df, ["p"], "lo", "hi").first()
    assert (row["length"], row["islands"]) == (10, 2)


def test_separation_bands(spark):
    df = spark.createDataFrame([("react", 3340, 10000), ("docker", 1570, 10000), ("express", 540, 10000), ("postgres", 130, 10000), ("maven", 50, 10000), ("thin", 1, 10)], "t string, hits long, seen long")
    assert [r[0] for r in df.select(market.separation("hits", "seen")).collect()] == [1, 2, 3, 4, 5, None]


def test_rank_correlation_needs_rows(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "x int, y int")
    assert market.spearman(df, "x", "y").first()[0] is None
