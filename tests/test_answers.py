"""Answers of operators for which the driver tables hold no cases, and of queries that SQL can't check."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.functions import experience as X
from gristmill.functions import signals as S
from gristmill.functions import text as X_text
from gristmill.operators import evidence as E
from gristmill.operators import funnels, market
from gristmill.plans import all_queries
from gristmill.sources import landed
from gristmill.streaming import jobs
from tests.test_operators import one
from tests.test_oracle import SF

QUERIES, SQL = all_queries()


@pytest.mark.parametrize("text,least", [
    ("9+ years of product development experience.", 9), ("You need minimum 4 years of experience.", 4), ("At least 7 years.", 7), ("2-6 years of experience.", 2), ("5 to 12 yrs of proven experience.", 5),
    ("Experience: 6+ years overall, 3+ years Terraform.", 6), ("3+ years of total experience, 6+ years of Terraform experience.", 3), ("6+ years of experience with Kafka.", None), ("2+ years hands-on in data science.", None),
    ("8 years of experience is a plus.", None), ("Ideally 5-7 years of experience.", None), ("Up to 6 years of experience.", None), ("Together we have 30 years of combined experience.", None), ("Minimum 16 years of schooling and education.", None),
    ("Term of the contract: 2 years.", None), ("This post asks for 6 years of experience.", None), ("", None), (None, None),
])
def test_confirmed_minimum(spark, text, least):
    assert one(spark, X.confirmed_minimum("t")["min_years"], t=text) == least


@pytest.mark.parametrize("text,years", [("Crew : 10+ years", 10), ("Bond of 3 years.", None), ("The firm is 12 years old. We look for 3 years of experience.", 3), ("experience of 7 yrs", 7), ("Set up 6 years ago, with 3+ years of experience in ML", 3), ("needs 3 year(s) of experience. degree: 15 years of full time education", 3)])
def test_required_years(spark, text, years):
    assert one(spark, X.required_years("t"), t=text) == years


@pytest.mark.parametrize("months,action", [(None, "none"), (-1, "none"), (0, "hard_drop"), (36, "hard_drop"), (37, "penalty"), (48, "penalty"), (49, "none"), (90, "none")])
def test_gap_bands(spark, months, action):
    df = spark.createDataFrame([(5, months)], "least int, months int")
    assert df.select(X.gap_action("least", "months")).first()[0] == action


@pytest.mark.parametrize("text,out", [("Contracts run via Deel.", "Deel"), ("with an employer of record, Oyster", "EOR, Oyster"), ("as an independent contractor", "contractor"), ("We use Redis", ""), (None, "")])
def test_eor(spark, text, out):
    assert one(spark, S.eor("t"), t=text) == out


@pytest.mark.parametrize("text,out", [("UTC+2 preferred", "UTC+2"), ("UTC-3, UTC-3 or UTC+1; UTC+2; UTC+4", "UTC-3; UTC+1; UTC+2"), ("no timing requirements", ""), (None, "")])
def test_time_zones(spark, text, out):
    assert one(spark, S.time_zones("t"), t=text) == out


def test_regions_and_eligibility(spark):
    assert one(spark, S.regions("t"), t="Remote - EMEA or United States") == "EMEA, US"
    assert one(spark, S.eligibility_regions("t"), t="Remote in the US only.") == "US"
    assert one(spark, S.eligibility_regions("t"), t="Your clients sit in Germany.") == ""
    assert one(spark, S.eligibility_regions("t"), t="x" * 300 + " must reside in Canada " + "y" * 300 + " US") == "Canada"
    assert one(spark, S.eligibility_regions("t"), t=None) == ""


@pytest.mark.parametrize("text,out", [("call +91 98765-43210 or 9876543210", "+919876543210; 9876543210"), ("98765 43210 98765 43210", "9876543210"), ("12345678901234", ""), (None, "")])
def test_phones(spark, text, out):
    assert one(spark, S.phones("t"), t=text) == out


@pytest.mark.parametrize("text,day", [("2024-02-03T09:00", (2024, 2, 3)), ("March 5, 2024", (2024, 3, 5)), ("Mar 5, 2024", (2024, 3, 5)), ("5 Mar 2024", (2024, 3, 5)), ("Posted 15 Days Ago", (2024, 5, 17)), ("Posted Yesterday", (2024, 5, 31)), ("Just posted", (2024, 6, 1)), ("soon", None), (None, None)])
def test_listing_dates(spark, text, day):
    assert one(spark, S.listing_date("t", F.lit("2024-06-01").cast("date")), t=text) == (datetime.date(*day) if day else None)


def test_enriched_row(spark):
    from gristmill.operators.scoring import enriched

    row = enriched(spark.createDataFrame([("Anywhere in the World", "Backend Engineer", "Visa sponsorship available; write to hr@example.com. UTC+2.")], "location string, title string, description string"), 5.5).first()
    assert (row["remote_scope"], row["visa"], row["hr_email"], row["timezones"], row["tz_gap"]) == ("worldwide", "yes", "hr@example.com", "UTC+2", 3.5)


def test_csv_files_by_their_headers(spark, tmp_path):
    files = {"a/one.csv": "a,b\n1,2\n", "b/two.csv": "﻿b,a\n4,3\n", "c/three.csv": 'c,"b"\n6,5\n', "d/empty.csv": "", "e/head.csv": "a,z\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = landed.drifted_csv(spark, str(tmp_path)).select("a", "b", "c", "z", F.element_at(F.split("run", "/"), -1).alias("f")).collect()
    assert sorted((r["f"], r["a"], r["b"], r["c"], r["z"]) for r in rows) == [("one.csv", "1", "2", None, None), ("three.csv", None, "5", "6", None), ("two.csv", "3", "4", None, None)]


def test_depths_leave_deeper_rows_out(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("b", 2), ("c", 8)], "key string, position int")
    assert sorted(tuple(r) for r in funnels.depths(df, 3).collect()) == [(1, 1, 1, 2), (2, 2, 2, 1), (3, 2, 2, 1)]


def test_running_follows_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["p", "q", None]), rng.choice([None, *range(40)]), k, rng.randint(-5, 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, x int, k int, v int").repartition(5)
    got = {r["k"]: (r["total"], r["best"]) for r in funnels.running(df, ["g"], ["x", "k"], {"total": ("sum", F.col("v"), True), "best": ("max", F.col("v"), False)}, 7).collect()}
    for g in ("p", "q", None):
        total, best = 0, None
        for _, x, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            total += v
            assert got[k] == (total, best)
            best = v if best is None else max(best, v)


def test_hot_islands_equal_plain_ones(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice("ab"), lo := rng.randrange(300), lo + rng.randrange(6)) for _ in range(300)], "g string, lo long, hi long")
    pair = [sorted(tuple(r) for r in funnels.islands(df, ["g"], "lo", "hi", hot).collect()) for hot in (True, False)]
    assert pair[0] == pair[1]


def test_sections_entries_and_tiers(spark):
    text = "Jane\nProfessional Experience:\nAcme | Remote\nEngineer 2020\n- Built services with spark and\nGoogle Maps wrappers.\nBeta Inc\n- Designed spark jobs.\n- Reviewed kafka without adopting it.\nTechnical Skills\n- Tools: kafka, redis\n"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    spans = {(r["section"], r["entry"]): r["lines"] for r in E.sections(docs).where("doc_id = 1").collect()}
    assert spans[("work", "Acme")] == 4 and spans[("work", "Beta Inc")] == 3 and spans[("other", "")] == 1
    found = E.judged(E.occurrences(E.lines(docs), {"spark": ["spark"], "kafka": ["kafka"], "redis": ["redis"]}))
    got = {r["concept"]: (r["strength"], r["entries"], r["tier"]) for r in E.strength(found).collect()}
    assert got == {"spark": ("independent", 2, "CORE"), "kafka": ("claim", 0, "SUPPORTING"), "redis": ("claim", 0, "SUPPORTING")}


@pytest.mark.parametrize("line,kept", [("built a service", True), ("authored documents for the service", False), ("developed tools, and reviewed the service", False), ("service built by hand", True), ("never built a service", True)])
def test_verbs_govern_objects(spark, line, kept):
    rows = E.lines(spark.createDataFrame([(1, line)], "doc_id long, text string"))
    hits = E.work_hits(rows, (E.Mode("development", "(?:built|developed|authored)", "services?"),)).collect()
    assert bool(hits) == kept and (line != "never built a service" or hits[0]["status"] == "NEGATED")


def test_budget_order(spark):
    share = {"x y": {"s": 0.9, "t": 0.1}, "x z": {"s": 0.8, "t": 0.1}, "held one": {"t": 0.3}, "thin one": {"u": 1.0}, "same": {"s": 0.9, "t": 0.1}}
    info = {"x y": (50, 9, False), "x z": (80, 9, False), "held one": (20, 5, True), "thin one": (2, 2, False), "same": (40, 9, False)}
    rows = [("p", k, s, v, 1.0, *info[k]) for k, m in share.items() for s, v in m.items()]
    df = spark.createDataFrame(rows, "person string, keyword string, skill string, share double, idf double, listings long, companies long, held boolean")
    got = [r["keyword"] for r in market.budget_order(df).orderBy("place").collect()]
    assert got == ["held one", "x y", "same", "x z", "thin one"]
    with pytest.raises(Exception, match="ordered choice"):
        market.budget_order(df, most=3).collect()


def test_streams_in_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    days = [[(1, "a", 5), (2, "b", 1)], [(2, "c", 9), (3, "d", 2)], [(1, "e", 5), (3, "f", 3)]]
    for batch in days:
        spark.createDataFrame(batch, "id long, what string, score int").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, what string, score int").option("maxFilesPerTrigger", 1).parquet(source)
    assert sorted(r[0] for r in jobs.ledger(stream.select("id"), "id", str(tmp_path / "l")).collect()) == [1, 2, 3]
    best = jobs.latest(stream.groupBy("id").agg(F.max("score").alias("score"), F.count("*").alias("n")), "id", str(tmp_path / "u"))
    assert sorted(tuple(r) for r in best.collect()) == [(1, 5, 2), (2, 9, 2), (3, 3, 2)]


#: What has to hold of every row, and how many rows there are, for queries over whole tables that SQL can't check.
DOCUMENTS = len(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id"]))
LAWS = {
    "e3_required_years": ("years_required IS NULL OR years_required BETWEEN 0 AND 99", DOCUMENTS),
    "e4_document_statements": ("min_years BETWEEN 0 AND 99 AND (confidence = 'low' OR scope = 'overall')", None),
    "e7_remote_scope": ("remote_scope IN ('worldwide', 'remote', 'restricted', 'hybrid', 'onsite', '')", DOCUMENTS),
    "e8_regions": ("size(array_except(split(eligibility, ', '), split(regions, ', '))) = 0 OR eligibility = ''", DOCUMENTS),
    "e10_eor": ("eor IS NOT NULL", DOCUMENTS), "e11_time_zones": ("size(split(timezones, '; ')) <= 3", DOCUMENTS), "e12_tz_gap": ("tz_gap IS NULL OR tz_gap BETWEEN 0 AND 24", DOCUMENTS),
    "e15_phones": ("phones = '' OR phones RLIKE '^[+0-9; ]+$'", DOCUMENTS), "e16_enrich": ("visa IN ('yes', 'no', '') AND (remote_scope <> 'worldwide' OR remote_regions IS NOT NULL)", DOCUMENTS),
    "f7_experience_ceiling": ("arrival IS NOT NULL", None),
    "c3_status": ("status IN ('NEGATED', 'PLANNED', 'LEARNING', 'USED', 'MENTIONED') AND n > 0", None), "c4_scoped_cues": ("status IN ('NEGATED', 'PLANNED', 'LEARNING', 'USED', 'MENTIONED') AND n > 0", None),
    "c5_strength": ("claimed <= n AND uses <= claimed AND (strength = 'none') = (claimed = 0) AND (strength <> 'independent' OR entries > 1)", None),
    "c6_tier": ("tier IN ('CORE', 'STRONG_SECONDARY', 'SUPPORTING', 'BACKGROUND')", None), "c7_weight": ("weight BETWEEN 1 AND 5", None),
    "c15_document_modes": ("(strength = 'none') = (asserted = 0)", None), "c16_attachments": ("attached > 0", None),
    "c20_evidence_profile": ("weight BETWEEN 1 AND 5 AND size(split(rests_on, '/')) = 4", None), "c21_corpus_profiles": ("weight BETWEEN 1 AND 5", None),
    "m6_keywords": ("keyword LIKE '% %'", None), "m16_skill_candidates": ("place BETWEEN 1 AND 8", None),
    "m18_capped_selection": ("place BETWEEN 1 AND 2 AND evidence >= 0.5", None), "m25_people_by_market": ("place >= 1 AND tier BETWEEN 1 AND 3 AND why <> ''", None),
    "m21_budget_order": ("place BETWEEN 1 AND 8", 8), "m22_redundancy_deferral": ("place >= 1", None), "m9_title_hints": ("place BETWEEN 1 AND 40 AND hint LIKE '% %'", None),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_laws_of_queries_without_sql(spark, name):
    law, rows = LAWS[name]
    df = QUERIES[name](spark, SF).cache()
    assert df.where(f"NOT coalesce({law}, false)").count() == 0
    assert rows is None or df.count() == rows
    df.unpersist()


def test_same_evidence_in_every_query(spark):
    counts = {r["concept"]: r["n"] for r in QUERIES["c8_assess_all"](spark, SF).collect()}
    for name in ("c3_status", "c5_strength"):
        assert {r["concept"]: r["n"] for r in QUERIES[name](spark, SF).groupBy("concept").agg(F.sum("n").alias("n")).collect()} == counts
    assert QUERIES["c6_tier"](spark, SF).count() == QUERIES["c7_weight"](spark, SF).count() == QUERIES["c20_evidence_profile"](spark, SF).count()


def test_rows_that_repeat_or_lack_an_id_stand_by_themselves(spark):
    texts = [(7, "Work Experience\nAcme\n- Built services with spark."), (7, "Skills\nspark"), (None, "Education\nState College\n- Course."), (None, "Work Experience\nBeta\n- Built apps with redis."), (8, None), (9, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = E.lines(docs).collect()
    assert sum(r["doc_id"] is None for r in rows) == 6 and {(r["section"], r["entry"]) for r in rows if r["doc_id"] == 7 and not r["heading"]} == {("work", "Acme"), ("skills", "")}
    found = E.strength(E.judged(E.occurrences(E.lines(docs), {"spark": ["spark"], "redis": ["redis"]})))
    assert {(r["doc_id"], r["concept"]): (r["tier"], r["strength"], r["n"]) for r in found.collect()} == {(7, "spark"): ("CORE", "substantive", 2), (None, "redis"): ("CORE", "substantive", 1)}
    assert E.lines(docs.limit(0)).count() == 0


def test_lines_of_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "Skills\nspark")], "doc_id long, text string")
    plan = E.judged(E.occurrences(E.lines(docs), {"spark": ["spark"]}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_references_to_characters(spark):
    import html

    rng = random.Random(11)
    names = [n for n in sorted(html.entities.html5) if rng.random() < 0.15] + ["amp", "lt;", "not", "notit;", "NotEqualTilde;", "x", "", "#", "#x", "copy"]
    texts = ["".join(rng.choice(["&", "a ", "<b>"]) + rng.choice(["", "&"]) + rng.choice(names) + rng.choice(["", ";", " z"]) for _ in range(4)) for _ in range(300)]
    texts += [f"&#{n};&#x{n:x} |&#{n}" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x10000, 0x1FFFF, 0x10FFFF, 0x110000, 10**12, 10**30]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X_text.unescaped("t").alias("u")).collect()
    assert [(r["t"], r["u"]) for r in got if r["u"] != html.unescape(r["t"])] == []


def test_csv_trees_with_odd_headers(spark, tmp_path):
    files = {"a/1.csv": "﻿id,name,name\n1,x,y\n2,,z\n", "a/b/2.csv": 'name,"full, title",\n"q, r",s,t\n', "3.csv": "", "4.csv": "id,name,name\nid,name,name\n3,w\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    df = landed.drifted_csv(spark, str(tmp_path))
    assert sorted(df.columns) == ["full, title", "id", "name", "run"]
    got = sorted(((r["run"].rsplit("/", 1)[1], r["id"], r["name"], r["full, title"]) for r in df.collect()), key=repr)
    assert got == [("1.csv", "1", "x", None), ("1.csv", "2", None, None), ("2.csv", None, "q, r", "s"), ("4.csv", "3", "w", None)]
    with pytest.raises(ValueError):
        landed.drifted_csv(spark, str(tmp_path), 2)


def test_embedded_postings(spark):
    block = lambda x: f'<SCRIPT id="a" type="application/ld+json">{x}</SCRIPT>'
    pages = [(block('{"@type":"JobPosting","description":"one","datePosted":"2024-13-01"}') + "<b>Date posted:</b> 1/2/2024", "one", datetime.date(2024, 1, 2)), (block("[1, 2]") + block('{"@graph":[{"@type":"JobPosting","description":"two &lt;b&gt;x&lt;/b&gt;"}]}'), "two x", None),
             (block('{"@type":"JobPostingList","description":"no"}'), "", None), (block('{"@type":"JobPosting"}'), "", None), (block(""), "", None), ("", "", None)]
    for html, description, day in pages:
        row = spark.createDataFrame([(html,)], "h string").select(*landed.job_page("h")).first()
        assert (row["live"], row["description"], row["date_posted"]) == (True, description, day), html
    gone = spark.createDataFrame([(None, 200), ("<p>", 404), ("<p>", None)], "h string, s int").select(*landed.job_page("h", "s")).collect()
    assert sorted(r["live"] for r in gone) == [False, False, True]
