"""Queries that once read a part of their tables: rows outside that part count."""

import datetime
import random

import duckdb
import pytest

from gristmill.plans import all_queries

QUERIES, SQL = all_queries()
LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"
ORDERS = "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double"


def saved(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_company_split_reads_every_line(spark, tmp_path):
    rows = [(50, 1, 1, 7, 1.0, "A"), (51, 1, 1, 7, 1.0, "R"), (3, 1, 1, 8, 1.0, "R"), (4, 1, 1, 9, 1.0, "A"), (4, 2, 1, 9, 1.0, "N")]
    sf = saved(spark, tmp_path, lineitem=(rows, LINES))
    got = {tuple(r) for r in QUERIES["d14_company_split"](spark, sf).select("part", "companies", "rows").collect()}
    assert got == {("both", 1, 2), ("paid-only", 1, 1), ("already-free", 1, 2)}


def test_twins_of_every_unit(spark, tmp_path):
    rng = random.Random(4)
    units = [(k, rng.randrange(280)) for k in rng.sample(range(1900, 9000), 300)]
    lines = [(k, n, rng.randrange(6), rng.randrange(4), 1.0, "A") for k, _ in units[:-20] for n in range(1, rng.randint(2, 6))]
    sf = saved(spark, tmp_path, orders=([(k, c, "1", "F", 1.0) for k, c in units], ORDERS), lineitem=(lines, LINES))
    keys = {}
    for k, _, part, supplier, *_ in lines:
        keys.setdefault(k, set()).add((part, supplier % 3))
    right = sorted((a, b, len(keys[a] & keys[b])) for a, c in units for b, e in units if a in keys and b in keys and c % 40 == e % 40 and c % 7 == 0 and e % 7 and b < a)
    got = sorted(tuple(r) for r in QUERIES["d18_twins"](spark, sf).select("remote", "twin", "shared").collect())
    assert got == right and any(b >= 2000 and n for _, b, n in right)


def test_titles_are_whole_first_lines(spark, tmp_path):
    same = "lorem ipsum dolor sit amet " * 4
    rows = [(1, same + "alpha\nrest", "en", "src1", 9), (2, same + "beta\nrest", "en", "src1", 9), (3, same + "alpha\nother", "en", "src1", 9)]
    sf = saved(spark, tmp_path, documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    keys = {r["arrival"]: r["key"] for r in QUERIES["d3_job_key"](spark, sf).collect()}
    assert keys[1] == keys[3] != keys[2]
    assert QUERIES["d4_rank_dedupe"](spark, sf).count() == 2


def test_only_closed_references_are_resolved_as_in_sql(spark, tmp_path):
    html = ["<p>this &amp</p><p>that &lt x &amp; &lt;b&gt;y</p>", "a&nbsp; b  &#39;c&#39 &quot;d&quot", "x &amp;nbsp; &ampy; &middot;", None]
    sf = saved(spark, tmp_path, pages=([(k, "u", x) for k, x in enumerate(html)], "page_id long, url string, html string"))
    pages = duckdb.connect()
    pages.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["s8_html_to_text"](spark, sf).select("page_id", "text").collect())
    assert got == sorted(pages.execute(SQL["s8_html_to_text"]).fetchall()) and got[0][1].startswith("this &amp that &lt x & y")


def test_ledger_keeps_the_last_word_on_every_key(spark, tmp_path):
    moments = [datetime.datetime(2024, 1, day) for day in (1, 2, 3)]
    events = [(1, moments[0], 7, "signup"), (2, moments[1], 7, "error"), (3, moments[2], 8, "signup"), (4, moments[0], 8, "error"), (5, moments[2], 9, "view"), (6, moments[1], 10, "error")]
    sf = saved(spark, tmp_path, events=(events, "event_id long, ts timestamp_ntz, user_id long, event_type string"))
    got = {r["user_id"]: (r["last_type"], r["last_ts"]) for r in QUERIES["d7_applied_ledger"](spark, sf).collect()}
    assert got == {7: ("error", moments[1]), 8: ("signup", moments[2]), 10: ("error", moments[1])}
    assert [r["key"] for r in QUERIES["d7_standing_entries"](spark, sf).collect()] == [8]
