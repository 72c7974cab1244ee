import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import lines, neardup, substrings
from gristmill.llm.common import split_by_ids
from tests.llm.conftest import EDGES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the stages use inside.
EXTRA = ("_word", "_held", "_place", "new", "hit", "key", "rep", "n", "alive", "gone", "seen")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, 1, int(i % 3 == 0)) for i in range(200, 400)] + [(None, 1, 1), (200, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    return df.select("*", *(F.lit(7).alias(x) for x in EXTRA))


def corpus():
    rng = random.Random(20)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=80)) + (" rottenest fool" if i % 3 == 0 else "")) for i in range(200, 400)]
    line, passage = "a line that stands in several documents", " ".join(f"p{k}" for k in range(60))
    rows += [(500 + k, f"{line}\n{passage} end{k}\n{' '.join(rng.choices(words, k=40))}") for k in range(4)]
    rows += [(600, rows[2][1]), (601, rows[2][1] + " more"), (None, rows[2][1]), (None, line)]
    return rows + EDGES


def test_stages_with_odd_rows(spark, folder):
    before = documents(spark, corpus())
    before.write.parquet(folder + "/documents.parquet")
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.columns == list(corpus_pipeline.COLUMNS)
        rows = [tuple(r) for r in after.collect()]
        texts[name] = {r[0]: r[1] for r in rows if r[0] is not None}
        assert sum(r[0] is None for r in rows) == sum(i is None for i, _ in corpus()), name
        before = spark.createDataFrame(rows, SCHEMA)
    clean = {i for i, t in corpus() if i is not None and "fool" not in (t or "")}
    toxic = {i for i, t in corpus() if i is not None and "fool" in (t or "")}
    assert clean <= set(texts["toxicity"]) and not toxic & set(texts["toxicity"])
    assert set(texts["line dedup"]) == set(texts["toxicity"])
    assert "a line that" in texts["line dedup"][500] and "a line that" not in texts["line dedup"][501]
    assert {1, 2, 3, 7, 500, 501, 502, 503, 202} <= set(texts["MinHash near-dedup"]) and not {600, 601} & set(texts["MinHash near-dedup"])
    assert "p30" in texts["substring dedup"][500] and "p30" not in texts["substring dedup"][501] and texts["substring dedup"][1] is None
    packed = corpus_pipeline.STAGES[-1][1](spark, before, folder)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == set(texts["substring dedup"]) | {None}
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_stages_of_nothing(spark, folder):
    empty = documents(spark, [(1, "x")]).where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_texts_beyond_one_step(documents):
    """Texts of more than the 512 KB that are read at once, and many small ones in one batch with them."""
    rng = random.Random(21)
    body = [f"t{rng.randrange(10**6)}" for _ in range(90_000)]
    shared = " ".join(body[40_000:40_070])
    rows = [(1, " ".join(body) + "\nthe same last line"), (2, " ".join(body[::-1]) + " " + shared + "\nthe same last line"), (3, shared), (4, "the same last line"), (5, " ".join(body) + "\nthe same last line")]
    docs = documents(rows).coalesce(1)
    gone = {r["doc_id"]: r["n_removed"] for r in substrings.drop_repeated_substrings(docs).collect()}
    assert gone == {1: 0, 2: 70, 3: 70, 4: 0, 5: 90_004}
    assert {r["doc_id"]: r["n_dropped"] for r in lines.drop_repeated_lines(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 2}
    assert {r["doc_id"]: r["cluster_id"] for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


@pytest.mark.parametrize("bits", [1 << 6, 1 << 20])
def test_split_by_ids_loses_nothing(spark, documents, bits):
    docs = documents([(i, str(i)) for i in range(500)] + [(None, "x")])
    ids = spark.createDataFrame([(int(i),) for i in np.arange(0, 500, 7)], "doc_id long")
    maybe, never = split_by_ids(docs, ids, least_bits=64, most_bits=bits)
    inside, outside = {r["doc_id"] for r in maybe.collect()}, {r["doc_id"] for r in never.collect()}
    assert set(range(0, 500, 7)) <= inside and None in outside and inside | outside == {*range(500), None} and not inside & outside


def bag(df):
    return sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()), key=repr)


def test_rows_that_repeat_an_id_keep_their_own_texts(spark, folder):
    """Multisets of whole rows through stages 2 to 4, against what the rules leave of each row."""
    line, passage = "common line of several documents", " ".join(f"q{k}" for k in range(55))
    lone = [" ".join(f"{c}{k}" for k in range(30)) for c in "stuvwxyz"]
    rows = [
        (1, f"{line}\n{lone[0]}"), (5, f"{line}\nalpha unique one"), (5, f"{line}\nbeta unique two"), (5, "gamma never changes at all"), (5, None), (5, ""), (None, f"{line}\n{lone[1]}"), (None, None),
        (2, f"{passage} {lone[2]}"), (6, f"{passage} {lone[3]}"), (6, f"{lone[4]} {passage}"), (6, lone[5]), (6, lone[5]), (7, lone[6]), (8, "\n".join(lone[6].split())), (8, lone[7]),
    ]
    after = dict(zip([name for name, _ in corpus_pipeline.STAGES[:-1]], [None] * 4))
    before = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        after[name] = bag(stage(spark, before, folder))
        before = spark.createDataFrame(after[name], SCHEMA)
    row = lambda i, t, n=None: (i, t, "en", "s", n if n is not None else None if t is None else len(t))
    cut = {rows[1][1]: "alpha unique one", rows[2][1]: "beta unique two"}
    lines_left = [(i, cut.get(t, t)) for i, t in rows]
    assert after["line dedup"] == sorted((row(*r) for r in lines_left), key=repr)
    near_left = [(i, t) for i, t in lines_left if i != 8]  # one of its texts is 7's: the document goes with all its rows
    assert after["MinHash near-dedup"] == sorted((row(*r) for r in near_left), key=repr)
    words_left = [(i, {rows[9][1]: lone[3], rows[10][1]: lone[4]}.get(t, t)) for i, t in near_left]
    assert after["substring dedup"] == sorted((row(*r) for r in words_left), key=repr)
    pieces = corpus_pipeline.pack(spark, spark.createDataFrame(after["substring dedup"], SCHEMA), folder)
    assert pieces.where("piece = 0").count() == len(words_left)


def test_a_carried_name_of_the_operator_is_refused(spark, folder):
    with pytest.raises(ValueError, match="n_lines"):
        lines.drop_repeated_lines(documents(spark, [(1, "x")]).withColumn("n_lines", F.lit(1)), carry=("n_lines",))
