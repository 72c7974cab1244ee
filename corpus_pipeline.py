"""A corpus from raw documents: five stages, each over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
folder and reads it again as the next stage's docs. All but the last return the columns of documents
(doc_id, text, lang, source, n_chars); n_chars follows a changed text.

1. toxicity: documents whose score is at least 0.5 go.
2. line dedup: repeated lines go from all documents but the first that holds them.
3. near dedup: one document of each group of near copies stays, the one with the smallest doc_id.
4. substring dedup: words inside windows of 50 that a smaller doc_id holds too go; unaffected texts stay as they are.
5. packing: what is left, as pieces in sequences of 1024 tokens.

Rows that repeat a doc_id are each rewritten by themselves in stages 2 and 4, and go together in stage 3, where a document has the
texts of all its rows. Rows with a null doc_id pass stages 1 to 4 unchanged in what they hold (they can't be compared by doc_id), except
where toxic. Texts that lose all lines or words stay as empty documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import lines, neardup, packing, substrings, toxicity
from gristmill.llm.common import split_by_ids, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRY = ("lang", "source", "n_chars")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.learn(docs, spark.read.parquet(table(sf_dir, "labels")))
    return docs.where(toxicity.score_column(docs, lexicon) < 0.5).select(*COLUMNS)


def _texts(rewritten: DataFrame, changes: str) -> DataFrame:
    """The columns of documents of rows that an operator has rewritten, each by itself; n_chars follows where something went."""
    n_chars = F.when(F.col(changes) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rewritten.withColumn("n_chars", n_chars).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _texts(lines.drop_repeated_lines(docs, carry=CARRY), "n_dropped")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = written(neardup.near_duplicates(docs).where("NOT kept").select("doc_id"), "near_copies")
    maybe, never = split_by_ids(docs.select(*COLUMNS), gone)
    return maybe.join(gone, "doc_id", "left_anti").union(never)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _texts(substrings.drop_repeated_substrings(docs, carry=CARRY), "n_removed")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("substring dedup", dedup_substrings),
    ("best-fit packing", pack),
]

#: The score of the first stage is learnt, and the third follows signatures: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table(sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
