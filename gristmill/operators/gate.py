"""Which terms of a vocabulary a document really claims: structure decides, and every kept term says why.

Terms are looked up line by line, with the section of the line; all that is said of a document and a term is one aggregate over their hits. The vocabulary
is a bounded list (a pattern); pairs of a term and its initials come from a join of the vocabulary with itself on the initials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import blank
from gristmill.operators.audits import spellings, vocabulary_hits
from gristmill.operators.evidence import SKILLS, lines

#: Why a term is kept, and what makes it central.
LISTED, REPEATED, USED = "listed under skills", "named more than once", "used in experience or projects"
MOST_TERMS = 5000


def abbreviations(vocabulary: DataFrame) -> DataFrame:
    """(term, partner): every term of several words with the term that its initials are, both ways."""
    words = F.filter(F.split("term", r"\s+"), lambda w: w != "")
    long = vocabulary.select("term", words.alias("w")).where(F.size("w") > 1).select("term", F.array_join(F.transform("w", lambda w: F.left(w, F.lit(1))), "").alias("partner"))
    pairs = long.join(vocabulary.select(F.col("term").alias("partner")), "partner").where("term <> partner").select("term", "partner").distinct()
    return pairs.union(pairs.select(F.col("partner").alias("term"), F.col("term").alias("partner")))


def hits(docs: DataFrame, terms: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, term, how, listed, used, times: every term a document holds; how it stands there, whether under skills and elsewhere as itself, and how often its letters stand there."""
    if len(terms) > MOST_TERMS:
        raise ValueError(f"a vocabulary of {len(terms)} terms, more than the {MOST_TERMS} of one pattern")
    low = F.lower(blank("body"))
    rows = lines(docs, doc, text).where(low.rlike(spellings(terms)[1]))
    each = rows.select(doc, "section", "heading", low.alias("low"), F.explode(F.filter(F.split(vocabulary_hits("body", terms), ";"), lambda x: x != "")).alias("_hit"))
    term, how = F.substring_index("_hit", "=", 1), F.substring_index("_hit", "=", -1)
    exact = ~F.col("how").contains(":")
    each = each.select("*", term.alias("term"), how.alias("how"))
    times = F.floor((F.length("low") - F.length(F.replace("low", F.lower("term"), F.lit("")))) / F.length("term"))
    rank = F.when(~exact, 2).otherwise(0) + F.when(F.col("how").startswith("boundary"), 0).otherwise(1)
    return each.groupBy(doc, "term").agg(
        F.min_by("how", F.struct(rank, F.col("how"))).alias("how"), F.bool_or(exact & ~F.col("heading") & (F.col("section") == SKILLS)).alias("listed"),
        F.bool_or(exact & ~F.col("heading") & (F.col("section") != SKILLS)).alias("used"), F.sum(times).cast("long").alias("times"))


def gated(found: DataFrame, pairs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, term, why, centrality, rests_on of the hits that clear the gate: listed under skills, or its initials or expansion is, or named on boundaries and more than once.

    The centrality is 1, and 2 more if listed, 1 more if repeated, 1 more if used outside the list. ``found`` is read once: a listed hit hands its name on to
    its initials or expansion, and both meet in an aggregate.
    """
    partners = pairs.groupBy(F.col("partner").alias("term")).agg(F.collect_set("term").alias("_of"))
    own = F.struct("term", F.struct(*[c for c in found.columns if c not in (doc, "term")]).alias("row"), F.lit(None).cast("string").alias("partner"))
    told = F.when(F.col("listed") & F.col(doc).isNotNull(), F.transform("_of", lambda t: F.struct(t.alias("term"), F.lit(None).alias("row"), F.col("term").alias("partner"))))
    each = found.join(partners, "term", "left").select(doc, F.inline(F.concat(F.array(own), F.coalesce(told, F.array()))))
    rows = each.groupBy(doc, "term").agg(F.max("row").alias("row"), F.min("partner").alias("partner")).where("row IS NOT NULL").select(doc, "term", "row.*", "partner")
    repeated = F.col("times") > 1
    why = F.when(F.col("listed"), LISTED).when(F.col("partner").isNotNull(), F.concat(F.lit("its expansion '"), F.col("partner"), F.lit("' is "), F.lit(LISTED))).when((F.col("how") == "boundary") & repeated, REPEATED)
    listed = F.col("listed") | F.col("partner").isNotNull()
    score = F.lit(1) + F.when(listed, 2).otherwise(0) + F.when(repeated, 1).otherwise(0) + F.when(F.col("used"), 1).otherwise(0)
    rests = F.array_join(F.array_compact(F.array(F.when(listed, LISTED), F.when(repeated, REPEATED), F.when(F.col("used"), USED))), ", ")
    return rows.withColumn("why", why).where("why IS NOT NULL").select(doc, "term", "why", score.alias("centrality"), rests.alias("rests_on"))


def widened(profiles: DataFrame, kept: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, term, weight, added: the terms of profiles (doc, term, weight), and behind them the kept ones that they don't have, with their centrality and why."""
    own = profiles.select(doc, "term", F.col("weight").cast("int").alias("weight"), F.lit("").alias("added"))
    have = profiles.select(doc, F.trim(F.lower("term")).alias("term"))
    new = kept.join(have, [doc, "term"], "left_anti").select(doc, "term", F.col("centrality").alias("weight"), F.col("why").alias("added"))
    return own.union(new)


def vocabulary_of(spark: SparkSession, terms: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms], "term string")
