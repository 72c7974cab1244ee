"""Concepts of documents, what the market says about them, and the weight of a tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import blank, bounded

def concept_set(text: Column | str, concepts: dict[str, list[str]]) -> Column:
    """Distinct concepts of a text, by the same rule, without their places: stays in the JVM."""
    alias = {a.lower(): c for c, names in concepts.items() for a in names}
    table = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
    hits = F.regexp_extract_all(F.lower(blank(text)), F.lit(bounded(alias, group=True)), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda a: F.element_at(table, a))))


#: Of each tier its weight, the least and the largest; the bands of the market that move it by one.
BANDS = {"CORE": (5, 4, 5), "STRONG_SECONDARY": (4, 3, 4), "SUPPORTING": (3, 2, 3), "BACKGROUND": (2, 1, 2)}
COMMON, RARE = 2, 4


def weight(tier_: Column, separation: Column) -> Column:
    """The weight of a tier, one less where the market names the term often and one more where seldom, inside the tier's band; without a separation as it is."""
    step = F.when(separation <= COMMON, -1).when(separation >= RARE, 1).otherwise(0)
    held = lambda base, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.lit(base) + step))
    return F.coalesce(*[F.when(tier_ == name, held(*band)) for name, band in BANDS.items()], held(*BANDS["SUPPORTING"]))


def market_signals(concepts: DataFrame, frequencies: DataFrame, least: int, band) -> DataFrame:
    """concept, key, separation, hits, seen of every concept (concept, keys): by its first key that enough rows were asked about; nulls where none is measurable.

    ``frequencies`` is (term, hits, seen), ``band`` makes a separation of hits and seen.
    """
    asked = concepts.select("concept", F.posexplode("keys").alias("place", "key")).select("concept", "place", F.trim(F.lower("key")).alias("key"))
    known = frequencies.where(F.col("seen") >= least).select(F.col("term").alias("key"), "hits", "seen")
    first = asked.join(known, "key").groupBy("concept").agg(F.min_by(F.struct("key", "hits", "seen"), "place").alias("m")).select("concept", "m.*")
    return concepts.select("concept").distinct().join(first, "concept", "left").select("concept", "key", band("hits", "seen").alias("separation"), "hits", "seen")
