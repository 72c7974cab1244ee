"""Guards over the searches proposed for people: each only rejects or restores, gives its reason, and gives way for a person who would be left with nothing.

Tables have a row for each person and search (``q``, lower case); what a rule knows of a person or a family comes from joined tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.text import mentions

#: The largest share of the market that a search may match; postings and companies that make an unknown family real; least length of a hint.
WILDCARD_SHARE, LEAST_POSTINGS, LEAST_COMPANIES, LEAST_HINT = 0.25, 10, 3, 5


def fail_open(rows: DataFrame, keep: Column, by: str = "person") -> DataFrame:
    """The rows that a rule keeps; all rows of a person of whom it would keep none. A person has some dozens of searches."""
    left = F.max(F.when(keep, 1).otherwise(0)).over(Window.partitionBy(by))
    return rows.withColumn("_left", left).where(keep | (F.col("_left") == 0)).drop("_left")


def market_share(queries: DataFrame, titles: DataFrame, q: str = "q") -> DataFrame:
    """q, share: the part of the market's rows whose title has the words of q in a row.

    ``titles`` (title) is the market; equal titles are counted first, and a search meets only titles that have its first word.
    """
    counted = titles.groupBy("title").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    word = counted.select("title", "n", F.explode(F.array_distinct(F.split("title", " "))).alias("w"))
    asked = queries.select(q).distinct().withColumn("w", F.split_part(F.col(q), F.lit(" "), F.lit(1)))
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    hit = asked.join(word, "w").where(F.contains(padded("title"), padded(q))).groupBy(q).agg(F.sum("n").alias("hits"))
    return asked.select(q).join(hit, q, "left").crossJoin(total).select(q, F.coalesce(F.col("hits") / F.col("total"), F.lit(0.0)).alias("share"))


def contract(q: Column | str, share: Column | str, level_terms, role_terms, exempt: Column) -> Column:
    """accepted, or the first rule of the final contract that a search breaks."""
    q, share = (F.col(x) if isinstance(x, str) else x for x in (q, share))
    return (
        F.when(F.size(F.split(F.trim(q), r"\s+")) < 2, "degenerate").when(q.rlike(r"(^|\s)-\w"), "search_operator").when(share > WILDCARD_SHARE, "catalogue")
        .when(mentions(q, level_terms), "level_or_entry").when(mentions(q, role_terms) & ~exempt, "role_term_unexempted").otherwise("accepted")
    )


def revalidated(queries: DataFrame, shares: DataFrame, level_terms, role_terms) -> DataFrame:
    """person, q, rule: the final searches; a replacement that breaks the contract gives way to the fragment it replaced, if that keeps it.

    ``queries`` has person, q, fragment (null: not a replacement, not judged), exempt; ``shares`` (q, share) knows both. Where a person's
    searches are all broken replacements, they stay.
    """
    both = queries.join(shares, "q", "left").join(shares.select(F.col("q").alias("fragment"), F.col("share").alias("fragment_share")), "fragment", "left")
    rule = F.when(F.col("fragment").isNull(), "own").otherwise(contract("q", F.coalesce("share", F.lit(0.0)), level_terms, role_terms, F.col("exempt")))
    good = contract("fragment", F.coalesce("fragment_share", F.lit(0.0)), level_terms, role_terms, F.col("exempt")) == "accepted"
    judged = both.withColumn("rule", rule).withColumn("falls_back", ~F.col("rule").isin("own", "accepted") & good)
    kept = fail_open(judged, F.col("rule").isin("own", "accepted") | F.col("falls_back"))
    return kept.select("person", F.when(F.col("falls_back"), F.col("fragment")).otherwise(F.col("q")).alias("q"), F.when(F.col("falls_back"), "fragment").otherwise(F.col("rule")).alias("rule")).distinct()


def without_thin(queries: DataFrame) -> DataFrame:
    """Searches of no known family stay only with enough postings and companies; held titles and unmeasured ones stay.

    ``queries`` has person, q, family, postings, companies, held.
    """
    known = F.col("held") | F.col("family").isNotNull() | F.col("postings").isNull()
    return fail_open(queries, known | ((F.col("postings") >= LEAST_POSTINGS) & (F.col("companies") >= LEAST_COMPANIES)))


def without_orphans(queries: DataFrame, records: DataFrame) -> DataFrame:
    """Titles that come from an orphan skill go where the person's record supports other families but not theirs.

    ``queries`` has person, q, orphan, family; ``records`` person, thin, supported (array), transition (array). No record, a thin one
    or one that supports nothing judges nobody; an unknown family is not an unrelated one.
    """
    rows = queries.join(records.select("person", "thin", F.array_union("supported", "transition").alias("independent")), "person", "left")
    judges = F.coalesce(~F.col("thin") & (F.size("independent") > 0), F.lit(False))
    keep = ~F.col("orphan") | ~judges | F.col("family").isNull() | F.coalesce(F.array_contains("independent", F.col("family")), F.lit(True))
    return fail_open(rows, keep).select(*queries.columns)


def without_vetoed(queries: DataFrame, records: DataFrame, gated: list[str]) -> DataFrame:
    """Searches of a gated family that the record doesn't support go, if the record clearly shows other work.

    ``records`` adds to those of without_orphans: other (assertions of other work), titles (families of held titles), target (family). A held title
    protects its family, and so does a stated target together with training for it.
    """
    rows = queries.join(records, "person", "left")
    family = F.col("family")
    shows_other = F.coalesce(~F.col("thin") & (F.size(F.array_except("supported", F.array(*map(F.lit, gated)))) > 0) & (F.col("other") >= 2), F.lit(False))
    has = lambda c: F.coalesce(F.array_contains(c, family), F.lit(False))
    protected = has("titles") | (F.coalesce(F.col("target") == family, F.lit(False)) & has("transition"))
    keep = family.isNull() | ~family.isin(*gated) | ~shows_other | has("supported") | protected
    return fail_open(rows, F.coalesce(keep, F.lit(True))).select(*queries.columns)


def restored(candidates: DataFrame, present: DataFrame, shares: DataFrame, role_terms) -> DataFrame:
    """person, q, reason: dropped searches with a role term that get an exemption.

    ``candidates`` has person, q, source (held_title or stated_target) and strong (is the work of a stated target strongly
    evident?); ``present`` (person, q) are the searches that were not dropped. One word, or more than the wildcard share, is never granted.
    """
    asked = candidates.join(present.select("person", "q").distinct(), ["person", "q"], "left_anti").join(shares, "q", "left")
    able = mentions("q", role_terms) & (F.size(F.split("q", " ")) >= 2) & (F.coalesce("share", F.lit(0.0)) <= WILDCARD_SHARE)
    reason = F.when(F.col("source") == "held_title", "held_title").when(F.col("strong"), "corroborated_target")
    return asked.select("person", "q", F.when(able, reason).alias("reason")).where("reason IS NOT NULL").groupBy("person", "q").agg(F.max("reason").alias("reason"))


def title_gate(sources: DataFrame, floor: list[str], too_broad: tuple[str, ...] = ()) -> DataFrame:
    """person, hint, source: every hint once, from its first source; for people without any, the floor.

    ``sources`` has person, hint (null: none), source and its priority (1 first). Hints of less than the least length and too broad ones don't count.
    """
    good = F.col("hint").isNotNull() & (F.length("hint") >= LEAST_HINT) & ~F.coalesce(F.col("hint").isin(*too_broad), F.lit(False))
    hints = sources.where(good).groupBy("person", "hint").agg(F.min_by("source", "priority").alias("source"))
    without = sources.select("person").distinct().join(hints.select("person").distinct(), "person", "left_anti")
    return hints.union(without.select("person", F.explode(F.array(*map(F.lit, floor))).alias("hint"), F.lit("floor").alias("source")))


def title_fragments(title: Column | str, levels: tuple[str, ...]) -> Column:
    """The title without level words, the whole one, and the first and last two words of a longer one."""
    words = F.filter(F.split(F.col(title) if isinstance(title, str) else title, " "), lambda w: ~w.isin(*levels))
    pair = lambda at: F.array_join(F.slice(words, at, 2), " ")
    whole = F.col(title) if isinstance(title, str) else title
    return F.array_distinct(F.array_compact(F.array(F.array_join(words, " "), whole, F.when(F.size(words) > 2, pair(1)), F.when(F.size(words) > 2, pair(-2)))))
