"""Statistics of the market: terms, title fragments, lift, keyword reach.

Market rows are (row_id, title, score, company, skills). A term or fragment is counted once for each row, by exploding
the row's distinct terms and combining counts before the shuffle.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.audits import variants
from gristmill.operators.funnels import running
from gristmill.sources.shared import stored

#: Least rows behind a term's share, and the shares that part the bands of separation.
SEEN_LEAST, BANDS = 200, ((0.25, 1), (0.12, 2), (0.04, 3), (0.01, 4))
REACHABLE = 20
#: Rows of one task where rows are counted together by their id.
AT_ONCE = 1_000_000


def fragments(title: Column | str, seniority=()) -> Column:
    """Distinct runs of two and three words of a title, without words of seniority."""
    words = F.filter(F.split(F.regexp_replace(F.lower(title), "[^a-z0-9+#.]+", " "), " "), lambda w: (w != "") & ~w.isin(*seniority) if seniority else w != "")
    runs = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs(2), runs(3)))


def inner_runs(title: Column | str) -> Column:
    """Distinct parts of a title that span two or three words, cut anywhere inside the first and the last of them.

    Exactly what may equal a fragment that the title contains as a substring; an equi-join on these replaces a join on
    containment. Their number is bounded by the title's length.
    """
    words = F.split(F.lower(title), " ")
    run = lambda i, n: F.slice(words, i, n)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array(run(i, 2), run(i, 3))))
    runs = F.filter(F.array_distinct(runs), lambda r: F.size(r) >= 2)
    cut = lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r[0]), F.lit(1))), lambda a: F.transform(F.sequence(F.lit(1), F.greatest(F.length(F.element_at(r, -1)), F.lit(1))), lambda b: F.substring(F.array_join(r, " "), a, F.length(F.array_join(r, " ")) - F.length(F.element_at(r, -1)) + b - a + 1))))
    return F.array_distinct(F.flatten(F.transform(runs, cut)))


def fragment_index(rows: DataFrame, seniority=()) -> DataFrame:
    """fragment, listings, reachable, companies.

    Rows of one title and company are counted first, so fragments are made once for each of those, not for each row.
    """
    pairs = rows.groupBy("title", "company").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= REACHABLE).alias("r"))
    out = pairs.select("company", "n", "r", F.explode(fragments("title", seniority)).alias("fragment"))
    per = out.groupBy("fragment", "company").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    return per.groupBy("fragment").agg(F.sum("n").alias("listings"), F.sum("r").alias("reachable"), F.count("*").alias("companies"))


def vocabulary(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))


def term_frequency(rows: DataFrame, run: str = "run") -> DataFrame:
    """term, hits, seen: rows that carry the term, out of the rows of all runs that ever carried it."""
    per_run = rows.groupBy(run).agg(F.count("*").alias("rows"))
    hits = rows.select(run, F.explode("skills").alias("term")).groupBy(run, "term").agg(F.count("*").alias("hits"))
    return hits.join(per_run, run).groupBy("term").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("seen"))


def separation(hits: Column | str, seen: Column | str) -> Column:
    """1 (common) to 5 (rare), null for too few rows."""
    hits, seen = (F.col(x) if isinstance(x, str) else x for x in (hits, seen))
    band = F.when(F.lit(False), 0)
    for least, value in BANDS:
        band = band.when(hits / seen >= least, value)
    return F.when(seen >= SEEN_LEAST, band.otherwise(5))


def blend(centrality: Column, separation_: Column) -> Column:
    """Root of the product, rounded half to even and held between 1 and 5; without a separation the centrality stays."""
    return F.when(separation_.isNull(), centrality).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), F.bround(F.sqrt(centrality * separation_)).cast("int"))))


def idf(n: Column, total: Column) -> Column:
    return F.log(total / (1 + n))


def matching_rows(rows: DataFrame, owned: DataFrame, least: int = 2, strong: float = 7.0) -> DataFrame:
    """person, row_id, shared, evidence of the rows that share at least ``least`` skills with a person.

    If a person has any row of ``strong`` evidence, only those stay. ``owned`` is (person, skill). People meet each list of skills once, and rows meet
    the people by their list; rows of one row_id count together, which is dealt over so many tasks that one has about ``AT_ONCE`` rows.
    """
    lists = stored(rows.groupBy("skills").agg(F.count("*").alias("c")))
    terms = lists.select("skills", "c", F.explode("skills").alias("skill"))
    total = lists.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"))
    weights = terms.groupBy("skill").agg(F.sum("c").alias("n")).crossJoin(F.broadcast(total)).select("skill", idf(F.col("n"), F.col("total")).alias("idf"))
    near = stored(terms.join(owned.join(weights, "skill"), "skill").groupBy("person", "skills").agg(F.count("*").alias("shared"), F.sum("idf").alias("evidence")))
    meets = near.join(lists, "skills").agg(F.sum("c")).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), meets // AT_ONCE + 1)
    dealt = rows.select("row_id", "skills").join(near, "skills").select("person", "row_id", "shared", "evidence").repartition(tasks, "person", "row_id")
    met = dealt.groupBy("person", "row_id").agg(F.sum("shared").alias("shared"), F.sum("evidence").alias("evidence")).where(F.col("shared") >= least)
    best = met.groupBy("person").agg(F.max("evidence").alias("top"))
    return met.join(best, "person").where((F.col("top") < strong) | (F.col("evidence") >= strong)).drop("top")


def lift(rows: DataFrame, own: DataFrame, seniority=()) -> DataFrame:
    """fragment, weight, companies, share, lift of fragments in the rows ``own`` (row_id) against all rows."""
    def counts(part):
        pairs = part.groupBy("title", "company").agg(F.count("*").alias("n")).select("company", "n", F.explode(fragments("title", seniority)).alias("fragment"))
        return pairs.groupBy("fragment", "company").agg(F.sum("n").alias("n")).groupBy("fragment").agg(F.sum("n").alias("n"), F.count("*").alias("companies"))

    mine = rows.join(own, "row_id", "left_semi")
    a, b = counts(mine).select("fragment", F.col("n").alias("weight"), "companies"), counts(rows).select("fragment", F.col("n").alias("all"))
    sizes = rows.agg(F.count("*").alias("total")).crossJoin(mine.agg(F.count("*").alias("own")))
    both = a.join(b, "fragment").crossJoin(F.broadcast(sizes))
    return both.select("fragment", "weight", "companies", (F.col("all") / F.col("total")).alias("share"), ((F.col("weight") / F.col("own")) / (F.col("all") / F.col("total"))).alias("lift"))


def keyword_reach(rows: DataFrame, keywords: list[str]) -> DataFrame:
    """keyword, listings, reachable, mean score of the rows whose title contains it.

    Titles are counted first; the keywords are a bounded list that is tested in place.
    """
    titles = rows.groupBy("title").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= REACHABLE).alias("r"), F.sum("score").alias("s"))
    hits = titles.select("n", "r", "s", F.explode(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("title"), k))).alias("keyword"))
    return hits.groupBy("keyword").agg(F.sum("n").alias("listings"), F.sum("r").alias("reachable"), (F.sum("s") / F.sum("n")).alias("mean"))


def _bounded_group(pdf: pd.DataFrame, most: int) -> None:
    if len(pdf) > most:
        raise ValueError(f"a group has {len(pdf)} rows, more than the {most} that an ordered choice is meant for")


def suppressed(ranked: DataFrame, by: str, keyword: str, order: str, most: int, candidates: int = 20_000) -> DataFrame:
    """Greedy choice for each group: in order, a keyword that contains or is contained in a chosen one is left out.

    Groups are candidates of one person, a few hundred rows after the floors; one of more than ``candidates`` rows raises ValueError.
    """
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        _bounded_group(pdf, candidates)
        chosen: list[str] = []
        for word in pdf.sort_values([order, keyword])[keyword]:
            if len(chosen) < most and not any(word in x or x in word for x in chosen):
                chosen.append(word)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(chosen), keyword: chosen, "place": range(1, len(chosen) + 1)})

    kinds = dict(ranked.dtypes)
    return ranked.select(by, keyword, order).groupBy(by).applyInPandas(choose, f"{by} {kinds[by]}, {keyword} string, place long")


def budget_order(shares: DataFrame, least_listings: int = 10, least_companies: int = 3, most: int = 20_000) -> DataFrame:
    """person, keyword, place: greedy by the idf-weighted share of skills that a keyword adds to those before it.

    ``shares`` is (person, keyword, skill, share, idf, listings, companies, held), some fifty keywords a person (of more than ``most``
    rows: ValueError). Keywords with too few listings or companies wait behind all others, unless fewer than two others
    are left; of the held titles that do not wait the one that adds most leads; ties go to more listings, then to the later in the alphabet. What
    adds nothing comes after, in the order of a column ``rank``, if there is one, else of the alphabet.
    """
    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        _bounded_group(pdf, most)
        table = pdf.pivot_table(index="keyword", columns="skill", values="share", fill_value=0.0).sort_index()
        weight = pdf.groupby("skill")["idf"].first().reindex(table.columns)
        info = pdf.groupby("keyword")[["listings", "companies", "held"]].first().reindex(table.index)
        rank = pdf.groupby("keyword")["rank"].first() if "rank" in pdf else None
        words = list(table.index) if rank is None else sorted(table.index, key=lambda k: (rank[k], k))
        fit = [k for k in words if info.listings[k] >= least_listings and info.companies[k] >= least_companies]
        left = fit if len(fit) >= 2 else words
        thin = [k for k in words if k not in left]
        have, out = pd.Series(0.0, index=table.columns), []
        leads = [k for k in left if info.held[k]]
        while left:
            gains = {k: round(float(((table.loc[k] - have).clip(lower=0) * weight).sum()), 9) for k in left}
            best = max(leads or left, key=lambda k: (gains[k], info.listings[k], k))
            if gains[best] <= 0 and not leads:
                break
            leads = []
            out.append(best)
            have = have.where(have >= table.loc[best], table.loc[best])
            left.remove(best)
        out += left + thin
        return pd.DataFrame({"person": [pdf["person"].iloc[0]] * len(out), "keyword": out, "place": range(1, len(out) + 1)})

    return shares.groupBy("person").applyInPandas(order, f"person {dict(shares.dtypes)['person']}, keyword string, place long")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, rho: rank correlation with ties averaged; null for fewer than three rows or no variance.

    Ranks come from counts of distinct values, so the running sum is over values, not over rows.
    """
    def ranks(column: str, name: str) -> DataFrame:
        values = df.groupBy(column).agg(F.count("*").alias("c"))
        before = running(values, [], [column], {"before": ("sum", F.col("c"), False)})
        return before.select(column, (F.col("before") + (F.col("c") + 1) / 2).alias(name))

    both = df.select(x, y).join(ranks(x, "rx"), x).join(ranks(y, "ry"), y)
    enough = (F.count("*") >= 3) & (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0)
    return both.agg(F.when(enough, F.corr("rx", "ry")).alias("rho"))


def surface_forms(terms: DataFrame, term: str = "skill") -> DataFrame:
    """(term, form): every other spelling of distinct terms by string rules alone (joined, spaced, hyphened, in brackets, without a runtime's suffix, singular or plural)."""

    def spell(batches):
        for batch in batches:
            found = [(t, v) for t in batch.column(0).to_pylist() for v in variants(t) if v != t.lower()]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], [term, "form"])

    return terms.select(term).distinct().mapInArrow(spell, f"{term} string, form string")


def expanded(rows: DataFrame, least: int = 5, least_lift: float = 0.0) -> DataFrame:
    """skill, form, listings, together, lift: the other spellings of every skill that the market uses in ``least`` rows, with how much more often than by chance both stand in one row.

    Spellings meet the vocabulary by an equi-join; pairs of skills are counted only where one is a spelling of the other.
    """
    terms = rows.select(F.explode(F.array_distinct("skills")).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    pairs = surface_forms(terms).join(terms.select(F.col("skill").alias("form"), F.col("n").alias("listings")).where(F.col("listings") >= least), "form")
    grouped = rows.groupBy(F.array_sort(F.array_distinct("skills")).alias("skills")).agg(F.count("*").alias("c"))
    each = grouped.select("c", "skills", F.explode("skills").alias("skill")).join(pairs.select("skill", "form"), "skill")
    together = each.where(F.array_contains("skills", F.col("form"))).groupBy("skill", "form").agg(F.sum("c").alias("together"))
    total = grouped.agg(F.sum("c").alias("total"))
    out = pairs.join(together, ["skill", "form"], "left").na.fill(0, ["together"]).join(terms, "skill").crossJoin(F.broadcast(total))
    return out.select("skill", "form", "listings", "together", (F.col("together") * F.col("total") / (F.col("n") * F.col("listings"))).alias("lift")).where(F.col("lift") >= least_lift)


def _bound(fraction: float) -> str:
    return f"{round(fraction * 65536):04x}"


def nested_sample(rows: DataFrame, fraction: float, key: str = "row_id") -> DataFrame:
    """About a fraction of the rows, chosen by a digest of their key: a smaller sample is part of every larger one."""
    return rows.where(F.left(F.md5(F.col(key).cast("string")), F.lit(4)) < _bound(fraction)) if fraction < 1 else rows


def size_curve(rows: DataFrame, fractions: tuple[float, ...], seniority=(), least_companies: int = 5) -> DataFrame:
    """fraction, rows, skills, fragments, recall, error: what a corpus of each size (``nested_sample``) knows, against the whole.

    fragments: those of ``least_companies`` employers or more; recall: how many of the whole corpus's they find; error: the mean difference of the shares of skills.
    Samples are nested, so the smallest that holds a row says which others do: the rows are read twice, however many fractions there are.
    """
    bounds = sorted({_bound(f) for f in fractions if f < 1})
    whole = len(bounds)
    levels, at = range(whole + 1), {f: bounds.index(_bound(f)) if f < 1 else whole for f in fractions}
    level = F.lit(whole)
    for k in reversed(range(whole)):
        level = F.when(F.col("_digest") < bounds[k], k).otherwise(level)
    placed = rows.select("title", "company", "skills", F.left(F.md5(F.col("row_id").cast("string")), F.lit(4)).alias("_digest")).withColumn("level", level)
    pairs = stored(placed.groupBy("title", "company").agg(F.min("level").alias("level")))
    pieces = pairs.select("title").distinct().select("title", F.explode(fragments("title", seniority)).alias("fragment"))
    employers = pairs.join(pieces, "title").groupBy("fragment", "company").agg(F.min("level").alias("level")).groupBy("fragment").agg(*[F.count_if(F.col("level") <= k).alias(f"c{k}") for k in levels])
    found = employers.agg(*[F.count_if(F.col(f"c{k}") >= least_companies).alias(f"f{k}") for k in levels])
    sets = stored(placed.groupBy("skills").agg(*[F.count_if(F.col("level") <= k).alias(f"n{k}") for k in levels]))
    sizes = sets.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"r{k}") for k in levels])
    terms = sets.select(F.explode("skills").alias("skill"), *[f"n{k}" for k in levels]).groupBy("skill").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in levels]).crossJoin(F.broadcast(sizes))
    off = lambda k: F.abs(F.coalesce(F.try_divide(f"n{k}", f"r{k}"), F.lit(0.0)) - F.col(f"n{whole}") / F.col(f"r{whole}"))
    uses = terms.agg(*[F.count_if(F.col(f"n{k}") > 0).alias(f"s{k}") for k in levels], *[F.avg(off(k)).alias(f"e{k}") for k in levels])
    one = lambda f, k: F.struct(F.lit(f).alias("fraction"), F.col(f"r{k}").alias("rows"), F.col(f"s{k}").alias("skills"), F.col(f"f{k}").alias("fragments"), F.try_divide(f"f{k}", f"f{whole}").alias("recall"), F.col(f"e{k}").alias("error"))
    return sizes.crossJoin(found).crossJoin(uses).select(F.inline(F.array(*[one(float(f), k) for f, k in at.items()])))


def held_out(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """person, rows, kept: how many rows a market has, and how many would be left had none that names a person's skills been seen.

    Rows with equal skills are counted first; a person meets the sets of skills by an equi-join on skills.
    """
    sets = rows.groupBy(F.array_sort(F.array_distinct("skills")).alias("skills")).agg(F.count("*").alias("c"))
    met = sets.select("skills", "c", F.explode("skills").alias("skill")).join(owned.select("person", "skill").distinct(), "skill").select("person", "skills", "c").distinct()
    gone = met.groupBy("person").agg(F.sum("c").alias("gone"))
    total = sets.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"))
    return owned.select("person").distinct().join(gone, "person", "left").crossJoin(F.broadcast(total)).select("person", "rows", (F.col("rows") - F.coalesce("gone", F.lit(0))).alias("kept"))
