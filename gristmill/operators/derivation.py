"""Search keywords derived for many people at once from what the market posts.

Skills are cleaned; the rows that want them give distinctive title fragments; fragments become real titles; titles are validated; skills that nobody
searches for get titles of their own; tiers are ranked and ordered by what a budget reaches. Every stage is a table keyed by person (or by skill, for
what all people share), and only ordered choices among one person's or one skill's few candidates run in a bounded group.

Market rows are first counted by (title, skills), and by (title, company) where companies matter; whether a title holds a keyword is asked once for each distinct title and keyword, by a
join on short pieces of both.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.market import REACHABLE, _bounded_group, budget_order, fragments, idf, suppressed
from gristmill.sources.shared import stored


@dataclass(frozen=True)
class Rules:
    """Floors and ceilings of the derivation."""

    shared: int = 2
    strong: float = 7.0
    weight: float = 10.0
    companies: int = 5
    share: float = 0.25
    keywords: int = 12
    top: int = 80
    of_skill: float = 0.02
    skill_lift: float = 10.0
    titles: int = 8
    orphan_listings: int = 15
    orphan_companies: int = 8
    represented: float = 0.10
    orphans: int = 8
    rows: int = 20
    evidence: float = 1.2
    anchored: int = 2
    prior: float = 20.0
    unmeasured: int = 1


@dataclass(frozen=True)
class Market:
    """Tables of one market with rows (title, score, company, skills), each written once, when it is first asked for.

    No table holds titles, companies and skills at once, of which there may be as many as rows: most of what is asked needs no companies.
    """

    rows: DataFrame
    seniority: tuple[str, ...] = ()

    @cached_property
    def lists(self) -> DataFrame:
        """title, skills (distinct, sorted), n, r: rows and those worth reading."""
        return stored(self.rows.groupBy("title", F.sort_array(F.array_distinct("skills")).alias("skills")).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= REACHABLE).alias("r")))

    @cached_property
    def titles(self) -> DataFrame:
        """title, n, r."""
        return stored(self.lists.groupBy("title").agg(F.sum("n").alias("n"), F.sum("r").alias("r")))

    @cached_property
    def uses(self) -> DataFrame:
        """title, skill, n."""
        return stored(self.lists.select("title", "n", F.explode("skills").alias("skill")).groupBy("title", "skill").agg(F.sum("n").alias("n")))

    @cached_property
    def skills(self) -> DataFrame:
        """skill, n."""
        return stored(self.uses.groupBy("skill").agg(F.sum("n").alias("n")))

    @cached_property
    def employers(self) -> DataFrame:
        """skill, n, employers."""
        each = self.rows.select("company", F.explode("skills").alias("skill")).distinct().groupBy("skill").agg(F.count("company").alias("employers"))
        return stored(self.skills.join(each, "skill"))

    @cached_property
    def firms(self) -> DataFrame:
        """title, company, n."""
        return stored(self.rows.groupBy("title", "company").agg(F.count("*").alias("n")))

    @cached_property
    def index(self) -> DataFrame:
        """fragment, listings, companies."""
        pieces = self.titles.select("title", F.explode(fragments("title", self.seniority)).alias("fragment"))
        per = self.firms.join(pieces, "title").groupBy("fragment", "company").agg(F.sum("n").alias("n"))
        return stored(per.groupBy("fragment").agg(F.sum("n").alias("listings"), F.count("company").alias("companies")))

    @cached_property
    def canon(self) -> DataFrame:
        """fragment, canonical."""
        return stored(canonical_titles(self.titles, self.index.select("fragment"), self.seniority))

    @cached_property
    def total(self) -> DataFrame:
        """total, one row."""
        return stored(self.lists.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")))


def held_in(titles: DataFrame, terms: DataFrame, title: str = "title", term: str = "term") -> DataFrame:
    """(term, title): the titles that contain a term anywhere, of two tables of distinct strings.

    A term is looked up by its first three characters (all of it, if shorter) among the pieces of as many characters of a title; a title has about as many
    of these as it has characters, so nothing is compared with everything.
    """
    pieces = lambda n: F.when(F.length(title) >= n, F.transform(F.sequence(F.lit(1), F.length(title) - n + 1), lambda i: F.substring(F.col(title), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    cut = titles.select(title, F.explode(F.array_distinct(F.concat(pieces(1), pieces(2), pieces(3)))).alias("_piece"))
    key = terms.where(F.col(term) != "").select(term, F.left(term, F.lit(3)).alias("_piece"))
    return key.join(cut, "_piece").where(F.contains(F.col(title), F.col(term))).select(term, title)


def canonical_titles(titles: DataFrame, frags: DataFrame, seniority: tuple[str, ...] = (), most_words: int = 4) -> DataFrame:
    """(fragment, canonical): of the titles of two to four words that hold a fragment the most common, then of fewest words, then first in the alphabet.

    A title with a word of seniority counts only where there is no other, and then without that word, if such a title exists; else the fragment has none.
    """
    words = F.split("title", " ")
    fit = titles.where(F.size(words).between(2, most_words)).select("title", "n", F.exists(words, lambda w: w.isin(*seniority)).alias("senior") if seniority else F.lit(False).alias("senior"))
    plain = F.array_join(F.filter(words, lambda w: ~w.isin(*seniority)), " ") if seniority else F.col("title")
    best = held_in(fit, frags, term="fragment").join(fit, "title").groupBy("fragment").agg(F.min(F.struct("senior", (-F.col("n")).alias("n"), F.size(words).alias("words"), "title")).alias("b"))
    named = best.select("fragment", F.col("b.senior").alias("senior"), F.col("b.title").alias("title")).withColumn("canonical", plain)
    known = titles.select(F.col("title").alias("canonical"), F.lit(True).alias("known"))
    return named.join(known, "canonical", "left").where("NOT senior OR (known AND canonical <> '')").select("fragment", "canonical")


def market_of(rows: DataFrame, seniority: tuple[str, ...] = ()) -> Market:
    """The tables of a market from its rows (title, score, company, skills)."""
    return Market(rows, tuple(seniority))


def _with_total(df: DataFrame, market: Market) -> DataFrame:
    return df.crossJoin(F.broadcast(market.total))


def clean(owned: DataFrame, market: Market, concepts: tuple[str, ...]) -> DataFrame:
    """(person, skill) without terms that only name a concept, unless the market uses them as a skill."""
    term = F.trim(F.lower("skill"))
    known = market.skills.select("skill", F.lit(True).alias("known"))
    rows = owned.select("person", term.alias("skill")).where("skill <> ''").distinct().join(known, "skill", "left")
    named = F.arrays_overlap(F.regexp_extract_all("skill", F.lit("([a-z0-9+#.]+)"), F.lit(1)), F.array(*map(F.lit, concepts)))
    return rows.where(F.coalesce("known", F.lit(False)) | ~named).select("person", "skill")


def corpus_scores(own: DataFrame, market: Market, rules: Rules = Rules()) -> DataFrame:
    """person, fragment, weight, score of the fragments that pass every floor: lift among the rows that want a person's skills, times the part that is worth reading.

    Rows want a person if they share ``shared`` skills; if any reaches ``strong`` evidence, only such rows count. A row weighs its evidence, 1 at least.
    """
    sets = market.lists.select("skills").distinct()
    weight = _with_total(market.skills, market).select("skill", idf(F.col("n"), F.col("total")).alias("idf"))
    met = sets.select("skills", F.explode("skills").alias("skill")).join(own.join(weight, "skill"), "skill").groupBy("person", "skills").agg(F.count("*").alias("shared"), F.sum("idf").alias("evidence")).where(F.col("shared") >= rules.shared)
    top = met.groupBy("person").agg(F.max("evidence").alias("top"))
    met = met.join(top, "person").where((F.col("top") < rules.strong) | (F.col("evidence") >= rules.strong)).select("person", "skills", F.greatest(F.lit(1.0), "evidence").alias("w"))
    wanted = market.lists.join(met, "skills").groupBy("person", "title").agg(F.sum(F.col("w") * F.col("n")).alias("w"), F.sum(F.col("w") * F.col("r")).alias("wr"))
    whole = wanted.groupBy("person").agg(F.sum("w").alias("whole"))
    pieces = wanted.select("person", "w", "wr", F.explode(fragments("title", market.seniority)).alias("fragment")).groupBy("person", "fragment").agg(F.sum("w").alias("weight"), F.sum("wr").alias("reach"))
    found = _with_total(pieces.where(F.col("weight") >= rules.weight).join(market.index.where(F.col("companies") >= rules.companies), "fragment").join(whole, "person"), market)
    share = F.col("listings") / F.col("total")
    lift = (F.col("weight") / F.col("whole")) / share
    return found.where((share <= rules.share) & (lift > 1)).select("person", "fragment", "weight", (lift * F.col("reach") / F.col("weight")).alias("score"))


def corpus_titles(scores: DataFrame, market: Market, rules: Rules = Rules()) -> DataFrame:
    """(person, keyword, place): the best fragments, none inside another, as the titles they stand for, each once."""
    order = Window.partitionBy("person").orderBy(F.desc(F.round("score", 9)), F.desc(F.round("weight", 9)), "fragment")
    placed = scores.withColumn("order", F.row_number().over(order))
    chosen = suppressed(placed.withColumnRenamed("fragment", "keyword"), "person", "keyword", "order", rules.keywords)
    return chosen.withColumnRenamed("keyword", "fragment").join(market.canon, "fragment").groupBy("person", F.col("canonical").alias("keyword")).agg(F.min("place").alias("place"))


def profiled(terms: DataFrame, market: Market, hard: tuple[str, ...] = ()) -> DataFrame:
    """term, listings, reachable, wasted, share, precision of every distinct term: the rows whose title contains it."""
    title = F.col("title")
    titles = market.titles.withColumn("lost", F.when(title.rlike(rf"(?<![a-z])(?:{'|'.join(hard)})(?![a-z])"), F.col("n")).otherwise(0) if hard else F.lit(0))
    distinct = terms.select("term").distinct()
    found = held_in(market.titles.select("title"), distinct).join(titles, "title").groupBy("term").agg(F.sum("n").alias("listings"), F.sum("r").alias("reachable"), F.sum("lost").alias("wasted"))
    rows = _with_total(distinct.join(found, "term", "left").na.fill(0, ["listings", "reachable", "wasted"]), market)
    return rows.select("term", "listings", "reachable", "wasted", F.when(F.col("total") > 0, F.col("listings") / F.col("total")).otherwise(0.0).alias("share"), F.when(F.col("listings") > 0, F.col("reachable") / F.col("listings")).alias("precision"))


#: The reasons of corrections.
WILDCARD, HARD, OWN_SKILL, OWN_TARGET, SENIORITY, STEM, LEAKY, HALF = "wildcard", "hard-drop word", "own skill", "own target", "seniority", "stem missing", "below the market", "empty half"


def checked(fields: DataFrame, market: Market, hard: tuple[str, ...], soft: tuple[str, ...], rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """(corrections, decisions) of the profiles in ``fields`` (person, field, term), one row for each term of a field.

    corrections: person, field, action (dropped, added, computed), term, reason. Five checks: keywords that buy the catalogue or carry a hard word; penalties on an own
    skill; title exclusions that hit an own target or name seniority; hints without their stem; domain titles that reach less than the market, and a
    bonus of two halves of which one is empty. decisions: person, decision (accept, corrected, escalate); a person more than half of whose keywords are bad is
    escalated and gets no corrections.
    """
    rows = fields.select("person", "field", "term", F.trim(F.lower("term")).alias("low")).where("term IS NOT NULL")
    of = lambda *names: rows.where(F.col("field").isin(*names))
    word = lambda words: F.arrays_overlap(F.split(F.regexp_replace("low", "[-.]", " "), r"\s+"), F.array(*map(F.lit, words))) if words else F.lit(False)
    measured = profiled(of("role_keywords", "domain_title_terms").select(F.col("low").alias("term")), market).withColumnRenamed("term", "low")
    fix = lambda df, action, reason: df.select("person", "field", F.lit(action).alias("action"), "term", F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"))

    spent = of("role_keywords").join(measured, "low", "left").withColumn("reason", F.when(F.col("share") > rules.share, WILDCARD).when(word(hard), HARD))
    verdict = spent.groupBy("person").agg((F.count("reason") > 0.5 * F.count("*")).alias("stop"))
    keywords = fix(spent.where("reason IS NOT NULL"), "dropped", F.col("reason"))
    skills = of("skill_weights").select("person", "low").distinct()
    penalties = fix(of("penalty_terms").join(skills, ["person", "low"], "left_semi"), "dropped", OWN_SKILL)
    targets = of("role_keywords", "title_hints").groupBy("person").agg(F.collect_set("low").alias("targets"))
    excluded = of("title_exclude").join(targets, "person", "left").withColumn("reason", F.when(F.exists(F.coalesce("targets", F.array().cast("array<string>")), lambda t: F.contains(t, F.col("low"))), OWN_TARGET).when(word((*hard, *soft)), SENIORITY))
    exclusions = fix(excluded.where("reason IS NOT NULL"), "dropped", F.col("reason"))
    stem = F.array_join(F.filter(F.split("low", r"\s+"), lambda w: ~w.isin(*soft)) if soft else F.split("low", r"\s+"), " ")
    stems = of("title_hints").select("person", "field", F.trim(stem).alias("stem"), "low").where("stem <> '' AND stem <> low").select("person", "field", "stem").distinct()
    hints = fix(stems.join(of("title_hints").select("person", F.col("low").alias("stem")), ["person", "stem"], "left_anti").withColumnRenamed("stem", "term"), "added", STEM)
    bar = market.titles.agg((F.sum("r") / F.sum("n")).alias("bar"))
    domain = fix(of("domain_title_terms").join(measured, "low").crossJoin(F.broadcast(bar)).where((F.col("listings") > rules.unmeasured) & (F.col("precision") < F.col("bar"))), "dropped", LEAKY)
    halves = rows.groupBy("person").agg(F.max(F.when(F.col("field") == "domain_bonus", F.col("term"))).alias("term"), F.count_if(F.col("field") == "domain_half_a").alias("a"), F.count_if(F.col("field") == "domain_half_b").alias("b"))
    bonus = fix(halves.where("coalesce(try_cast(term AS DOUBLE), 0) <> 0 AND (a = 0 OR b = 0)").withColumn("field", F.lit("domain_bonus")), "computed", HALF)
    stopped = verdict.where("stop").select("person")
    found = stored(keywords.union(penalties).union(exclusions).union(hints).union(domain).union(bonus).join(stopped, "person", "left_anti"))
    state = rows.select("person").distinct().join(stopped.withColumn("stop", F.lit(True)), "person", "left").join(found.select("person").distinct().withColumn("fixed", F.lit(True)), "person", "left")
    return found, state.select("person", F.when(F.col("stop"), "escalate").when(F.col("fixed"), "corrected").otherwise("accept").alias("decision"))


def valid_keywords(keywords: DataFrame, market: Market, hard: tuple[str, ...] = (), rules: Rules = Rules()) -> DataFrame:
    """keywords (person, keyword, ...) without those that the check of keywords drops; a person more than half of whose keywords are bad keeps none."""
    corrections, decisions = checked(keywords.select("person", F.lit("role_keywords").alias("field"), F.col("keyword").alias("term")), market, hard, (), rules)
    fine = keywords.join(decisions.where("decision <> 'escalate'").select("person"), "person", "left_semi")
    return fine.join(corrections.select("person", F.col("term").alias("keyword")), ["person", "keyword"], "left_anti")


def skill_titles(market: Market, rules: Rules = Rules()) -> DataFrame:
    """(skill, title, order, lift): for every skill the titles that its commonest fragments stand for and that want it ``skill_lift`` times as much as the market."""
    here = market.uses.select("skill", "n", F.explode(fragments("title", market.seniority)).alias("fragment")).groupBy("skill", "fragment").agg(F.sum("n").alias("here"))
    order = Window.partitionBy("skill").orderBy(F.desc("here"), "fragment")
    most = here.withColumn("i", F.row_number().over(order)).where(F.col("i") <= rules.top)
    named = most.join(market.skills.select("skill", F.col("n").alias("named")), "skill").join(market.index, "fragment")
    named = _with_total(named, market).where((F.col("here") >= rules.of_skill * F.col("named")) & (F.col("companies") >= rules.orphan_companies) & (F.col("listings") <= rules.share * F.col("total")))
    candidates = stored(named.join(market.canon, "fragment").groupBy("skill", F.col("canonical").alias("title")).agg(F.min("i").alias("order")))
    return candidates.join(wanted(candidates.select("title", "skill"), market), ["title", "skill"]).where(F.col("lift") >= rules.skill_lift).select("skill", "title", "order", "lift")


def wanted(pairs: DataFrame, market: Market) -> DataFrame:
    """title, skill, listings, named, share, lift, evidence of distinct (title, skill): how the rows whose title contains it want the skill."""
    distinct = pairs.select("title").distinct().withColumnRenamed("title", "term")
    reach = stored(held_in(market.titles.select("title"), distinct))
    listings = reach.join(market.titles, "title").groupBy("term").agg(F.sum("n").alias("listings"))
    asked = pairs.select(F.col("title").alias("term"), "skill").distinct()
    named = reach.join(asked, "term").join(market.uses, ["title", "skill"]).groupBy("term", "skill").agg(F.sum("n").alias("named"))
    rows = _with_total(asked.join(listings, "term").join(named, ["term", "skill"], "left").join(market.skills.select("skill", F.col("n").alias("whole")), "skill"), market)
    share = F.coalesce("named", F.lit(0)) / F.col("listings")
    return rows.select(F.col("term").alias("title"), "skill", "listings", F.coalesce("named", F.lit(0)).alias("named"), share.alias("share"), (share / (F.col("whole") / F.col("total"))).alias("lift"), (share * idf(F.col("whole"), F.col("total"))).alias("evidence"))


def skill_candidates(titles: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(skill, title, place): in order, no title inside another, ``titles`` at most for a skill; a group has ``top`` rows at most."""
    return suppressed(titles.withColumnRenamed("title", "keyword"), "skill", "keyword", "order", rules.titles).withColumnRenamed("keyword", "title")


def orphans(own: DataFrame, base: DataFrame, market: Market, rules: Rules = Rules()) -> DataFrame:
    """(person, skill, listings, share): skills with enough listings and employers that the rows a person's keywords buy hardly name."""
    reach = stored(held_in(market.titles.select("title"), base.select(F.col("keyword").alias("term")).distinct()))
    bought = base.select("person", F.col("keyword").alias("term")).join(reach, "term").select("person", "title").distinct()
    whole = bought.join(market.titles, "title").groupBy("person").agg(F.sum("n").alias("bought"))
    enough = market.employers.where((F.col("n") >= rules.orphan_listings) & (F.col("employers") >= rules.orphan_companies)).select("skill", F.col("n").alias("listings"))
    mine = own.join(enough, "skill")
    named = bought.join(market.uses, "title").join(mine.select("person", "skill"), ["person", "skill"]).groupBy("person", "skill").agg(F.sum("n").alias("named"))
    rows = mine.join(whole, "person", "left").join(named, ["person", "skill"], "left").withColumn("share", F.coalesce(F.col("named") / F.col("bought"), F.lit(0.0)))
    return rows.where(F.col("share") < rules.represented).select("person", "skill", "listings", "share")


def anchor_scores(lonely: DataFrame, candidates: DataFrame, base: DataFrame, market: Market, rules: Rules = Rules()) -> DataFrame:
    """(person, skill, keyword, evidence): titles of a person's ``orphans`` worst covered skills that have any, apart from what is searched already, where they are worth it."""
    some = lonely.join(candidates.select("skill").distinct(), "skill", "left_semi")
    order = Window.partitionBy("person").orderBy("share", F.desc("listings"), "skill")
    worst = some.withColumn("i", F.row_number().over(order)).where(F.col("i") <= rules.orphans).select("person", "skill")
    sought = base.groupBy("person").agg(F.collect_set("keyword").alias("base"))
    worth = wanted(candidates.select("title", "skill"), market).where((F.col("listings") >= rules.rows) & (F.col("evidence") >= rules.evidence)).select("title", "skill", "evidence")
    rows = worst.join(candidates.select("skill", "title").join(worth, ["title", "skill"]), "skill").join(sought, "person", "left")
    near = F.exists(F.coalesce("base", F.array().cast("array<string>")), lambda b: F.contains(b, F.col("title")) | F.contains(F.col("title"), b))
    return rows.where(~near).select("person", "skill", F.col("title").alias("keyword"), "evidence")


def anchored(scores: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(person, keyword, skill, evidence, place): the strongest, none inside another, ``anchored`` at most for a person."""
    best = scores.groupBy("person", "keyword").agg(F.max_by(F.struct("skill", "evidence"), F.struct(F.round("evidence", 9), "skill")).alias("b"))
    placed = best.withColumn("order", F.row_number().over(Window.partitionBy("person").orderBy(F.desc(F.round("b.evidence", 9)), "keyword")))
    return suppressed(placed, "person", "keyword", "order", rules.anchored).join(best, ["person", "keyword"]).select("person", "keyword", "b.skill", "b.evidence", "place")


def tiers(held: DataFrame, anchor: DataFrame, corpus: DataFrame) -> DataFrame:
    """(person, keyword, tier, why, place): each keyword once, in its best tier; inside a tier in the order of its source."""
    part = lambda df, tier, why: df.select("person", F.trim(F.lower("keyword")).alias("keyword"), F.lit(tier).alias("tier"), F.col("place").cast("long").alias("pos"), why.alias("why"))
    told = F.format_string("anchored: recovered from '%s' (evidence %.2f)", "skill", "evidence")
    rows = part(held, 1, F.lit("held: a title from this person's own employment")).union(part(anchor, 2, told)).union(part(corpus, 3, F.lit("corpus: ranked by market lift"))).where("keyword <> ''")
    best = rows.groupBy("person", "keyword").agg(F.min(F.struct("tier", "pos", "why")).alias("b"))
    order = Window.partitionBy("person").orderBy("b.tier", "b.pos", "keyword")
    return best.select("person", "keyword", "b.tier", "b.why", F.row_number().over(order).cast("long").alias("place"))


def shares(ranked: DataFrame, own: DataFrame, market: Market, rules: Rules = Rules(), companies: bool = True) -> DataFrame:
    """person, keyword, skill, share, idf, listings, companies: the shrunk share of each own skill in a keyword's rows; a keyword without any comes with an empty skill.

    Without ``companies`` that column is left out, and the pairs of titles and companies, which grow with the market, are not made.
    """
    sizes = ["listings", "companies"] if companies else ["listings"]
    distinct = ranked.select(F.col("keyword").alias("term")).distinct()
    reach = stored(held_in(market.titles.select("title"), distinct))
    if companies:
        bought = market.firms.join(reach, "title").groupBy("term", "company").agg(F.sum("n").alias("n")).groupBy("term").agg(F.sum("n").alias("listings"), F.count("company").alias("companies"))
    else:
        bought = market.titles.join(reach, "title").groupBy("term").agg(F.sum("n").alias("listings"))
    base = _with_total(market.skills, market).select("skill", (F.col("n") / F.col("total")).alias("base"), idf(F.col("n"), F.col("total")).alias("idf"))
    asked = ranked.select("person", "keyword").join(own, "person")
    named = reach.join(asked.select(F.col("keyword").alias("term"), "skill").distinct(), "term").join(market.uses, ["title", "skill"]).groupBy("term", "skill").agg(F.sum("n").alias("named"))
    found = asked.join(named.withColumnRenamed("term", "keyword"), ["keyword", "skill"]).join(bought.withColumnRenamed("term", "keyword"), "keyword").join(base, "skill")
    share = (F.col("named") + rules.prior * F.col("base")) / (F.col("listings") + rules.prior)
    rows = found.select("person", "keyword", "skill", share.alias("share"), "idf", *sizes)
    bare = ranked.select("person", "keyword").join(rows.select("person", "keyword").distinct(), ["person", "keyword"], "left_anti").join(bought.withColumnRenamed("term", "keyword"), "keyword", "left")
    return rows.unionByName(bare.select("person", "keyword", F.lit("").alias("skill"), F.lit(0.0).alias("share"), F.lit(0.0).alias("idf"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sizes]))


def derived(owned: DataFrame, held: DataFrame, rows: DataFrame, seniority: tuple[str, ...], hard: tuple[str, ...] = (), concepts: tuple[str, ...] = (), rules: Rules = Rules()) -> DataFrame:
    """person, keyword, tier, why, place: everyone's keywords in the order in which a budget should buy them.

    ``owned`` is (person, skill), ``held`` (person, keyword, place) the titles of own employment, ``rows`` the market.
    """
    market = market_of(rows, seniority)
    own = stored(clean(owned, market, concepts))
    corpus = corpus_titles(corpus_scores(own, market, rules), market, rules)
    both = held.select("person", F.trim(F.lower("keyword")).alias("keyword"), F.col("place").cast("long").alias("place"), F.lit(True).alias("held")).union(corpus.select("person", "keyword", "place", F.lit(False)))
    each = both.groupBy("person", "keyword").agg(F.max("held").alias("held"), F.min_by("place", F.struct(~F.col("held"), F.col("place"))).alias("place"))
    base = stored(valid_keywords(each, market, hard, rules))
    lonely = orphans(own, base, market, rules)
    anchor = anchored(anchor_scores(lonely, stored(skill_candidates(skill_titles(market, rules), rules)), base, market, rules), rules)
    ranked = stored(tiers(base.where("held"), anchor, base.where("NOT held")))
    priced = shares(ranked, own, market, rules).join(ranked.select("person", "keyword", (F.col("tier") == 1).alias("held"), F.col("place").alias("rank")), ["person", "keyword"])
    order = budget_order(priced, rules.rows, rules.orphan_companies)
    return order.join(ranked.drop("place"), ["person", "keyword"]).select("person", "keyword", "tier", "why", "place")


#: The share from which a keyword covers a skill, and the part of a keyword that earlier ones have bought from which it waits.
COVERED, REDUNDANT = 0.25, 0.6


def rare_skills(own: DataFrame, market: Market, rules: Rules = Rules()) -> DataFrame:
    """(person, skill, idf): the skills a person can be found by: with enough listings and employers, and no commoner than the (upper) median of those."""
    enough = market.employers.where((F.col("n") >= rules.orphan_listings) & (F.col("employers") >= rules.orphan_companies))
    weighed = _with_total(enough, market).select("skill", idf(F.col("n"), F.col("total")).alias("idf"))
    mine = own.select("person", "skill").distinct().join(weighed, "skill")
    middle = mine.groupBy("person").agg(F.sort_array(F.collect_list("idf")).alias("a")).select("person", F.element_at("a", (F.floor(F.size("a") / 2) + 1).cast("int")).alias("middle"))  # a person's skills
    return mine.join(middle, "person").where(F.col("idf") >= F.col("middle")).select("person", "skill", "idf")


def specialists(priced: DataFrame, rare: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(person, keyword, score): the keyword with enough rows that best serves a person's rare skills; of equal ones the first in the alphabet."""
    found = priced.where(F.col("listings") >= rules.rows).join(rare.select("person", "skill"), ["person", "skill"]).groupBy("person", "keyword").agg(F.sum(F.col("idf") * F.col("share")).alias("score")).where("score > 0")
    return found.groupBy("person").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "keyword")).alias("b")).select("person", "b.keyword", (-F.col("b.s")).alias("score"))


def redundant_last(priced: DataFrame, most: int = 20_000) -> DataFrame:
    """person, keyword, place: in the order of ``rank``, but a keyword of which earlier ones have bought more than ``REDUNDANT`` waits behind, and so do held titles after the first.

    ``priced`` is (person, keyword, skill, share, idf, held, rank), some fifty keywords a person; more than ``most`` rows of one raise ValueError.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        _bounded_group(pdf, most)
        keep, wait, have, leads = [], [], {}, 0
        for word, part in sorted(pdf.groupby("keyword"), key=lambda x: (x[1]["rank"].iloc[0], x[0])):
            share, weight, held = dict(zip(part["skill"], part["share"])), dict(zip(part["skill"], part["idf"])), bool(part["held"].iloc[0])
            mine = sum(weight[s] * v for s, v in share.items())
            gain = sum(weight[s] * max(0.0, v - have.get(s, 0.0)) for s, v in share.items())
            if held and leads >= 1 or mine > 0 and gain / mine < 1 - REDUNDANT:
                wait.append(word)
                continue
            keep.append(word)
            leads += held
            for s, v in share.items():
                have[s] = max(have.get(s, 0.0), v)
        both = keep + wait
        return pd.DataFrame({"person": [pdf["person"].iloc[0]] * len(both), "keyword": both, "place": range(1, len(both) + 1)})

    return priced.groupBy("person").applyInPandas(order, f"person {dict(priced.dtypes)['person']}, keyword string, place long")


def title_hints(scores: DataFrame, market: Market, most: int = 40) -> DataFrame:
    """(person, hint, place): the distinctive fragments of a person, each followed by the title that it stands for, ``most`` at most and none twice."""
    order = Window.partitionBy("person").orderBy(F.desc(F.round("score", 9)), F.desc(F.round("weight", 9)), "fragment")
    placed = scores.withColumn("order", F.row_number().over(order)).withColumnRenamed("fragment", "keyword")
    chosen = suppressed(placed, "person", "keyword", "order", most).withColumnRenamed("keyword", "fragment").join(market.canon, "fragment", "left")
    both = chosen.select("person", F.inline(F.array(F.struct(F.col("fragment").alias("hint"), (2 * F.col("place")).alias("at")), F.struct(F.col("canonical").alias("hint"), (2 * F.col("place") + 1).alias("at"))))).where("hint IS NOT NULL")
    first = both.groupBy("person", "hint").agg(F.min("at").alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("person").orderBy("at")).cast("long")).where(F.col("place") <= most).drop("at")
