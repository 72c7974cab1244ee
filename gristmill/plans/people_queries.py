"""Queries over many people: keywords derived from the market for a thousand at once, stage by stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import derivation as D
from gristmill.plans.market_queries import SENIOR, M
from gristmill.registry import query
from gristmill.sources.tables import market_rows, table

#: Thresholds that fit a market of a few hundred titles; all others are the usual ones.
RULES = D.Rules(skill_lift=2.0, evidence=0.5, represented=0.3)
CONCEPTS, PEOPLE, HARD, SOFT = ("patterns", "solid"), 1000, ("economy",), ("large", "standard")


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _plain(title: str) -> str:
    return f"list_filter(string_split({title}, ' '), lambda x: x NOT IN {_list(SENIOR)})"


#: The tables of the market, the canonical titles, the people's skills and their own titles.
TABLES = (
    "c AS (SELECT title, company, list_sort(skills) AS skills, count(*) AS n, count(*) FILTER (WHERE score >= 20) AS r FROM market GROUP BY 1, 2, 3), t AS (SELECT title, sum(n) AS n, sum(r) AS r FROM c GROUP BY 1), "
    "e AS (SELECT title, company, n, unnest(skills) AS skill FROM c), sk AS (SELECT skill, sum(n) AS n, count(DISTINCT company) AS employers FROM e GROUP BY 1), us AS (SELECT title, skill, sum(n) AS n FROM e GROUP BY 1, 2), tot AS (SELECT count(*) AS total FROM market), "
    f"fr AS (SELECT title, unnest(list_distinct(list_concat(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END))) AS fragment FROM (SELECT title, {_plain('title')} AS w FROM t)), "
    "ix AS (SELECT fragment, sum(n) AS listings, count(DISTINCT company) AS companies FROM c JOIN fr USING (title) GROUP BY 1), "
    f"ct AS (SELECT f.fragment, t.title, t.n, len(string_split(t.title, ' ')) AS words, len(list_intersect(string_split(t.title, ' '), {list(SENIOR)})) > 0 AS senior FROM (SELECT DISTINCT fragment FROM fr) f JOIN t ON contains(t.title, f.fragment)), "
    "cb AS (SELECT fragment, senior, title FROM ct WHERE words BETWEEN 2 AND 4 QUALIFY row_number() OVER (PARTITION BY fragment ORDER BY senior, n DESC, words, title) = 1), "
    f"cs AS (SELECT fragment, senior, CASE WHEN senior THEN array_to_string({_plain('title')}, ' ') ELSE title END AS canonical FROM cb), canon AS (SELECT fragment, canonical FROM cs WHERE NOT senior OR canonical IN (SELECT title FROM t)), "
    f"said AS (SELECT p_partkey % {PEOPLE} AS person, unnest(list_concat(string_split(p_name, ' '), [lower(p_brand), CASE WHEN p_size % 7 = 0 THEN 'solid patterns' ELSE 'gear' END])) AS skill FROM part), "
    f"own AS (SELECT DISTINCT person, skill FROM said WHERE skill IN (SELECT skill FROM sk) OR len(list_intersect(string_split(skill, ' '), {list(CONCEPTS)})) = 0), "
    f"hw AS (SELECT p_partkey % {PEOPLE} AS person, {_plain('min_by(lower(p_type), p_partkey) || chr(32) || min_by(p_name, p_partkey)')} AS w FROM part GROUP BY 1), held AS (SELECT person, array_to_string(w, ' ') AS keyword FROM hw)"
)
BASE = M + ", " + TABLES


def _said(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    extra = F.when(F.col("p_size") % 7 == 0, "solid patterns").otherwise("gear")
    return part.select((F.col("p_partkey") % PEOPLE).alias("person"), F.explode(F.concat(F.split("p_name", " "), F.array(F.lower("p_brand"), extra))).alias("skill"))


def _held(spark, sf_dir):
    title = F.concat_ws(" ", F.lower("p_type"), "p_name")
    first = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % PEOPLE).alias("person")).agg(F.min_by(title, "p_partkey").alias("t"))
    return first.select("person", F.array_join(F.filter(F.split("t", " "), lambda w: ~w.isin(*SENIOR)), " ").alias("keyword"), F.lit(1).alias("place"))


def _market(spark, sf_dir):
    return D.market_of(market_rows(spark, sf_dir), SENIOR)


def _own(spark, sf_dir, market):
    return D.clean(_said(spark, sf_dir), market, CONCEPTS)


@query(BASE + " SELECT person, skill FROM own")
def m10_people_skills(spark, sf_dir):
    """The searchable skills of a thousand people."""
    return _own(spark, sf_dir, _market(spark, sf_dir))


@query(BASE + " SELECT * FROM canon")
def m8_canonical_by_rule(spark, sf_dir):
    """The title that each fragment stands for; of senior ones only what is a title without that word."""
    return _market(spark, sf_dir).canon


@query(BASE + ", w AS (SELECT skill, ln(total / (1 + n)) AS idf FROM sk, tot), mt AS (SELECT person, skills, sum(idf) AS ev FROM (SELECT skills, unnest(skills) AS skill FROM (SELECT DISTINCT skills FROM c)) JOIN own USING (skill) JOIN w USING (skill) GROUP BY 1, 2 HAVING count(*) >= 2), mk AS (SELECT person, skills, greatest(1.0, ev) AS w FROM mt QUALIFY max(ev) OVER (PARTITION BY person) < 7.0 OR ev >= 7.0), wt AS (SELECT person, title, sum(w * n) AS w, sum(w * r) AS wr FROM mk JOIN (SELECT skills, title, sum(n) AS n, sum(r) AS r FROM c GROUP BY 1, 2) USING (skills) GROUP BY 1, 2), wh AS (SELECT person, sum(w) AS whole FROM wt GROUP BY 1), pf AS (SELECT person, fragment, sum(w) AS weight, sum(wr) AS reach FROM wt JOIN fr USING (title) GROUP BY 1, 2) SELECT person, fragment, round(weight, 3) AS weight, round(weight / whole / (listings / total) * reach / weight, 5) AS score FROM pf JOIN ix USING (fragment) JOIN wh USING (person), tot WHERE weight >= 10 AND companies >= 5 AND listings / total <= 0.25 AND weight / whole / (listings / total) > 1")
def m6_people_fragments(spark, sf_dir):
    """Distinctive fragments of every person's rows, weighed by evidence, behind all floors."""
    market = _market(spark, sf_dir)
    found = D.corpus_scores(_own(spark, sf_dir, market), market, RULES)
    return found.select("person", "fragment", F.round("weight", 3).alias("weight"), F.round("score", 5).alias("score"))


SKILL_TITLES = f"hr AS (SELECT skill, fragment, sum(us.n) AS here FROM us JOIN fr USING (title) GROUP BY 1, 2), ho AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY here DESC, fragment) AS i FROM hr QUALIFY i <= {RULES.top}), hc AS (SELECT ho.skill, canonical AS title, min(i) AS place FROM ho JOIN sk USING (skill) JOIN ix USING (fragment) JOIN canon USING (fragment), tot WHERE here >= {RULES.of_skill} * sk.n AND companies >= {RULES.orphan_companies} AND listings <= {RULES.share} * total GROUP BY 1, 2), hl AS (SELECT hc.title, sum(t.n) AS listings FROM (SELECT DISTINCT title FROM hc) hc JOIN t ON contains(t.title, hc.title) GROUP BY 1), hn AS (SELECT hc.title, hc.skill, sum(us.n) AS named FROM hc JOIN us ON us.skill = hc.skill AND contains(us.title, hc.title) GROUP BY 1, 2), st AS (SELECT hc.skill, hc.title, place, listings, coalesce(named, 0) / listings AS share, coalesce(named, 0) / listings / (sk.n / total) AS lift, coalesce(named, 0) / listings * ln(total / (1 + sk.n)) AS evidence FROM hc JOIN hl USING (title) LEFT JOIN hn ON hn.title = hc.title AND hn.skill = hc.skill JOIN sk ON sk.skill = hc.skill, tot WHERE coalesce(named, 0) / listings / (sk.n / total) >= {RULES.skill_lift})"


@query(BASE + f", {SKILL_TITLES} SELECT skill, title, place, round(lift, 6) AS lift FROM st")
def m16_skill_titles(spark, sf_dir):
    """For every skill the titles of its eighty commonest fragments that want it more than the market does."""
    found = D.skill_titles(_market(spark, sf_dir), RULES)
    return found.select("skill", "title", F.col("order").cast("long").alias("place"), F.round("lift", 6).alias("lift"))


@query()
def m16_skill_candidates(spark, sf_dir):
    """The same without titles that hold one another, eight for a skill."""
    return D.skill_candidates(D.skill_titles(_market(spark, sf_dir), RULES), RULES)


ORPHANS = f"ob AS (SELECT DISTINCT person, t.title, t.n FROM held JOIN t ON contains(t.title, keyword)), ow AS (SELECT person, sum(n) AS bought FROM ob GROUP BY 1), om AS (SELECT person, skill, sk.n AS listings FROM own JOIN sk USING (skill) WHERE sk.n >= {RULES.orphan_listings} AND employers >= {RULES.orphan_companies}), oe AS (SELECT ob.person, us.skill, sum(us.n) AS named FROM ob JOIN us USING (title) GROUP BY 1, 2), orphan AS (SELECT person, skill, listings, coalesce(named / bought, 0) AS share FROM om LEFT JOIN ow USING (person) LEFT JOIN oe USING (person, skill) WHERE coalesce(named / bought, 0) < {RULES.represented})"


@query(BASE + f", {ORPHANS} SELECT person, skill, listings, round(share, 6) AS share FROM orphan")
def m14_people_orphans(spark, sf_dir):
    """Skills of every person that the rows bought by the own titles hardly name."""
    market = _market(spark, sf_dir)
    found = D.orphans(_own(spark, sf_dir, market), _held(spark, sf_dir), market, RULES)
    return found.select("person", "skill", "listings", F.round("share", 6).alias("share"))


@query(BASE + f", {SKILL_TITLES}, {ORPHANS}, worst AS (SELECT person, skill FROM orphan WHERE skill IN (SELECT skill FROM st) QUALIFY row_number() OVER (PARTITION BY person ORDER BY share, listings DESC, skill) <= {RULES.orphans}) SELECT person, skill, title AS keyword, round(evidence, 6) AS evidence FROM worst JOIN st USING (skill) JOIN held USING (person) WHERE listings >= {RULES.rows} AND evidence >= {RULES.evidence} AND NOT contains(keyword, title) AND NOT contains(title, keyword)")
def m18_anchor_scores(spark, sf_dir):
    """Titles that would recover every person's orphaned skills, with how strongly their rows want the skill."""
    market, held = _market(spark, sf_dir), _held(spark, sf_dir)
    own = _own(spark, sf_dir, market)
    found = D.anchor_scores(D.orphans(own, held, market, RULES), D.skill_titles(market, RULES), held, market, RULES)
    return found.select("person", "skill", "keyword", F.round("evidence", 6).alias("evidence"))


@query()
def m18_capped_selection(spark, sf_dir):
    """The two strongest of them for each person, none inside another."""
    market, held = _market(spark, sf_dir), _held(spark, sf_dir)
    own = _own(spark, sf_dir, market)
    found = D.anchor_scores(D.orphans(own, held, market, RULES), D.skill_candidates(D.skill_titles(market, RULES), RULES), held, market, RULES)
    return D.anchored(found, RULES).select("person", "keyword", "skill", F.round("evidence", 6).alias("evidence"), "place")


@query("WITH h AS (SELECT p_partkey % 50 AS person, lower(p_type) AS keyword, min(p_partkey) AS pos FROM part GROUP BY 1, 2), a AS (SELECT p_partkey % 50 AS person, p_name AS keyword, min(p_partkey) AS pos FROM part WHERE p_size < 10 GROUP BY 1, 2), c AS (SELECT p_partkey % 50 AS person, CASE WHEN p_size % 2 = 0 THEN p_name ELSE lower(p_type) END AS keyword, min(p_partkey) AS pos FROM part GROUP BY 1, 2), u AS (SELECT *, 1 AS tier, 'held: a title from this person''s own employment' AS why FROM h UNION ALL SELECT *, 2, 'anchored: recovered from ' || chr(39) || keyword || chr(39) || ' (evidence 1.50)' FROM a UNION ALL SELECT *, 3, 'corpus: ranked by market lift' FROM c), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY person, keyword ORDER BY tier, pos) = 1) SELECT person, keyword, tier, why, row_number() OVER (PARTITION BY person ORDER BY tier, pos, keyword) AS place FROM b")
def m19_tiers(spark, sf_dir):
    """Keywords of three sources, each in its best tier, ordered inside the tier as its source has them."""
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("person"), "p_partkey", "p_name", "p_size", F.lower("p_type").alias("kind"))
    source = lambda df, keyword: df.groupBy("person", keyword.alias("keyword")).agg(F.min("p_partkey").alias("place"))
    anchor = source(part.where("p_size < 10"), F.col("p_name")).select("*", F.col("keyword").alias("skill"), F.lit(1.5).alias("evidence"))
    return D.tiers(source(part, F.col("kind")), anchor, source(part, F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("kind"))))


@query(BASE + ", km AS (SELECT keyword, sum(n) AS listings, count(DISTINCT company) AS companies FROM (SELECT DISTINCT keyword FROM held) JOIN c ON contains(title, keyword) GROUP BY 1), kn AS (SELECT keyword, skill, sum(n) AS named FROM (SELECT DISTINCT keyword FROM held) JOIN us ON contains(title, keyword) GROUP BY 1, 2), s AS (SELECT person, keyword, skill, (named + 20 * sk.n / total) / (listings + 20) AS share, listings, companies FROM held JOIN own USING (person) JOIN kn USING (keyword, skill) JOIN km USING (keyword) JOIN sk USING (skill), tot) SELECT person, keyword, skill, floor(share * 10000 + 0.37) / 10000 AS share, listings, companies FROM s UNION ALL SELECT person, keyword, '', 0, coalesce(listings, 0), coalesce(companies, 0) FROM held LEFT JOIN km USING (keyword) WHERE (person, keyword) NOT IN (SELECT (person, keyword) FROM s)")
def m20_people_shares(spark, sf_dir):
    """The shrunk share of every own skill in the rows of the own titles."""
    market = _market(spark, sf_dir)
    found = D.shares(_held(spark, sf_dir), _own(spark, sf_dir, market), market, RULES)
    #: Cut where exact shares, of small denominators, don't fall.
    cut = F.floor(F.col("share") * 10000 + 0.37) / 10000
    return found.select("person", "keyword", "skill", cut.alias("share"), "listings", "companies")


@query()
def m25_people_by_market(spark, sf_dir):
    """Everyone's keywords through all stages: skills, fragments, titles, checks, orphans, tiers, budget order."""
    return D.derived(_said(spark, sf_dir), _held(spark, sf_dir), market_rows(spark, sf_dir), SENIOR, HARD, CONCEPTS, RULES)


FIELDS = f"f AS (SELECT p_partkey % {PEOPLE} AS person, unnest([{{'field': 'role_keywords', 'term': CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 5 < 3 THEN 'e' ELSE 'economy ' || p_name END}}, {{'field': 'skill_weights', 'term': p_name}}, {{'field': 'penalty_terms', 'term': CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE lower(p_brand) END}}, {{'field': 'title_exclude', 'term': CASE WHEN p_size % 4 = 0 THEN string_split(p_name, ' ')[1] WHEN p_size % 4 = 1 THEN 'Standard role' ELSE 'clerk' END}}, {{'field': 'title_hints', 'term': 'Large ' || p_name}}, {{'field': 'domain_title_terms', 'term': string_split(p_name, ' ')[2]}}, {{'field': 'domain_bonus', 'term': (p_size % 2)::VARCHAR}}, {{'field': 'domain_half_a', 'term': CASE WHEN p_size % 3 = 0 THEN 'x' END}}]) AS x FROM part), g AS (SELECT person, x.field AS field, x.term AS term, lower(x.term) AS low FROM f WHERE x.term IS NOT NULL)"
STEMMED = "array_to_string(list_filter(string_split(low, ' '), lambda w: w NOT IN " + _list(SOFT) + "), ' ')"
FIXES = (
    f"m AS (SELECT low, coalesce(sum(t.n), 0) AS listings, coalesce(sum(t.r), 0) AS reachable FROM (SELECT DISTINCT low FROM g WHERE field IN ('role_keywords', 'domain_title_terms')) LEFT JOIN t ON contains(t.title, low) GROUP BY 1), k AS (SELECT person, field, term, CASE WHEN listings > {RULES.share} * total THEN 'wildcard' WHEN len(list_intersect(string_split(low, ' '), {list(HARD)})) > 0 THEN 'hard-drop word' END AS reason FROM g JOIN m USING (low), tot WHERE field = 'role_keywords'), "
    "stop AS (SELECT person FROM k GROUP BY 1 HAVING count(reason) > 0.5 * count(*)), x AS (SELECT person, field, 'dropped' AS action, term, reason FROM k WHERE reason IS NOT NULL "
    "UNION ALL SELECT person, field, 'dropped', term, 'own skill' FROM g WHERE field = 'penalty_terms' AND EXISTS (SELECT 1 FROM g o WHERE o.field = 'skill_weights' AND o.person = g.person AND o.low = g.low) "
    f"UNION ALL SELECT person, field, 'dropped', term, reason FROM (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM g o WHERE o.person = g.person AND o.field IN ('role_keywords', 'title_hints') AND contains(o.low, g.low)) THEN 'own target' WHEN len(list_intersect(string_split(low, ' '), {list(HARD + SOFT)})) > 0 THEN 'seniority' END AS reason FROM g WHERE field = 'title_exclude') WHERE reason IS NOT NULL "
    f"UNION ALL SELECT DISTINCT person, field, 'added', stem, 'stem missing' FROM (SELECT *, {STEMMED} AS stem FROM g WHERE field = 'title_hints') h WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.field = 'title_hints' AND o.person = h.person AND o.low = h.stem) "
    f"UNION ALL SELECT person, field, 'dropped', term, 'below the market' FROM g JOIN m USING (low) WHERE field = 'domain_title_terms' AND listings > {RULES.unmeasured} AND reachable / listings < (SELECT sum(r) / sum(n) FROM t) "
    "UNION ALL SELECT person, 'domain_bonus', 'computed', b, 'empty half' FROM (SELECT person, max(term) FILTER (WHERE field = 'domain_bonus') AS b FROM g GROUP BY 1) WHERE b <> '0'), "
    "y AS (SELECT * FROM x WHERE person NOT IN (SELECT person FROM stop))"
)


def _fields(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size, name, word = F.col("p_size"), F.col("p_name"), lambda k: F.get(F.split("p_name", " "), F.lit(k))
    entries = {
        "role_keywords": F.when(size % 5 == 0, name).when(size % 5 < 3, "e").otherwise(F.concat(F.lit("economy "), name)), "skill_weights": name, "penalty_terms": F.when(size % 3 == 0, F.upper(name)).otherwise(F.lower("p_brand")),
        "title_exclude": F.when(size % 4 == 0, word(0)).when(size % 4 == 1, "Standard role").otherwise("clerk"), "title_hints": F.concat(F.lit("Large "), name), "domain_title_terms": word(1),
        "domain_bonus": (size % 2).cast("string"), "domain_half_a": F.when(size % 3 == 0, "x"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("term")) for k, v in entries.items()]))
    return part.select((F.col("p_partkey") % PEOPLE).alias("person"), each.alias("x")).select("person", "x.*").where("term IS NOT NULL")


@query(BASE + f", {FIELDS}, {FIXES} SELECT * FROM y")
def m13_validation(spark, sf_dir):
    """Corrections of a thousand profiles by five checks, each with its reason."""
    return D.checked(_fields(spark, sf_dir), _market(spark, sf_dir), HARD, SOFT, RULES)[0]


@query(BASE + f", {FIELDS}, {FIXES} SELECT person, CASE WHEN person IN (SELECT person FROM stop) THEN 'escalate' WHEN person IN (SELECT person FROM y) THEN 'corrected' ELSE 'accept' END AS decision FROM (SELECT DISTINCT person FROM g)")
def m13_decisions(spark, sf_dir):
    """What becomes of each profile."""
    return D.checked(_fields(spark, sf_dir), _market(spark, sf_dir), HARD, SOFT, RULES)[1]


@query(BASE + f", p AS (SELECT DISTINCT unnest([p_name, split_part(p_name, ' ', 1), lower(p_type), 'absent']) AS term FROM part), m AS (SELECT term, coalesce(sum(t.n), 0) AS listings, coalesce(sum(t.r), 0) AS reachable, coalesce(sum(t.n) FILTER (WHERE regexp_matches(title, '(^|[^a-z])({'|'.join(HARD)})([^a-z]|$)')), 0) AS wasted FROM p LEFT JOIN t ON contains(title, term) GROUP BY 1) SELECT term, listings, reachable, wasted, round(listings / total, 6) AS share, round(reachable / nullif(listings, 0), 6) AS precision, (SELECT round(sum(r) / sum(n), 6) FROM t) AS baseline FROM m, tot")
def m11_profiles(spark, sf_dir):
    """What every keyword buys: rows, those worth reading, those dropped after being paid for; share, precision and the market's own."""
    market = _market(spark, sf_dir)
    terms = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)), F.lower("p_type"), F.lit("absent"))).alias("term"))
    bar = market.titles.agg(F.round(F.sum("r") / F.sum("n"), 6).alias("baseline"))
    return D.profiled(terms, market, HARD).crossJoin(F.broadcast(bar)).select("term", "listings", "reachable", "wasted", F.round("share", 6).alias("share"), F.round("precision", 6).alias("precision"), "baseline")


RARE = f"rs AS (SELECT person, skill, ln(total / (1 + sk.n)) AS idf FROM own JOIN sk USING (skill), tot WHERE sk.n >= {RULES.orphan_listings} AND employers >= {RULES.orphan_companies}), rm AS (SELECT person, list_sort(list(idf))[len(list(idf)) // 2 + 1] AS middle FROM rs GROUP BY 1), rare AS (SELECT person, skill, idf FROM rs JOIN rm USING (person) WHERE idf >= middle)"


@query(BASE + f", {RARE} SELECT person, skill FROM rare")
def m23_rare_skills(spark, sf_dir):
    """The skills that every person can be found by: posted often enough, and among the rarer half of those."""
    market = _market(spark, sf_dir)
    return D.rare_skills(_own(spark, sf_dir, market), market, RULES).select("person", "skill")


def _asked(spark, sf_dir):
    """Every person's own titles and the names of their parts as keywords."""
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") % PEOPLE).alias("person"), "p_partkey", "p_name")
    names = part.groupBy("person", F.col("p_name").alias("keyword")).agg(F.min("p_partkey").alias("rank"))
    return _held(spark, sf_dir).select("person", "keyword", F.lit(0).cast("long").alias("rank"), F.lit(True).alias("held")).unionByName(names.withColumn("held", F.lit(False)))


@query(BASE + f", {RARE}, ask AS (SELECT person, keyword FROM held UNION SELECT p_partkey % {PEOPLE}, p_name FROM part), km AS (SELECT keyword, sum(n) AS listings FROM (SELECT DISTINCT keyword FROM ask) JOIN c ON contains(title, keyword) GROUP BY 1), kn AS (SELECT keyword, skill, sum(n) AS named FROM (SELECT DISTINCT keyword FROM ask) JOIN us ON contains(title, keyword) GROUP BY 1, 2), sp AS (SELECT person, keyword, sum(idf * (named + 20 * sk.n / total) / (listings + 20)) AS score FROM ask JOIN rare USING (person) JOIN kn USING (keyword, skill) JOIN km USING (keyword) JOIN sk USING (skill), tot WHERE listings >= {RULES.rows} GROUP BY 1, 2) SELECT person, keyword, round(score, 4) AS score FROM sp QUALIFY row_number() OVER (PARTITION BY person ORDER BY round(score, 9) DESC, keyword) = 1")
def m23_specialists(spark, sf_dir):
    """The keyword that best serves each person's rare skills."""
    market = _market(spark, sf_dir)
    own = _own(spark, sf_dir, market)
    priced = D.shares(_asked(spark, sf_dir).select("person", "keyword").distinct(), own, market, RULES, companies=False)
    return D.specialists(priced, D.rare_skills(own, market, RULES), RULES).select("person", "keyword", F.round("score", 4).alias("score"))


@query()
def m22_redundancy_deferral(spark, sf_dir):
    """Everyone's keywords with those behind of which earlier ones have bought most."""
    market, asked = _market(spark, sf_dir), _asked(spark, sf_dir)
    ask = asked.groupBy("person", "keyword").agg(F.min("rank").alias("rank"), F.max("held").alias("held"))
    priced = D.shares(ask.select("person", "keyword"), _own(spark, sf_dir, market), market, RULES, companies=False).join(ask, ["person", "keyword"])
    return D.redundant_last(priced)


@query()
def m9_title_hints(spark, sf_dir):
    """Fragments and titles that widen the gate on each person's free sources."""
    market = _market(spark, sf_dir)
    return D.title_hints(D.corpus_scores(_own(spark, sf_dir, market), market, RULES), market)
