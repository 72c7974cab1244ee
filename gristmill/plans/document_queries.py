"""Queries over documents: concepts, sections, status, strength, grounding."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gristmill.operators import audits, gate
from gristmill.operators import documents as D
from gristmill.operators import evidence as E
from gristmill.operators.market import SEEN_LEAST, blend, separation, term_frequency
from gristmill.plans.market_queries import BAND, FREQ, M
from gristmill.registry import query
from gristmill.sources.shared import stored
from gristmill.sources.tables import dealt, market_rows, table

CONCEPTS = {"gpl": ["gnu general public license", "gpl"], "apache": ["apache license", "apache"], "license": ["license"], "mit": ["mit license", "mit"], "article": ["the", "les", "der"], "insult": ["idiot", "stupid", "loser"], "work": ["work"]}
ALIASES = sorted(((a, c) for c, names in CONCEPTS.items() for a in names), key=lambda x: (-len(x[0]), x[0]))
#: The same in DuckDB: tokens of a-z and 0-9 and the rest between; an alias of n words is n tokens with single blanks between.
NEXT = {2: ("t1 = ' '", "t2"), 4: ("t3 = ' '", "t4"), 6: ("t5 = ' '", "t6")}


def _is(alias: str) -> str:
    first, *rest = alias.split()
    return f"t0 = '{first}'" + "".join(f" AND {NEXT[2 * k][0]} AND {NEXT[2 * k][1]} = '{w}'" for k, w in enumerate(rest, 1))


OCC = (
    "tok AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS t0 FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[^a-z0-9]+') AS t FROM documents)), "
    f"win AS (SELECT *, {', '.join(f'lead(t0, {k}) OVER w AS t{k}' for k in range(1, 7))} FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i)), "
    f"hit AS (SELECT doc_id, i, alias, 2 * len(string_split(alias, ' ')) - 1 AS n FROM (SELECT doc_id, i, CASE {' '.join(f'WHEN {_is(a)} THEN {chr(39)}{a}{chr(39)}' for a, _ in ALIASES)} END AS alias FROM win) WHERE alias IS NOT NULL), "
    "long AS (SELECT * FROM hit WHERE n > 1), "
    f"occ AS (SELECT doc_id, i, alias, CASE alias {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{c}{chr(39)}' for a, c in ALIASES)} END AS concept FROM hit h WHERE NOT EXISTS (SELECT 1 FROM long o WHERE o.doc_id = h.doc_id AND o.i <= h.i AND o.i + o.n >= h.i + h.n AND o.n > h.n))"
)


#: Documents by part number, with a part's brand, type and size in them, and what they say of each concept:
#: (concept, statuses, strength, entries, tier, why).
TOOLS = {"spark": ["spark"], "redis": ["redis"], "kafka": ["kafka"]}
TOLD = (
    ("Work Experience\n{p_brand}\n- Built services with spark.\n{p_type} Ltd\n- Developed jobs in spark.", [("spark", "USED,USED", "independent", 2, "CORE", "used at work")]),
    ("Projects\nTool {p_size} | demo\n- Designed a cache with redis.\nSkills\nredis, kafka", [("redis", "MENTIONED,USED", "substantive", 1, "STRONG_SECONDARY", "built with in a project"), ("kafka", "MENTIONED", "claim", 0, "SUPPORTING", "listed")]),
    ("Education\nState University\n- Course on kafka.\nSummary\nI plan to use spark.", [("kafka", "LEARNING", "none", 0, "BACKGROUND", "learning"), ("spark", "PLANNED", "none", 0, "BACKGROUND", "planned")]),
    ("Work Experience\n{p_brand}\n- Evaluated kafka, not adopted.\n- Meetings about redis.", [("kafka", "NEGATED", "none", 0, "BACKGROUND", "rejected"), ("redis", "MENTIONED", "claim", 0, "SUPPORTING", "named")]),
)
#: The spans of the same documents: (template, section, entry, first line, lines).
SPANS = ((0, "work", "p_brand", 1, 2), (0, "work", "p_type || ' Ltd'", 3, 2), (1, "project", "'Tool ' || p_size", 1, 2), (1, "skills", "''", 4, 1), (2, "education", "'State University'", 1, 2), (2, "summary", "''", 4, 1), (3, "work", "p_brand", 1, 3))
#: What was done in documents of their own: text and (mode, kind, asserted, learning, refuted, delegated, entries, strength).
DONE = (
    ("Work Experience\n{p_brand}\n- Built services for payments.\n{p_type} Ltd\n- Developed two apps.", [("development", 2, 0, 0, 0, 2, "strong")]),
    ("Work Experience\n{p_brand}\n- Authored notes for the module. Coordinated with the developers who built components.", [("consulting", 1, 0, 0, 1, 1, "weak")]),
    ("Education\n{p_type} College\n- Built scripts.\nSummary\nNever configured workflows.", [("development", 0, 1, 0, 0, 0, "none"), ("configuration", 0, 0, 1, 0, 0, "none")]),
)


def _filled(spark, sf_dir, templates):
    texts = [F.concat_ws("", *[F.col(piece).cast("string") if piece.startswith("p_") else F.lit(piece) for piece in re.split("[{}]", text)]) for text, _ in templates]
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")).select("p_partkey", F.get(F.array(*texts), F.col("p_partkey") % len(templates)).alias("text"))


def _values(templates) -> str:
    return ", ".join(f"({k}, {', '.join(str(x) if isinstance(x, int) else chr(39) + x + chr(39) for x in row)})" for k, (_, rows) in enumerate(templates) for row in rows)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _occurrences(spark, sf_dir):
    return E.occurrences(E.lines(_docs(spark, sf_dir)), CONCEPTS)


def _found(spark, sf_dir):
    return E.judged(_occurrences(spark, sf_dir))


@query(f"WITH {OCC} SELECT doc_id, concept, alias, count(*) AS n FROM occ GROUP BY ALL")
def c1_concept_occurrences(spark, sf_dir):
    return _occurrences(spark, sf_dir).groupBy("doc_id", "concept", "alias").agg(F.count("*").alias("n"))


@query(f"WITH {OCC}, w(concept, weight) AS (VALUES ('gpl', 3), ('apache', 4), ('license', 2), ('mit', 1), ('article', 1), ('insult', -2), ('work', 1)) SELECT doc_id, sum(weight) AS score, string_agg(concept, ',' ORDER BY concept) AS concepts FROM (SELECT DISTINCT doc_id, concept FROM occ) JOIN w USING (concept) GROUP BY doc_id")
def e2_concept_score(spark, sf_dir):
    weights = F.create_map(*[F.lit(x) for p in {"gpl": 3, "apache": 4, "license": 2, "mit": 1, "article": 1, "insult": -2, "work": 1}.items() for x in p])
    rows = _docs(spark, sf_dir).select("doc_id", D.concept_set("text", CONCEPTS).alias("c")).where(F.size("c") > 0)
    return rows.select("doc_id", F.aggregate("c", F.lit(0), lambda a, x: a + F.element_at(weights, x)).cast("long").alias("score"), F.array_join("c", ",").alias("concepts"))


@query()
def c3_status(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("doc_id", "concept", "status").agg(F.count("*").alias("n"))


@query()
def c4_scoped_cues(spark, sf_dir):
    """The status of every occurrence where a cue of denial, plan or learning counts only for what it governs."""
    return E.judged(_occurrences(spark, sf_dir), scoped=True).groupBy("doc_id", "concept", "status").agg(F.count("*").alias("n"))


def _strength(spark, sf_dir):
    return E.strength(_found(spark, sf_dir))


@query()
def c5_strength(spark, sf_dir):
    return _strength(spark, sf_dir).select("doc_id", "concept", "n", "claimed", "uses", "strength", "entries")


@query()
def c6_tier(spark, sf_dir):
    return _strength(spark, sf_dir).select("doc_id", "concept", "tier", "why")


def _weights(spark, sf_dir):
    """doc_id, concept, weight and what it rests on; the evidence is read once for the weights and for the share of documents."""
    rows = stored(_strength(spark, sf_dir))
    docs = rows.groupBy("concept").agg(F.count("*").alias("hits")).crossJoin(_docs(spark, sf_dir).agg(F.count("*").alias("seen")))
    return rows.join(docs, "concept").select("*", D.weight(F.col("tier"), separation("hits", "seen")).alias("weight"))


@query()
def c7_weight(spark, sf_dir):
    return _weights(spark, sf_dir).select("doc_id", "concept", "weight")


@query(f"WITH {OCC} SELECT concept, count(*) AS n, count(DISTINCT doc_id) AS docs, (SELECT count(*) FROM hit) - (SELECT count(*) FROM occ) AS shadowed FROM occ GROUP BY concept")
def c8_assess_all(spark, sf_dir):
    """Counts after longer occurrences have taken shorter ones inside them, and how many were taken."""
    found = _occurrences(spark, sf_dir)
    per = found.groupBy("concept", "doc_id", "alias").agg(F.count("*").alias("n"))
    inner = {a: sum(1 for b, _ in ALIASES if b != a and f" {b} " in f" {a} " and not a.startswith(f"{b} ")) for a, _ in ALIASES}
    lost = per.agg(F.sum(F.col("n") * F.element_at(F.create_map(*[F.lit(x) for p in inner.items() for x in p]), F.col("alias"))).alias("shadowed"))
    return per.groupBy("concept", "doc_id").agg(F.sum("n").alias("n")).groupBy("concept").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).crossJoin(F.broadcast(lost))


#: Brands as concepts: what the market is asked about each, in this order. A run of the market is a supplier.
ASKED = "k AS (SELECT p_brand AS concept, unnest(['tool of ' || p_brand, CASE WHEN right(p_brand, 1) <> '3' THEN p_brand END, min(p_type), 'Red', 'gear']) AS key, unnest(range(5)) AS place FROM part GROUP BY p_brand), g AS (SELECT k.concept, min_by(term, place) AS key FROM k JOIN f ON f.term = lower(k.key) AND f.seen >= 200 GROUP BY 1)"


def _asked(spark, sf_dir):
    brand = F.col("p_brand")
    keys = F.array(F.concat(F.lit("tool of "), brand), F.when(F.right(brand, F.lit(1)) != "3", brand), F.col("kind"), F.lit("Red"), F.lit("gear"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_type").alias("kind")).select(brand.alias("concept"), keys.alias("keys"))


@query(f"{M}, {FREQ}, {ASKED}, b AS (SELECT *, {BAND} AS separation FROM f) SELECT concept, g.key, separation, hits, seen FROM (SELECT DISTINCT p_brand AS concept FROM part) LEFT JOIN g USING (concept) LEFT JOIN b ON b.term = g.key")
def c14_market_signal(spark, sf_dir):
    """What the market says about every brand, and which of its keys answered."""
    return D.market_signals(_asked(spark, sf_dir), term_frequency(market_rows(spark, sf_dir).withColumnRenamed("company", "run")), SEEN_LEAST, separation)


@query()
def c15_document_modes(spark, sf_dir):
    return E.work_modes(E.work_hits(E.lines(_docs(spark, sf_dir))))


@query()
def c16_attachments(spark, sf_dir):
    """What a document says was done: clauses in which a verb governs an object, for each kind of work."""
    return E.work_hits(E.lines(_docs(spark, sf_dir))).groupBy("doc_id", "mode", "kind").agg(F.count("*").alias("attached"))


@query()
def c20_evidence_profile(spark, sf_dir):
    """Weights of every document's concepts from its evidence, with what they rest on."""
    return _weights(spark, sf_dir).select("doc_id", "concept", "weight", F.concat_ws("/", "tier", "strength", "entries", "n").alias("rests_on"))


def _told(spark, sf_dir):
    return E.judged(E.occurrences(E.lines(_filled(spark, sf_dir, TOLD), "p_partkey"), TOOLS))


#: What a market says about the tools of TOLD: hits and rows asked, by the key that answers.
MARKET_OF = {"spark": ("apache spark", 900, 1000), "redis": ("redis", 3, 1000), "kafka": (None, None, None)}
SIGNALS = "mk(concept, key, hits, seen) AS (VALUES " + ", ".join(f"('{c}', {chr(39) + k + chr(39) if k else 'NULL::VARCHAR'}, {h if h else 'NULL::BIGINT'}, {n if n else 'NULL::BIGINT'})" for c, (k, h, n) in MARKET_OF.items()) + ")"
_TOLD = f"t(k, concept, statuses, strength, entries, tier, why) AS (VALUES {_values(TOLD)})"
_MOVED = "CASE tier WHEN 'CORE' THEN greatest(4, least(5, 5 + step)) WHEN 'STRONG_SECONDARY' THEN greatest(3, least(4, 4 + step)) WHEN 'SUPPORTING' THEN greatest(2, least(3, 3 + step)) ELSE greatest(1, least(2, 2 + step)) END"


def _profiled(spark, sf_dir):
    """Evidence of the told documents with the market's word on each concept and the weight that follows."""
    concepts = spark.createDataFrame([(c, [f"{c} 9", k or c, "nothing"]) for c, (k, _, _) in MARKET_OF.items()], "concept string, keys array<string>")
    told = spark.createDataFrame([(k, h, n) for k, h, n in MARKET_OF.values() if k] + [("kafka", 5, 150)], "term string, hits long, seen long")
    signals = D.market_signals(concepts, told, SEEN_LEAST, separation)
    rows = E.strength(_told(spark, sf_dir), "p_partkey").join(F.broadcast(signals), "concept")  # as many rows as there are concepts
    return rows.select("*", D.weight(F.col("tier"), F.col("separation")).alias("weight"))


@query(f"WITH {SIGNALS}, {_TOLD}, w AS (SELECT *, CASE WHEN hits / seen >= 0.12 THEN -1 WHEN hits / seen < 0.04 THEN 1 ELSE 0 END AS step FROM t JOIN mk USING (concept)) SELECT p_partkey, concept, {_MOVED} AS weight FROM part JOIN w ON p_partkey % {len(TOLD)} = k")
def c7_told_weights(spark, sf_dir):
    """Weights of tiers, moved by the market inside their bands."""
    return _profiled(spark, sf_dir).select("p_partkey", "concept", "weight")


@query(f"WITH {SIGNALS}, {_TOLD}, w AS (SELECT *, CASE WHEN hits / seen >= 0.12 THEN -1 WHEN hits / seen < 0.04 THEN 1 ELSE 0 END AS step FROM t JOIN mk USING (concept)), f AS (SELECT p_partkey, unnest(['Spark', 'REDIS', 'kafka streams', 'cobol']) AS term, unnest(['spark', 'redis', 'kafka', NULL]) AS concept, unnest([1, 2, 3, 4]) AS given FROM part) SELECT f.p_partkey, term, CASE WHEN tier IS NULL THEN given ELSE {_MOVED} END AS weight, tier, why, key AS market_key FROM f LEFT JOIN w ON w.concept = f.concept AND f.p_partkey % {len(TOLD)} = w.k")
def c20_told_profiles(spark, sf_dir):
    """Profiles weighted anew from their documents, term by term, with tier, reason and the market key behind each weight; what has no evidence keeps its own."""
    identity = {"spark": "spark", "redis": "redis", "kafka streams": "kafka"}
    entries = [("Spark", 1), ("REDIS", 2), ("kafka streams", 3), ("cobol", 4)]
    given = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(w).alias("given")) for t, w in entries])).alias("e")).select("p_partkey", "e.*")
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in identity.items() for x in pair]), F.lower("term"))
    rows = given.withColumn("concept", known).join(_profiled(spark, sf_dir).select("p_partkey", "concept", "weight", "tier", "why", "key"), ["p_partkey", "concept"], "left")
    return rows.select("p_partkey", "term", F.coalesce("weight", "given").alias("weight"), "tier", "why", F.col("key").alias("market_key"))


@query(f"{M}, {FREQ}, b AS (SELECT term, hits, seen, {BAND} AS s FROM f), p AS (SELECT p_partkey % 100 AS person, w AS term, max(p_size % 5 + 1) AS before FROM (SELECT p_partkey, p_size, unnest(list_append(string_split(p_name, ' '), 'cobol')) AS w FROM part) GROUP BY 1, 2), a AS (SELECT person, term, before, CASE WHEN s IS NULL THEN before ELSE greatest(1, least(5, round_even(sqrt(before * s), 0)::INT)) END AS after, round(hits / seen, 6) AS share FROM p LEFT JOIN b USING (term)) SELECT * FROM a WHERE before <> after")
def c21_corpus_profiles(spark, sf_dir):
    """The terms of many profiles whose weight the market moves: how far it sets them apart, blended with how central they were said to be."""
    part = table(spark, sf_dir, "part")
    said = part.select((F.col("p_partkey") % 100).alias("person"), (F.col("p_size") % 5 + 1).alias("before"), F.explode(F.concat(F.split("p_name", " "), F.array(F.lit("cobol")))).alias("term")).groupBy("person", "term").agg(F.max("before").alias("before"))
    measured = term_frequency(market_rows(spark, sf_dir).withColumnRenamed("company", "run"))
    rows = said.join(measured, "term", "left").withColumn("after", blend(F.col("before"), separation("hits", "seen")))
    return rows.where("before <> after").select("person", "term", "before", "after", F.round(F.col("hits") / F.col("seen"), 6).alias("share"))


@query("WITH p AS (SELECT l_orderkey AS doc, l_returnflag AS field, count(*) FILTER (WHERE l_quantity > 25) AS p, count(*) FILTER (WHERE l_discount > 0.04) AS y, count(*) FILTER (WHERE l_quantity > 25 AND l_discount > 0.04) AS tp FROM lineitem GROUP BY 1, 2) SELECT field, round(avg(CASE WHEN p + y > 0 THEN 2.0 * tp / (p + y) END), 6) AS macro_f1 FROM p GROUP BY field")
def a18_macro_f1(spark, sf_dir):
    p, y = F.col("l_quantity") > 25, F.col("l_discount") > 0.04
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("field")).agg(F.count_if(p).alias("p"), F.count_if(y).alias("y"), F.count_if(p & y).alias("tp"))
    return rows.groupBy("field").agg(F.round(F.avg(F.when(F.col("p") + F.col("y") > 0, 2.0 * F.col("tp") / (F.col("p") + F.col("y")))), 6).alias("macro_f1"))


@query("SELECT p_partkey, section, entry, first_line, lines FROM part JOIN (" + " UNION ALL ".join(f"SELECT p_partkey AS q, '{section}' AS section, {entry} AS entry, {first} AS first_line, {n}::BIGINT AS lines FROM part WHERE p_partkey % {len(TOLD)} = {k}" for k, section, entry, first, n in SPANS) + ") ON p_partkey = q")
def c2_section_spans(spark, sf_dir):
    return E.sections(_filled(spark, sf_dir, TOLD), "p_partkey")


@query(f"SELECT p_partkey, concept, statuses FROM part JOIN (VALUES {_values(TOLD)}) AS t(k, concept, statuses, strength, entries, tier, why) ON p_partkey % {len(TOLD)} = k")
def c3_told_status(spark, sf_dir):
    return _told(spark, sf_dir).groupBy("p_partkey", "concept").agg(F.array_join(F.array_sort(F.collect_list("status")), ",").alias("statuses"))


@query(f"SELECT p_partkey, concept, strength, entries, tier, why FROM part JOIN (VALUES {_values(TOLD)}) AS t(k, concept, statuses, strength, entries, tier, why) ON p_partkey % {len(TOLD)} = k")
def c6_told_tiers(spark, sf_dir):
    return E.strength(_told(spark, sf_dir), "p_partkey").select("p_partkey", "concept", "strength", "entries", "tier", "why")


#: Lists by part number, and for kafka in each the status with and without scope and the verdict on the cue of learning.
LISTED = (
    ("Learning kafka, spark and redis.", "LEARNING", "LEARNING", E.SAME_ITEM), ("Learning spark, kafka and redis.", "LEARNING", "LEARNING", E.LEAD_IN), ("{p_brand}, Team training, spark, kafka and redis", "LEARNING", "MENTIONED", E.SIBLING),
    ("Staff training, spark, kafka and redis", "LEARNING", "MENTIONED", E.ITEM_ENDS), ("Learning spark, kafka, redis", "LEARNING", "MENTIONED", E.NO_COORDINATION), ("kafka, redis, {p_brand} training", "LEARNING", "MENTIONED", E.SIBLING),
    ("Kafka training at {p_brand}", "LEARNING", "LEARNING", E.SAME_ITEM), ("Did not use kafka or spark. Learning redis.", "NEGATED", "NEGATED", ""), ("Ran redis; kafka ({p_size})", "MENTIONED", "MENTIONED", ""),
)


@query(f"SELECT p_partkey, status, scoped, why FROM part JOIN (VALUES {', '.join(str((k, *row[1:])) for k, row in enumerate(LISTED))}) AS t(k, status, scoped, why) ON p_partkey % {len(LISTED)} = k")
def c4_told_scope(spark, sf_dir):
    """What scope does to a cue in a list, with the verdict on it."""
    rows = E.occurrences(E.lines(_filled(spark, sf_dir, [row[:2] for row in LISTED]), "p_partkey"), {"kafka": ["kafka"]})
    ahead, behind = E.clause("before", "after")
    why = F.array_join(E.verdicts(ahead, F.col("alias"), behind, E.STUDY), ";")
    both = E.judged(rows).withColumnRenamed("status", "plain").drop("shape")
    return E.judged(both, scoped=True).select("p_partkey", F.col("plain").alias("status"), F.col("status").alias("scoped"), why.alias("why"))


def _modes(spark, sf_dir):
    return E.work_modes(E.work_hits(E.lines(_filled(spark, sf_dir, DONE), "p_partkey"), doc="p_partkey"), "p_partkey")


@query(f"SELECT p_partkey, mode, asserted, learning, refuted, delegated, entries, strength FROM part JOIN (VALUES {_values(DONE)}) AS t(k, mode, asserted, learning, refuted, delegated, entries, strength) ON p_partkey % {len(DONE)} = k")
def c15_told_modes(spark, sf_dir):
    return _modes(spark, sf_dir)


@query(f"SELECT p_partkey, p_partkey % {len(DONE)} > 0 AS thin, CASE WHEN p_partkey % {len(DONE)} = 0 THEN 'developer' WHEN p_partkey % {len(DONE)} = 1 THEN 'analyst' ELSE '' END AS supported, CASE WHEN p_partkey % {len(DONE)} = 2 THEN 'development' ELSE '' END AS transition FROM part")
def c17_told_roles(spark, sf_dir):
    return E.role_record(_modes(spark, sf_dir), {"developer": ("development", True), "analyst": ("consulting", False), "administrator": ("configuration", True)}, "p_partkey")


#: Texts by part number and how the terms stand in them.
VOCABULARY = ["react", "react native", "soql", "node.js", "sql"]
SAID = (
    ("React Native and {p_brand}", "react native=boundary"), ("React and React Native", "react native=boundary;react=boundary"), ("andsoql query {p_size}", "soql=glued"),
    ("mysql, nodejs", "node.js=boundary:nodejs;sql=glued"), ("reacts to {p_brand}", "react=boundary:reacts"), ("{p_brand} alone", ""),
)


@query(f"SELECT p_partkey, CASE p_partkey % {len(SAID)} {' '.join(f'WHEN {k} THEN {chr(39)}{";".join(sorted(how.split(";")))}{chr(39)}' for k, (_, how) in enumerate(SAID))} END AS hits FROM part")
def c9_told_terms(spark, sf_dir):
    rows = _filled(spark, sf_dir, SAID)
    return rows.select("p_partkey", F.array_join(F.array_sort(F.split(audits.vocabulary_hits("text", VOCABULARY), ";")), ";").alias("hits"))


@query("WITH t AS (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', ' / ') ELSE replace(p_name, ' ', '&') END AS term FROM part), known AS (SELECT DISTINCT unnest(w) AS term FROM t WHERE p_size < 3), e AS (SELECT p_partkey, unnest(w) AS x FROM t), f AS (SELECT e.p_partkey, bool_and(k.term IS NOT NULL) AS fine FROM e LEFT JOIN known k ON k.term = e.x GROUP BY 1) SELECT DISTINCT p_partkey, unnest(CASE WHEN fine AND len(w) > 1 THEN w ELSE [lower(term)] END) AS atom FROM t JOIN f USING (p_partkey)")
def c13_atoms(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    terms = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit(" / "))).otherwise(F.replace("p_name", F.lit(" "), F.lit("&"))).alias("term"))
    return audits.atoms(terms, part.where("p_size < 3").select(F.explode(F.split("p_name", " ")).alias("term")), "p_partkey")


@query("WITH v AS (SELECT doc_id, coalesce(text, '') AS text, [source, lang, 'license', 'the', 'of'] AS vals FROM documents), u AS (SELECT doc_id, len(vals) AS n, list_filter(vals, lambda v: NOT CASE WHEN length(regexp_replace(lower(v), '[^a-z0-9]+', '', 'g')) < 4 THEN contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || lower(v) || ' ') ELSE contains(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), lower(v)) END) AS bad FROM v) SELECT doc_id, 'words' AS field, n AS n_values, CASE WHEN len(bad) <= 0.5 * n THEN array_to_string(bad, ',') ELSE '' END AS dropped, len(bad) > 0.5 * n AS escalate FROM u")
def c18_values(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "text", F.lit("words").alias("field"), F.array("source", "lang", F.lit("license"), F.lit("the"), F.lit("of")).alias("values"))
    return audits.grounding(rows, "doc_id")


MONTHS = "s AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS lo, year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 20 - 2 AS hi, o_orderstatus <> 'P' AS relevant FROM orders)"


@query(f"WITH {MONTHS}, m AS (SELECT o_custkey, unnest(range(lo, hi)) AS month FROM s WHERE relevant AND lo < hi), c AS (SELECT o_custkey, count(DISTINCT month) // 12 AS computed FROM m GROUP BY 1), a AS (SELECT o_custkey, bool_or(relevant AND lo < hi) AS usable FROM s GROUP BY 1) SELECT c_custkey, computed, c_custkey % 12 AS stated, CASE WHEN usable IS NULL THEN CASE WHEN c_custkey % 12 = 0 THEN 'none' ELSE 'escalate' END WHEN NOT usable THEN 'escalate' WHEN computed = c_custkey % 12 THEN 'none' ELSE 'computed' END AS action FROM customer LEFT JOIN a ON o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey")
def c19_years(spark, sf_dir):
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), month.cast("long").alias("lo"), (month + F.col("o_orderkey") % 20 - 2).alias("hi"), (F.col("o_orderstatus") != "P").alias("relevant"))
    return audits.years_check(spans, table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 12).alias("years")), "c_custkey")


@query("WITH t AS (SELECT p_partkey % 25 AS person, p_partkey AS start, unnest([p_type || ' ' || p_name, p_name || ' ' || lower(p_type)]) AS title FROM part), w AS (SELECT person, start, list_filter(string_split(lower(title), ' '), lambda x: x NOT IN ('promo', 'large')) AS w FROM t) SELECT person, array_to_string(w, ' ') AS keyword, min(start) AS start FROM w WHERE len(w) >= 2 GROUP BY 1, 2")
def m26_title_keywords(spark, sf_dir):
    titles = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("person"), F.col("p_partkey").alias("start"), F.concat(F.col("p_type"), F.lit(" "), F.col("p_name"), F.lit(" / "), F.col("p_name"), F.lit(" "), F.col("p_type")).alias("title"))
    return audits.role_keywords(titles, "person", ("promo", "large")).select("person", "keyword", F.col("first.start").alias("start"))


#: Documents by part number: what the gate keeps of them, with why, centrality and what that rests on; first what a profile has already.
KNOWN = ["natural language processing", "nlp", "react", "react native", "sql", "kafka", "node.js"]
CLAIMS = (
    ("Skills\nkafka, react\nWork Experience\n{p_brand}\n- Used kafka with sql.", [("kafka", "listed under skills", 5, "listed under skills, named more than once, used in experience or projects"), ("react", "listed under skills", 3, "listed under skills")]),
    ("Skills\nNLP\nProjects\n{p_brand}\n- Natural language processing of {p_size} texts.", [("nlp", "listed under skills", 3, "listed under skills"), ("natural language processing", "its expansion 'nlp' is listed under skills", 4, "listed under skills, used in experience or projects")]),
    ("Summary\nsql, and more sql at {p_brand}.\nMysql; react native", [("sql", "named more than once", 3, "named more than once, used in experience or projects")]),
    ("Work Experience\n{p_brand}\n- andkafka and kafka once, nodejs twice: nodejs", [("kafka", "named more than once", 3, "named more than once, used in experience or projects")]),
    ("nothing at {p_brand}", []),
)
_Q = lambda x: "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)
KEPT = "kept(k, term, why, centrality, rests_on) AS (VALUES " + ", ".join(f"({k}, {', '.join(map(_Q, row))})" for k, (_, rows) in enumerate(CLAIMS) for row in rows) + ")"


def _kept(spark, sf_dir):
    found = gate.hits(_filled(spark, sf_dir, CLAIMS), KNOWN, "p_partkey")
    return gate.gated(found, gate.abbreviations(gate.vocabulary_of(spark, KNOWN)), "p_partkey")


@query(f"WITH {KEPT} SELECT p_partkey, term, why FROM part JOIN kept ON p_partkey % {len(CLAIMS)} = k")
def c10_structural_gate(spark, sf_dir):
    """The terms that documents really claim, each with its reason."""
    return _kept(spark, sf_dir).select("p_partkey", "term", "why")


@query(f"WITH {KEPT} SELECT p_partkey, term, centrality, rests_on FROM part JOIN kept ON p_partkey % {len(CLAIMS)} = k")
def c11_centrality(spark, sf_dir):
    """How central each of them is to its document, and what that rests on."""
    return _kept(spark, sf_dir).select("p_partkey", "term", "centrality", "rests_on")


@query(f"WITH {KEPT}, own AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'kafka' ELSE 'sql' END AS term, 4 AS weight FROM part) SELECT p_partkey, term, weight, '' AS added FROM own UNION ALL SELECT p_partkey, term, centrality, why FROM part JOIN kept ON p_partkey % {len(CLAIMS)} = k WHERE term <> CASE WHEN p_size % 2 = 0 THEN 'kafka' ELSE 'sql' END")
def c12_widen(spark, sf_dir):
    """Profiles with what their documents claim beside it."""
    own = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "Kafka ").otherwise(" SQL").alias("raw"))
    wide = gate.widened(own.select("p_partkey", F.col("raw").alias("term"), F.lit(4).alias("weight")), _kept(spark, sf_dir), "p_partkey")
    return wide.select("p_partkey", F.trim(F.lower("term")).alias("term"), "weight", "added")
