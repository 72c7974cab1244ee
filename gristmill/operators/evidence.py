"""Evidence in documents that have sections: where concepts stand, what a line says about them, and what follows for a whole document.

Documents are exploded into lines where they are read; sections, entries, occurrences, status and shape are columns of lines or of occurrences in
lines, and all that is said of a document is an aggregate over these, the only shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import blank, bounded, located

WORK, PROJECT, SKILLS, SUMMARY, EDUCATION, CERTIFICATION, OTHER = "work", "project", "skills", "summary", "education", "certification", "other"
#: Headings (a whole line, folded to lower case without punctuation) of each kind of section.
HEADINGS = (
    (WORK, r"(?:work |professional |employment )?(?:experience|history)|employment"), (PROJECT, r"(?:personal |selected |key |academic )?projects?"),
    (SKILLS, r"(?:technical |core |key )?(?:skills|competencies)|technologies|tools(?: and platforms)?"), (SUMMARY, r"(?:professional |career )?(?:summary|profile|objective)|about(?: me)?"),
    (EDUCATION, r"education(?:al background)?|academics|coursework"), (CERTIFICATION, r"certifications?|licenses|courses"),
)
BULLET = r"^\s*[-–—*•]"
ENTRIES, CAPITALS = (WORK, PROJECT, EDUCATION), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: Cues of the status of an occurrence, in the order in which they are tried, and of its shape.
NEGATION, PLAN = r"\b(?:no|not|without|never|lacks?|rejected|instead of)\b", r"\b(?:plan(?:s|ned|ning)? to|want(?:s)? to|hop(?:e|es|ing) to|will|would like to)\b"
STUDY = r"\b(?:learn(?:ing|t|ed)?|stud(?:y|ied|ying)|course(?:work)?|training|bootcamp)\b"
ACTION = r"\b(?:built|build|building|developed|designed|implemented|created|wrote|shipped|migrated|deployed|automated|maintained|led)\b"
ATTACHED = r"\b(?:with|using|via|in|on|through|used|use|by)\b"
SHAPES = ("claim", "incidental", "substantive")


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", headings=HEADINGS) -> DataFrame:
    """doc, line, body, section, entry, heading: every line with the section and the named entry it belongs to.

    An entry is the first line of a name (a capital or digit first, under 120 characters, no bullet) after a heading or after bullets, in a section
    of work, projects or education; after a bullet whose sentence has not ended it is the bullet's next line instead. All of that is
    state of one text, carried from line to line where the text is read: no line is shuffled, and rows that repeat or lack an id stand by themselves.
    """
    kinds = [(name, re.compile(f"(?:{pattern})", re.A)) for name, pattern in headings]
    bullet_at, ended, apart = re.compile(BULLET), re.compile(r"[.;:!?]\s*$", re.A), re.compile(r"\s*[|–—]\s*", re.A)
    told, folded = re.compile(r":.*\S", re.A), re.compile(r"[^a-z ]+")

    def opened(body: str, trimmed: str, bullet: bool) -> str | None:
        if not trimmed or len(trimmed) > 60 or bullet or told.search(trimmed):
            return None
        name = folded.sub("", trimmed.lower().replace("&", "and")).strip(" ")
        return next((kind for kind, pattern in kinds if pattern.fullmatch(name)), None)

    def of(whole: str):
        section, entry, previous, in_bullet, named_in_block = OTHER, "", None, False, False
        for k, body in enumerate(whole.split("\n")):
            trimmed, bullet = body.strip(" "), bool(bullet_at.match(body))
            kind = opened(body, trimmed, bullet)
            if kind or bullet:
                in_bullet, named_in_block = bullet, False
            if kind:
                section, entry = kind, ""
            elif not bullet and section in ENTRIES and trimmed[:1] in CAPITALS and len(trimmed) < 120 and re.search("[A-Za-z]", trimmed) and (not in_bullet or bool(previous and ended.search(previous))):
                if not named_in_block:
                    entry = apart.split(trimmed)[0].strip(" ")
                named_in_block = True
            yield k, body, section, entry, kind is not None
            if trimmed:
                previous = body.rstrip(" ")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [(row, *x) for row, whole in enumerate(part.column(1).to_pylist()) for x in of(whole or "")]
                at, *rest = zip(*found)
                columns = [pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *columns], [doc, "line", "body", "section", "entry", "heading"])

    return docs.select(doc, F.col(text).alias("_text")).mapInArrow(run, f"`{doc}` {dict(docs.dtypes)[doc]}, line int, body string, section string, entry string, heading boolean")


def sections(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, section, entry, first_line, lines: the spans of a document, from the lines that aren't headings."""
    rows = lines(docs, doc, text).where("NOT heading")
    return rows.groupBy(doc, "section", "entry").agg(F.min("line").alias("first_line"), F.count("*").alias("lines"))


def occurrences(rows: DataFrame, concepts: dict[str, list[str]], body: str = "body") -> DataFrame:
    """rows with concept, alias, start, end, before, after of every alias in a line; a match inside a longer one doesn't count."""
    alias = {a.lower(): c for c, names in concepts.items() for a in names}
    names = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
    some = F.lower(blank(body)).rlike(bounded(alias))
    found = rows.where(some).withColumn("_o", F.explode(located(F.lower(blank(body)), bounded(alias), 10_000, 10_000)))
    return found.select(*rows.columns, F.element_at(names, F.col("_o.hit")).alias("concept"), F.col("_o.hit").alias("alias"), F.col("_o.start").alias("start"), F.col("_o.end").alias("end"), F.col("_o.before").alias("before"), F.col("_o.after").alias("after"))


def clause(before: Column | str, after: Column | str, ends: str = r"[.;!?]") -> tuple[Column, Column]:
    """What stands before and after in the same sentence (or whatever ``ends`` cuts)."""
    before, after = (F.col(x) if isinstance(x, str) else x for x in (before, after))
    return F.element_at(F.split(before, ends), -1), F.element_at(F.split(after, ends, 2), 1)


#: The verdicts on how far a cue reaches; the first and the last let it govern.
SAME_ITEM, SIBLING, ITEM_ENDS, NO_COORDINATION, LEAD_IN = "same clause item", "cue sits in a sibling list item", "cue ends its own list item rather than introducing one", "list states no coordination (no and/or)", "lead-in governing a coordinate list"


def verdicts(ahead: Column, hit: Column, behind: Column, cue: str) -> Column:
    """For every match of a cue in the clause around an occurrence, before it and then after it: may the cue govern it, and why (not)?

    A cue with a comma between it and the occurrence stands in another item of a list. It reaches over commas only as the lead-in of the
    list: nothing of the list before it, no comma right after it, and an and/or further on. After the occurrence it never does.
    """

    def before(x: Column) -> Column:
        rest = F.concat(x["after"], hit, behind)
        return F.when(~x["after"].contains(","), SAME_ITEM).when(x["before"].contains(","), SIBLING).when(x["after"].rlike(r"^\s*[,;]"), ITEM_ENDS).when(~rest.rlike(r"\b(?:and|or)\b"), NO_COORDINATION).otherwise(LEAD_IN)

    def after(x: Column) -> Column:
        return F.when(x["before"].contains(","), SIBLING).otherwise(SAME_ITEM)

    return F.concat(F.transform(located(ahead, cue, 10_000, 10_000), before), F.transform(located(behind, cue, 10_000, 0), after))


def governed(ahead: Column, hit: Column, behind: Column, cue: str) -> Column:
    """Does some match of a cue govern the occurrence?"""
    return F.exists(verdicts(ahead, hit, behind, cue), lambda why: why.isin(SAME_ITEM, LEAD_IN))


def judged(found: DataFrame, scoped: bool = False) -> DataFrame:
    """Occurrences with status (NEGATED, PLANNED, LEARNING, USED or MENTIONED, the first rule that holds) and shape (0 claim, 1 incidental, 2 substantive).

    A denial counts anywhere in the sentence; a plan before the occurrence, or after it up to a comma; learning in sections of education or
    by a word of it; use by a verb or a word that attaches. A list of skills, a summary or a labelled list of names only claims. ``scoped``: a cue of
    denial, plan or learning counts only if it governs the occurrence (``verdicts``). The sentence is cut out once, for all the rules.
    """
    own = [c for c in found.columns if c not in ("status", "shape")]
    found = found.select("*", *(x.alias(n) for x, n in zip(clause("before", "after"), ("_ahead", "_behind"))))
    ahead, behind = F.col("_ahead"), F.col("_behind")
    close, follows = clause(ahead, behind, ",")
    found = found.select("*", F.element_at(F.split(behind, r",|\b(?:and|but)\b", 2), 1).alias("_near"), close.alias("_close"), follows.alias("_follows"))
    near, close, follows = F.col("_near"), F.col("_close"), F.col("_follows")
    found = found.select("*", *((ahead.rlike(w) | follows.rlike(w)).alias(n) for w, n in ((ACTION, "_acts"), (ATTACHED, "_attached"))))
    acts, attached = F.col("_acts"), F.col("_attached")
    told = lambda cue, after=behind: ahead.rlike(cue) | after.rlike(cue)
    reach = (lambda cue: governed(ahead, F.col("alias"), behind, cue)) if scoped else (lambda cue: F.lit(True))
    status = (
        F.when(told(NEGATION) & reach(NEGATION), "NEGATED").when(told(PLAN, near) & reach(PLAN), "PLANNED")
        .when(F.col("section").isin(EDUCATION, CERTIFICATION) | told(STUDY) & reach(STUDY), "LEARNING").when(acts | close.rlike(ATTACHED), "USED").otherwise("MENTIONED")
    )
    listed = F.col("section").isin(SKILLS, SUMMARY) | F.col("heading") | F.col("body").rlike(r"^\s*[-–—*•]?\s*[A-Z][\w /&]{0,30}:\s")
    return found.select(*own, status.alias("status"), F.when(listed, 0).when(acts, 2).when(attached, 1).otherwise(0).alias("shape"))


def strength(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, concept, n, claimed, strength, entries, tier, why: one row for each concept of a document.

    ``entries`` counts separately named entries in which it is used; strength is none, claim, incidental, substantive, or independent (substantive in
    several entries). The tier follows the sections: used at work is CORE, built with in a project STRONG_SECONDARY.
    """
    claimed = F.col("status").isin("USED", "MENTIONED")
    best = lambda *where: F.max(F.when(claimed & (F.col("section").isin(*where) if where else F.lit(True)), F.col("shape")))
    used_in = F.when(claimed & (F.col("entry") != "") & (F.col("shape") >= 1), F.struct("section", "entry"))
    rows = found.groupBy(doc, "concept").agg(
        F.count("*").alias("n"), F.count_if(claimed).alias("claimed"), F.count_if(F.col("status") == "USED").alias("uses"), F.count_if(F.col("status") == "NEGATED").alias("refuted"), F.count_if(F.col("status") == "LEARNING").alias("learning"),
        F.size(F.collect_set(used_in)).alias("entries"), best().alias("best"), *(best(s).alias(f"in_{s}") for s in (WORK, PROJECT, SKILLS, SUMMARY, EDUCATION, CERTIFICATION)))
    has = lambda s: F.col(f"in_{s}").isNotNull()
    none = F.col("claimed") == 0
    tier = (
        F.when(none, "BACKGROUND").when(F.col("in_work") >= 1, "CORE").when(F.col("in_project") == 2, "STRONG_SECONDARY").when(has(PROJECT) | has(SKILLS) | has(SUMMARY), "SUPPORTING")
        .when(has(EDUCATION) | has(CERTIFICATION), "BACKGROUND").otherwise("SUPPORTING")
    )
    why = (
        F.when(none & (F.col("refuted") > 0), "rejected").when(none & (F.col("learning") > 0), "learning").when(none, "planned").when(F.col("in_work") >= 1, "used at work").when(F.col("in_project") == 2, "built with in a project")
        .when(has(PROJECT), "named in a project").when(has(SKILLS) & has(SUMMARY), "listed and in the summary").when(has(SKILLS), "listed").when(has(SUMMARY), "in the summary").when(has(EDUCATION) | has(CERTIFICATION), "studied").otherwise("named")
    )
    reach = F.when(none, "none").when((F.col("best") == 2) & (F.col("entries") > 1), "independent").otherwise(F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("best") + 1).cast("int")))
    return rows.select(doc, "concept", "n", "claimed", "uses", reach.alias("strength"), F.col("entries"), tier.alias("tier"), why.alias("why"))


@dataclass(frozen=True)
class Mode:
    """A kind of work: verbs that have to govern one of the objects."""

    name: str
    verbs: str
    objects: str


#: Kinds of work, words of delegation, and what separates a verb from its object.
MODES = (
    Mode("development", r"(?:built|build|building|developed|developing|wrote|coded|implemented|programmed|created)", r"(?:services?|apis?|applications?|apps?|components?|scripts?|triggers?|modules?|backends?|frontends?|librar(?:y|ies))"),
    Mode("configuration", r"(?:configured|configuring|customi[sz]ed|set up|administered|managed)", r"(?:workflows?|profiles?|permissions?|dashboards?|reports?|objects?|settings?)"),
    Mode("pipelines", r"(?:built|developed|designed|automated|ingested|orchestrated)", r"(?:pipelines?|etl|warehouses?|ingestion|data models?)"),
)
DELEGATES, PEOPLE = r"\b(?:coordinated|worked|liaised|partnered|collaborated) (?:with|alongside)\b|\b(?:delegated|assigned|oversaw)\b", r"\b(?:developers?|engineers?|teams?|vendors?|consultants?)\b"
APART = r"\b(?:for|of|in|on|to|with|from|by|about|during|across)\b|[,;:()]|\b(?:and|but|which|that)\b"
CONSULTING = "consulting"


def attached(before: Column, after: Column, verbs: str) -> Column:
    """Does the nearest verb on either side act on what stands between: with no preposition, conjunction or break in between?"""
    last, first = rf"^.*\b{verbs}\b(.*?)$", rf"^(.*?)\b{verbs}\b"
    return (before.rlike(rf"\b{verbs}\b") & ~F.regexp_extract(before, last, 1).rlike(APART)) | (after.rlike(rf"\b{verbs}\b") & ~F.regexp_extract(after, first, 1).rlike(APART))


def work_hits(rows: DataFrame, modes: tuple[Mode, ...] = MODES, doc: str = "doc_id") -> DataFrame:
    """doc, section, entry, mode, kind (governed or delegated), status, clause: what a document's lines say was done, each clause once for each mode.

    The objects of all modes are looked for in one pass over the lines; an object then counts for every mode that has it.
    """
    objects = rf"\b(?:{'|'.join(m.objects for m in modes)})\b"
    named = F.array(*[F.struct(F.lit(m.name).alias("name"), F.lit(rf"^{m.objects}$").alias("objects"), F.lit(rf"\b{m.verbs}\b").alias("verbs")) for m in modes])
    found = rows.where(F.lower(blank("body")).rlike(objects)).withColumn("_o", F.explode(located(F.lower(blank("body")), objects, 10_000, 10_000)))
    found = found.select("*", F.col("_o.hit").alias("alias"), F.col("_o.before").alias("before"), F.col("_o.after").alias("after")).drop("_o")
    left, right = clause("before", "after", r"[.;!?]")
    told = found.select("*", left.alias("left"), right.alias("right"), F.concat(left, F.col("alias"), right).alias("clause"))
    told = told.select("*", F.explode(F.filter(named, lambda m: F.regexp_like(F.col("alias"), m["objects"]) & F.regexp_like(F.col("clause"), m["verbs"]))["name"]).alias("_mode"))
    each = lambda use: F.coalesce(*[F.when(F.col("_mode") == m.name, use(m)) for m in modes])
    others = F.col("clause").rlike(DELEGATES) & F.col("clause").rlike(PEOPLE) | each(lambda m: F.col("left").rlike(rf"{PEOPLE}\s+(?:who |that )?{m.verbs}\b"))
    told = judged(told).withColumn("delegated", others).where(F.col("delegated") | each(lambda m: attached(F.col("left"), F.col("right"), m.verbs)))
    kind = F.when(F.col("delegated"), "delegated").otherwise("governed")
    return told.select(doc, "section", "entry", F.when(F.col("delegated"), CONSULTING).otherwise(F.col("_mode")).alias("mode"), kind.alias("kind"), "status", "line", "clause").distinct()


def work_modes(hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, mode, asserted, learning, refuted, delegated, entries, strength: strong with several named entries or two assertions, weak with one."""
    refuted, learning = F.col("status").isin("NEGATED", "PLANNED"), F.col("status") == "LEARNING"
    asserted = ~refuted & ~learning
    rows = hits.groupBy(doc, "mode").agg(F.count_if(asserted).alias("asserted"), F.count_if(learning).alias("learning"), F.count_if(refuted).alias("refuted"), F.count_if(F.col("kind") == "delegated").alias("delegated"), F.size(F.collect_set(F.when(asserted & (F.col("entry") != ""), F.struct("section", "entry")))).alias("entries"))
    return rows.withColumn("strength", F.when(F.col("asserted") == 0, "none").when((F.col("entries") > 1) | (F.col("asserted") >= 2), "strong").otherwise("weak"))


def role_record(modes: DataFrame, families: dict[str, tuple[str, bool]], doc: str = "doc_id") -> DataFrame:
    """doc, thin, supported, transition: families whose mode is strong enough, and modes that are only learnt.

    ``families`` maps a name to (mode, is it gated); a gated family needs a strong mode, any other a weak one.
    """
    rank = F.when(F.col("strength") == "strong", 2).when(F.col("strength") == "weak", 1).otherwise(0)
    names = [F.when((F.col("mode") == mode) & (F.col("rank") >= (2 if gated else 1)), name) for name, (mode, gated) in families.items()]
    rows = modes.withColumn("rank", rank).select("*", F.array_compact(F.array(*names)).alias("families"))
    flat = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",")
    only = F.when((F.col("learning") > 0) & (F.col("asserted") == 0), F.array("mode")).otherwise(F.array().cast("array<string>"))
    return rows.groupBy(doc).agg((F.sum("asserted") < 2).alias("thin"), flat("families").alias("supported"), flat(only).alias("transition"))
