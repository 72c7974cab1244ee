"""What a posting says about years of experience: every figure read and classified, and the minimum it confirms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import blank, c, located, once

#: A figure of years, with the upper end of a range; and a figure for which the end doesn't matter.
FIGURE = r"(?i)(\d{1,2})\s*\+?\s*(?:(?:[-–—]|to)\s*(\d{1,2})\s*\+?\s*)?(?:years?|yrs?)(?:\(s\))?"
YEARS = r"(\d{1,2})\s*\+?\s*(?:[-–—]|to)?\s*(?:\d{1,2}\s*\+?\s*)?(?:years?|yrs?)(?:\(s\))?"
#: Wording that tells what a figure counts.
EXPERIENCE = r"(?i)experience|hands[- ]on"
EXPERIENCE_OF = r"(?i)^\s*(?:of|in)\s+[a-z]"
OTHER_AGE = r"(?i)^\s*(?:ago|old\b|of age|in business)"
COMPANY_AGE = r"(?i)(?:in business|been (?:around|operating|serving)|founded|established|celebrating|for over)\s*(?:for\s*)?(?:over\s*)?$"
SCHOOL = r"(?i)education|schooling|degree program"
STUDIES = r"(?i)education|schooling|degree|diploma|bachelor|master|graduation|b\.?\s?tech|b\.?\s?e\b|m\.?\s?tech|post[- ]graduat"
OF_OTHERS = r"(?i)combined|collectively|between us|our team|we have|the team has|across the team"
#: Labelled fields ("label: n years") and labels that aren't about experience.
FIELD, LABEL = r"(?i)\s*:\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b", r"(?U)[\w /&()]{0,40}$"
OTHER_LABEL = r"(?i)contract|duration|notice|tenure|validity|bond|period|term|warranty|internship|course|degree|education|age\b"
#: Wording of requirements, preferences and ceilings.
REQUIRED_BEFORE = r"(?i)(?:minimum|min\.?|at least|no less than|must have|must possess|mandatory|require[sd]?|required|requirement)\W*(?:of\s*)?$"
REQUIRED_AFTER = r"(?i)^\W*(?:\w+\s+){0,3}(?:require[sd]?|mandatory|is a must|must)\b"
PREFERRED = r"(?i)prefer(?:red|ably)?|ideally|ideal candidate|nice[- ]to[- ]have|nice to have|a plus|bonus|desirable|desired|advantage|would be great|we'?d love|good to have"
CEILING = r"(?i)(?:up to|no more than|less than|under|at most|maximum(?: of)?|max\.?)\s*$"
#: Words that leave a figure general, words that only connect, and words at which its object ends.
GENERAL = (
    "total", "overall", "combined", "cumulative", "professional", "relevant", "work", "working", "industry", "corporate", "commercial", "prior",
    "demonstrable", "proven", "progressive", "post-qualification", "hands-on", "hands", "on", "it", "software", "technology", "tech", "engineering",
    "development", "developing", "product", "business", "analysis", "analyst", "consulting", "functional", "technical", "full-time", "fulltime",
    "career", "employment", "job", "roles", "role", "similar", "related", "equivalent", "comparable", "applicable", "e", "experience", "exp",
)
CONNECTING = ("of", "in", "with", "as", "on", "at", "for", "the", "a", "an", "any", "or", "to", "within", "across", "least", "minimum", "min", "plus")
ENDING = (
    "required", "require", "requires", "requirement", "mandatory", "must", "is", "are", "have", "having", "needed", "need", "preferred", "desired",
    "essential", "expected", "and", "including", "include", "ideally", "you", "we", "candidates", "candidate",
)
CLAUSE_END = r"[.,;:()\[\]\n|/]|\bbut\b"
#: Years of gap from which it costs, and from which a posting goes.
PENALTY_GAP, DROP_GAP = 1.0, 2.0


def _earlier(text: Column, one: str, other: str) -> Column:
    """Does the first pattern stand in the text, and before any place of the other?"""
    at, than = F.regexp_instr(text, F.lit(one)), F.regexp_instr(text, F.lit(other))
    return (at > 0) & ((than == 0) | (at < than))


def scope(after: Column) -> Column:
    """overall, or skill_specific if a word that names something comes in the clause after a figure."""
    clause = F.lower(F.element_at(F.split(after, CLAUSE_END, 2), 1))
    words = F.transform(F.regexp_extract_all(clause, F.lit(r"([a-z][a-z.\-]*)"), F.lit(1)), lambda w: F.btrim(w, F.lit(".")))
    telling = F.filter(words, lambda w: ~w.isin(*GENERAL, *CONNECTING) | w.isin(*ENDING))
    return F.when(F.coalesce(F.get(telling, F.lit(0)).isin(*ENDING), F.lit(True)), "overall").otherwise("skill_specific")


def _with_years(text: Column | str, read) -> Column:
    """read(text) where any figure of years can be; null elsewhere, without a search for patterns."""
    low = F.lower(blank(text))
    return F.when(low.contains("year") | low.contains("yr"), once(blank(text), read))


def statements(text: Column | str) -> Column:
    """One struct per figure of years: min_years, max_years, requirement_type, scope, confidence, evidence, start; null where there can be none.

    requirement_type is not_experience, ambiguous, maximum, preferred, range or required; only an overall figure that
    the posting insists on (a word of requirement, a plus sign or a range) has high confidence.
    """
    return _with_years(text, _statements)


def _statements(body: Column) -> Column:
    def read(x: Column) -> Column:
        low, high = (F.regexp_extract(x["hit"], FIGURE, k).try_cast("int") for k in (1, 2))
        ends = F.struct(low.alias("low"), high.alias("high"), x["before"].rlike(REQUIRED_BEFORE).alias("insists"))
        return once(ends, lambda e: once(kind_of(x, e["high"], e["insists"]), lambda kind: once(about_of(x, kind), lambda about: stated(x, e, kind, about))))

    def kind_of(x: Column, high: Column, insists: Column) -> Column:
        before, after = x["before"], x["after"]
        counts = after.rlike(EXPERIENCE) | before.rlike(EXPERIENCE) | insists
        other = after.rlike(OTHER_AGE) | before.rlike(COMPANY_AGE) | _earlier(after, STUDIES, EXPERIENCE) | ~counts
        soft = F.right(before, F.lit(60)).rlike(PREFERRED) | F.left(after, F.lit(60)).rlike(PREFERRED)
        return (
            F.when(other, "not_experience").when(before.rlike(OF_OTHERS) | F.left(after, F.lit(40)).rlike(OF_OTHERS), "ambiguous")
            .when(before.rlike(CEILING), "maximum").when(soft, "preferred").when(high.isNotNull(), "range").otherwise("required")
        )

    def about_of(x: Column, kind: Column) -> Column:
        return F.when(kind.isin("preferred", "range", "required"), scope(x["after"])).otherwise("unknown")

    def stated(x: Column, e: Column, kind: Column, about: Column) -> Column:
        sure = kind.isin("range", "required") & (about == "overall") & (e["insists"] | x["after"].rlike(REQUIRED_AFTER) | x["hit"].contains("+") | e["high"].isNotNull())
        begin = F.greatest(x["start"] - 40, F.lit(0))
        return F.struct(
            e["low"].alias("min_years"), e["high"].alias("max_years"), kind.alias("requirement_type"), about.alias("scope"), F.when(sure, "high").otherwise("low").alias("confidence"),
            F.trim(F.substring(body, begin + 1, x["end"] + 50 - begin)).alias("evidence"), x["start"].alias("start"))

    return F.transform(located(body, FIGURE, 90, 90), read)


def confirmed_minimum(text: Column | str) -> Column:
    """(min_years, start, evidence, requirement_type) of the smallest figure with high confidence; null if none."""
    sure = F.filter(statements(text), lambda s: s["confidence"] == "high")
    return F.array_min(F.transform(sure, lambda s: F.struct(s["min_years"].alias("min_years"), s["start"].alias("start"), s["evidence"].alias("evidence"), s["requirement_type"].alias("requirement_type"))))


def gap_action(minimum: Column | str, months: Column | str) -> Column:
    """none, penalty or hard_drop by how far a candidate's months fall short of a confirmed minimum; unknown is none."""
    known = F.when(c(months) >= 0, c(months))
    gap = F.round(c(minimum) - F.round(known / 12.0, 2), 2)
    return F.when(gap >= DROP_GAP, "hard_drop").when(gap >= PENALTY_GAP, "penalty").otherwise("none")


def required_years(text: Column | str, least: bool = False) -> Column:
    """The largest (or ``least``) figure of years that counts experience, in prose or as a labelled field; null if there is none."""

    def counted(x: Column) -> Column:
        before, after = x["before"], x["after"]
        counts = after.rlike(EXPERIENCE) | after.rlike(EXPERIENCE_OF) | before.rlike(EXPERIENCE)
        other = after.rlike(OTHER_AGE) | before.rlike(COMPANY_AGE) | _earlier(after, SCHOOL, EXPERIENCE)
        return F.when(counts & ~other, F.regexp_extract(x["hit"], YEARS, 1).try_cast("int"))

    def labelled(x: Column) -> Column:
        return F.when(~F.regexp_extract(x["before"], LABEL, 0).rlike(OTHER_LABEL), F.regexp_extract(x["hit"], FIELD, 1).try_cast("int"))

    read = lambda low: F.array_compact(F.concat(F.transform(located(low, YEARS, 30, 60), counted), F.transform(located(low, FIELD, 60, 0), labelled)))
    found = _with_years(F.lower(blank(text)), read)
    return F.array_min(found) if least else F.array_max(found)
