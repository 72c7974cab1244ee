"""Column functions on what résumés and models write: months, lists of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import blank, once

#: Words for today, the first letters of months, and caps of a list.
PRESENT = ("present", "current", "now", "ongoing", "till date", "to date")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ITEMS, CHARACTERS = 20, 120


def month_index(text: Column | str, as_of: Column) -> Column:
    """year * 12 + month (from 1) of a month as written: "Jan 2021", "2021-03", "15 Jan 2021", "2021", "present"; null if unreadable.

    The first month by name counts, else the first number of 1 to 12; without either it is January. A number that is neither a year
    nor a month, nor a day of 1 to 12, makes a date unreadable unless a month is named in another way.
    """
    low = F.lower(F.trim(blank(text)))
    number = F.create_map(*[x for k, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(k))])

    def read(tokens: Column) -> Column:
        first = lambda a: F.get(a, F.lit(0))
        whole = F.filter(F.transform(F.filter(tokens, lambda t: t.rlike("^[0-9]+$")), lambda t: F.coalesce(t.try_cast("long"), F.lit(1 << 40))), lambda n: n.isNotNull())
        years = F.filter(whole, lambda n: (n > 1900) & (n < 2100))
        named = F.filter(F.transform(tokens, lambda t: F.try_element_at(number, F.left(t, F.lit(3)))), lambda n: n.isNotNull())
        small = F.filter(whole, lambda n: n.between(1, 12))
        at = lambda test: F.coalesce(first(F.filter(F.transform(tokens, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())), F.lit(1 << 30))
        by_name = at(lambda t: F.try_element_at(number, F.left(t, F.lit(3))).isNotNull()) < at(lambda t: t.rlike("^[0-9]+$") & t.try_cast("long").between(1, 12))
        month = F.when(by_name, first(named)).otherwise(first(small))
        odd = F.exists(whole, lambda n: ((n > 12) & (n < 1900)) | (n >= 2100))
        return F.when(~(odd & month.isNull()), first(years) * 12 + F.coalesce(month, F.lit(1)))

    now = F.year(as_of) * 12 + F.month(as_of)
    return F.when(low.isin(*PRESENT), now.cast("long")).otherwise(once(F.split(F.regexp_replace(low, "[/,-]", " "), r"\s+"), read)).cast("long")


def signal(text: Column | str, most: int = CHARACTERS) -> Column:
    """A string without control characters, its white space collapsed, cut to ``most`` characters; blank for null."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(blank(text), r"[\x00-\x1f\x7f]", " "), r"(?U)\s+", " "))
    return F.trim(F.left(clean, F.lit(most)))


def signal_list(values: Column | str, items: int = ITEMS, characters: int = CHARACTERS) -> Column:
    """The first ``items`` usable strings of a list, each once whatever its case, in order; no list is an empty one."""
    array = F.coalesce(F.col(values) if isinstance(values, str) else values, F.array().cast("array<string>"))

    def first_of_each(clean: Column) -> Column:
        lower = F.transform(clean, F.lower)
        return F.slice(F.filter(clean, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1), 1, items)

    return once(F.filter(F.transform(array, lambda x: signal(x, characters)), lambda x: x != ""), first_of_each)
