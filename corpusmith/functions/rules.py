"""Rules on texts as rows: a table of names and patterns becomes one native expression.

All patterns together are one pattern, and a text is scanned once whatever their number; what matched is then told apart by
trying the rules, in their order, on the matched text alone. So where two rules match at one place the earlier wins, matches don't overlap, and a pattern must be
able to match by the matched text alone: patterns that look ahead or behind, back-references and anchors are refused. A rule added to the table counts from the next query on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.multiset import multiset

#: Rules in one expression at most; more would be a dictionary to join with, not rules.
MOST = 500
REFUSED = re.compile(r"\(\?[=!<]|\\[1-9bBAzZGk]|(?<!\\)(?<!\[)\^|(?<!\\)\$")


def rules_of(table: DataFrame, name: str = "name", pattern: str = "pattern", order: str = "rank") -> list[tuple[str, str]]:
    """The rules of a table, in their order; null names and patterns are left out. More than MOST are an error."""
    rows = table.where(F.col(name).isNotNull() & F.col(pattern).isNotNull()).select(order, name, pattern).orderBy(order, name).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    return [(r[1], r[2]) for r in rows]


def matches(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The names of the rules that match, one for each match, in the order of the text; null texts have none."""
    for name, pattern in rules:
        re.compile(pattern)
        if REFUSED.search(pattern) or re.compile(pattern).match(""):
            raise ValueError(f"rule {name}: {pattern!r} depends on what is around it, or matches nothing")
    if not rules:
        return F.array().cast("array<string>")
    plain = [re.sub(r"(?<!\\)\((?!\?)", "(?:", p) for _, p in rules]
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("|".join(f"(?:{p})" for p in plain)), F.lit(0))

    def which(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for (name, _), p in zip(reversed(rules), reversed(plain), strict=True):
            out = F.when(m.rlike(rf"\A(?:{p})\z"), name).otherwise(out)
        return out

    return F.transform(found, which)


def counts(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Of each rule that matches, its name and how often, as a multiset."""
    return multiset(matches(text, rules))
