"""Small text expressions, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming removes.
_BLANKS = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(lowered: Column, words) -> Column:
    """True if any word occurs; a NULL text contains nothing."""
    return F.coalesce(any_of([F.contains(lowered, F.lit(w)) for w in words]), F.lit(False))


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any_sql(lowered: str, words) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {quote(w)})" for w in words) + ")"


def occurrences_sql(text: str, phrase: str) -> str:
    """Non-overlapping occurrences of a phrase, counted from the left."""
    return f"(length({text}) - length(replace({text}, {quote(phrase)}, ''))) div {len(phrase)}"


def whole_word(words) -> str:
    """Pattern for any of the words with no letter, digit or underscore beside it."""
    edge = r"[\p{L}\p{N}_]"
    return rf"(?iu)(?<!{edge})(?:{'|'.join(words)})(?!{edge})"


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured group of the first match, NULL if there is none. The group must
    hold at least one character whenever the pattern matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
