"""Column expressions shared by the operators. All are built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def both(conditions: list[Column]) -> Column:
    """Conjunction; true if there is nothing to meet."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double; 0 if the lengths differ or a norm is 0."""
    a, b = as_double(col(a)), as_double(col(b))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norms))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def bucket(c: Column, bounds: list[tuple[float, str]], rest: str, at_least: bool = True) -> Column:
    """Label of the first bound that c reaches (or, with at_least=False, does not exceed)."""
    out = F
    for bound, label in bounds:
        out = out.when(c >= bound if at_least else c <= bound, label)
    return out.otherwise(rest)


def string_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b)).cast("double")
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def contains_any(c: Column, words: list[str]) -> Column:
    return either([F.contains(c, F.lit(w)) for w in words])


def occurrences(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("long")


def labels(pairs: list[tuple[Column, str]]) -> Column:
    """Labels of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(x)) for c, x in pairs]), lambda v: v.isNotNull())


def words(c: Column) -> Column:
    """Words cut at white space; none for a blank text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def terms(text: str) -> list[str]:
    """Search terms of a query: runs of letters, digits, _ and -, of 3 characters or more, in lower case and order, without repeats."""
    import re

    return list(dict.fromkeys(t for t in re.findall(r"[a-zA-Z0-9_-]+", text.lower()) if len(t) >= 3))


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as a Java regular expression that ignores case: *, ?, [set], [!set]; a [ that is not closed stands for itself."""
    import re

    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) >= 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?is)^{out}$"
