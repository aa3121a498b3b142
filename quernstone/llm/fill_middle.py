r"""Fill-in-middle transformation by lookaround splitting.

A unit grammar names the pairs of neighbouring character classes between which one unit ends and the next begins. It is
translated to a regex of zero-width boundaries, "left class behind, right class ahead", at which Spark's split cuts. As a boundary
has no width, no character is lost: the pieces joined give the text, whatever the grammar.

A text of n units is cut at two unit boundaries, drawn from a digest of the row's id, into prefix, middle and suffix. They are written as

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text itself

and restored() reads the text back from output and form alone. Plain are empty texts, texts that hold a sentinel, and a share of the others.

All expressions are built-in functions; a row is looked at once and nothing is shuffled. Classes are matched over code points: a lookbehind
can't end inside a surrogate pair, so no character is cut.

Defined cases: a null text counts as empty; an empty text has no unit (split would give one empty piece) and is plain; a null id counts
as an empty one; repeated rows are cut alike; very long texts need memory in proportion to their units; an empty table gives an empty
result; columns that are in the table already are replaced by results of the same name, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY = r"[\s\S]"
#: (class behind, class ahead) of each boundary.
GRAMMARS = {
    "character": ((ANY, ANY),),
    "word": ((r"\S", r"\s"),),  # white space goes with the word after it
    "token": ((r"\w", r"\W"), (r"\W", r"\w")),  # runs of word characters, and what is between
    "line": ((r"\n", ANY),),  # a line keeps its end
    "sentence": ((r"[.!?]", r"\s"),),
}


def boundary(grammar: tuple[tuple[str, str], ...]) -> str:
    """The regex of a grammar's boundaries; zero-width, so a split at it keeps every character."""
    return "|".join(f"(?<={left})(?={right})" for left, right in grammar)


def units(text: Column, grammar: tuple[tuple[str, str], ...]) -> Column:
    """The units of a text; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(id_col: Column, salt: str) -> list[Column]:
    """Four numbers below 2^32 that depend on the id alone."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, unit: str | tuple = "character", id_col: str = "doc_id", text: str = "text", salt: str = "1:", keep_plain: int = 10, suffix_first: int = 20) -> DataFrame:
    """Add n (units), form, prefix_units, middle_units, prefix_chars, middle_chars (null if plain) and output. keep_plain and suffix_first are percentages; unit is a name of GRAMMARS or a grammar."""
    grammar = GRAMMARS[unit] if isinstance(unit, str) else unit
    h = draws(F.col(id_col), salt)
    body = F.coalesce(F.col(text), F.lit(""))
    held = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        held |= F.contains(body, F.lit(sentinel))
    form = F.when((body == "") | held | (h[2] % 100 >= 100 - keep_plain), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    marked = docs.withColumns({"form": form, "__body": body, "__h1": h[0], "__h2": h[1]})

    def cut(pieces: Column) -> Column:
        n = F.size(pieces).cast("long")
        x, y = F.col("__h1") % (n + 1), F.col("__h2") % (n + 1)
        a, b = F.least(x, y).cast("int"), F.greatest(x, y).cast("int")
        part = lambda start, count: F.array_join(F.slice(pieces, start + 1, count), "")
        three = F.struct(a.cast("long").alias("a"), (b - a).cast("long").alias("b"), part(F.lit(0), a).alias("prefix"), part(a, b - a).alias("middle"), part(b, F.size(pieces) - b).alias("suffix"))
        return F.struct(n.alias("n"), F.when(F.col("form") != "plain", three).alias("parts"))

    # one lambda over an array of one binds the pieces, so a text is split once
    split = marked.withColumn("__cut", F.transform(F.array(units(F.col("__body"), grammar)), cut)[0])
    p = F.col("__cut.parts")
    psm = F.concat(F.lit(PREFIX), p["prefix"], F.lit(SUFFIX), p["suffix"], F.lit(MIDDLE), p["middle"])
    spm = F.concat(F.lit(SUFFIX), p["suffix"], F.lit(PREFIX), p["prefix"], F.lit(MIDDLE), p["middle"])
    out = split.withColumns({
        "n": F.col("__cut.n"), "prefix_units": p["a"], "middle_units": p["b"], "prefix_chars": F.length(p["prefix"]).cast("long"), "middle_chars": F.length(p["middle"]).cast("long"),
        "output": F.when(F.col("form") == "plain", F.col("__body")).when(F.col("form") == "psm", psm).otherwise(spm),
    })
    return out.drop("__cut", "__body", "__h1", "__h2")


def restored(output: Column, form: Column) -> Column:
    """The text, from what was written: each sentinel stands in an output once, as texts that hold one are plain."""
    head = F.substr(output, F.lit(4))
    between = lambda sentinel: (F.substring_index(head, sentinel, 1), F.substring_index(F.substring_index(head, sentinel, -1), MIDDLE, 1))
    middle, (prefix, suffix), (suffix2, prefix2) = F.substring_index(head, MIDDLE, -1), between(SUFFIX), between(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix2, middle, suffix2))


def digests(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return done.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
