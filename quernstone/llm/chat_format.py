r"""Chat formatting with a grammar round trip.

A conversation is rendered as text, reparsed by a deterministic parser, and the recovered turns are compared with
the source. Where they differ, the content conflicts with the grammar and is rendered at the next escape
level, until parse(render(x)) = x. The level is written in the output, so that reading needs nothing else.

    text  := level turn*              level := "0" | "1"
    turn  := "<s>[INST] " role "\n" body " [/INST]</s>"      not under the loss mask
           | "<s>" role "\n" body "</s>"                     assistant; body is under the loss mask

Level 0 escapes the control strings <s>, </s>, [INST] and [/INST] alone, and only in the text in which they stand: a backslash goes behind the first
character, one more where there are some already, so that taking one away gives the text back. Everything else is written as it is. Level 1 escapes the sign of
references and the control strings' first characters in the whole conversation, and the line feed in roles, which is what level 0 can't write. As neither "<" nor
"[" is left, level 1 always reads back. At either level control strings stand in the output as marks only.

Rows of a conversation are ordered by turn, then role, then text; null turns come first. A null role or text
counts as empty. Repeated rows stay. Further columns are ignored; an empty table gives an empty result. A
conversation is one output row, so its rows meet in one task, as the output format demands. All
expressions are built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS, INST, END_INST = "<s>", "</s>", "[INST] ", " [/INST]"
#: Level 1: (character, reference), applied in this order and undone in the other. The last one holds in roles alone.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPE = ("\n", "&#10;")
#: Level 0: a control string, or one that is escaped already.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
LOSS_ROLE = "assistant"


def escape(text: Column, level: int, role: bool = False) -> Column:
    if level:
        for char, ref in (*ESCAPES, ROLE_ESCAPE) if role else ESCAPES:
            text = F.replace(text, F.lit(char), F.lit(ref))
        return text
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column, level: int, role: bool = False) -> Column:
    if level:
        for char, ref in reversed((*ESCAPES, ROLE_ESCAPE) if role else ESCAPES):
            text = F.replace(text, F.lit(ref), F.lit(char))
        return text
    return F.regexp_replace(text, CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def render(turns: Column, level: int) -> Column:
    """The text of an array of (role, text)."""

    def one(t: Column) -> Column:
        body = F.concat(escape(t["role"], level, True), F.lit("\n"), escape(t["text"], level))
        return F.when(t["role"] == LOSS_ROLE, F.concat(F.lit(BOS), body, F.lit(EOS))).otherwise(F.concat(F.lit(BOS + INST), body, F.lit(END_INST + EOS)))

    return F.concat(F.lit(str(level)), F.array_join(F.transform(turns, one), ""))


def parse_at(text: Column, level: int) -> Column:
    """Turns (role, text, loss) of a text written at a level."""
    parts = F.split(F.substr(text, F.lit(2)), EOS, -1)
    pieces = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(p: Column) -> Column:
        inst = F.startswith(p, F.lit(BOS + INST))
        inner = F.when(inst, F.substr(p, F.lit(len(BOS + INST) + 1), F.greatest(F.length(p) - len(BOS + INST) - len(END_INST), F.lit(0)))).otherwise(F.substr(p, F.lit(len(BOS) + 1)))
        at = F.instr(inner, "\n")
        return F.struct(unescape(F.substr(inner, F.lit(1), at - 1), level, True).alias("role"), unescape(F.substr(inner, at + 1), level).alias("text"), (~inst).alias("loss"))

    return F.transform(pieces, one)


def parse(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("0")), parse_at(text, 0)).otherwise(parse_at(text, 1))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, level, loss_spans (array of start and end, code points in `formatted`, at the written level)."""
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(item)).alias("__t"))
    # array_sort puts null fields last inside structs or first depending on type: the order is made explicit for null turns
    turns = F.concat(F.filter("__t", lambda t: t["turn"].isNull()), F.filter("__t", lambda t: t["turn"].isNotNull()))
    source = grouped.select("conv_id", F.transform(turns, lambda t: F.struct(t["role"], t["text"])).alias("__s"))
    plain = source.withColumn("__f0", render(F.col("__s"), 0))
    back = F.transform(parse_at(F.col("__f0"), 0), lambda t: F.struct(t["role"], t["text"]))
    loss = F.transform(parse_at(F.col("__f0"), 0), lambda t: t["loss"])
    same = (back == F.col("__s")) & (loss == F.transform("__s", lambda t: t["role"] == LOSS_ROLE))
    chosen = plain.withColumn("formatted", F.when(same, F.col("__f0")).otherwise(render(F.col("__s"), 1)))
    out = chosen.select("conv_id", "formatted", F.substr("formatted", F.lit(1), F.lit(1)).cast("int").alias("level"))
    return out.withColumn("loss_spans", loss_spans(F.col("formatted")))


def loss_spans(text: Column) -> Column:
    """Spans of the loss mask in a formatted text: (start, end), code points, end exclusive."""
    parts = F.split(F.substr(text, F.lit(2)), EOS, -1)
    pieces = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + len(BOS) + F.instr(F.substr(p, F.lit(len(BOS) + 1)), "\n")
        end = acc["at"] + F.length(p)
        span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct((end + len(EOS)).cast("int").alias("at"), F.when(F.startswith(p, F.lit(BOS + INST)), acc["spans"]).otherwise(F.concat(acc["spans"], span)).alias("spans"))

    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests, read from the formatted text and its loss spans."""
    unmasked = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    loss = F.array_join(F.when(F.col("level") == 0, F.transform(unmasked, lambda t: unescape(t, 0))).otherwise(F.transform(unmasked, lambda t: unescape(t, 1))), "")
    turns = formatted.withColumn("__p", parse(F.col("formatted"))).withColumn("__loss", loss)
    whole = F.array_join(F.transform("__p", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("__p").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("level").cast("int").alias("escape_level"),
    )
