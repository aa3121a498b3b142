"""Fill-in-middle against a plain version over Python strings, and its defined cases."""

import hashlib

import pytest

pytest.importorskip("quernstone.llm")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quernstone.llm import fill_middle  # noqa: E402

SCHEMA = "doc_id long, text string"
ODD = [(1, "a\U0001f600b\nc \U0001f600\U0001f600éx"), (2, ""), (3, None), (None, "hello"), (5, "x<P>y"), (6, "\U0001f600" * 70), (6, "\U0001f600" * 70), (7, "<" * 40 + "S"), (8, "\r\n\t \x85 " * 9), (9, "w" * 200_000), (10, "<S" * 30), (11, "<M" * 31)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_version(doc_id, text):
    t = text or ""
    d = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    pre, mid, suf = t[:a], t[a:b], t[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, n, form, a, b - a, sha(f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"), sha(t)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_plain_version(spark):
    got = fill_middle.digests(fill_middle.transform(spark.createDataFrame(ODD, SCHEMA)))
    assert rows(got) == sorted((plain_version(*r) for r in ODD), key=str)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("<>PSM a\n.\U0001f600́"), max_size=60), min_size=1, max_size=12))
def test_any_text_comes_back(spark, texts):
    data = [(i, t) for i, t in enumerate(texts)]
    got = fill_middle.digests(fill_middle.transform(spark.createDataFrame(data, SCHEMA)))
    assert rows(got) == sorted((plain_version(*r) for r in data), key=str)


@pytest.mark.parametrize("unit", sorted(fill_middle.GRAMMARS))
def test_every_grammar_keeps_the_text(spark, unit):
    done = fill_middle.transform(spark.createDataFrame(ODD + [(20, "One two.  Three!\nFour five? Six")], SCHEMA), unit, keep_plain=0)
    back = done.select("text", fill_middle.restored(F.col("output"), F.col("form")).alias("r"), "form")
    assert all((r.text or "") == r.r for r in back.collect())
    assert {"psm"} <= {r.form for r in back.collect()}


def test_units_of_grammars(spark):
    text = "One two.\nThree"
    units = {g: spark.createDataFrame([(text,)], "text string").select(fill_middle.units(F.col("text"), fill_middle.GRAMMARS[g]).alias("u")).first().u for g in fill_middle.GRAMMARS}
    assert units["word"] == ["One", " two.", "\nThree"]
    assert units["line"] == ["One two.\n", "Three"]
    assert units["sentence"] == ["One two.", "\nThree"]
    assert units["token"] == ["One", " ", "two", ".\n", "Three"]
    assert units["character"] == list(text)


def test_no_rows_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fill_middle.digests(fill_middle.transform(empty)).count() == 0
    clash = spark.createDataFrame([(1, "abc", "mine", 7, "keep")], SCHEMA + ", form string, n long, other string")
    r = fill_middle.transform(clash).first()
    assert (r.n, r.other) == (3, "keep") and r.form in ("psm", "spm", "plain")


def test_native(spark):
    plan = fill_middle.digests(fill_middle.transform(spark.createDataFrame(ODD, SCHEMA)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
