"""Recall of re-parameterised questions: generated items, each with other names, numbers and units."""

import random

import pytest

pytest.importorskip("quernstone.llm")
from quernstone.llm import decontaminate as d  # noqa: E402

NAMES = "Anna Bob Carla Dmitri Elena Farid Greta Hiro Ines Jonas Kofi Lena Mara Nils Olga Pedro".split()
THINGS = "apples pencils stamps marbles tickets bottles postcards buttons".split()
UNITS = "kilometers miles meters hours minutes kilograms dollars euros".split()
FORMS = (
    "{a} has {x} {t} and gives {y} of them to {b} before lunch, so how many {t} are left for {a} after a walk of {z} {u} through the old town",
    "On the way home {a} pays {x} dollars for a box of {t} and {b} pays {y} dollars for the same box, what do both of them pay after {z} {u} of talk",
    "A train that carries {x} boxes of {t} leaves the station with {a} on board and after {z} {u} it meets {b} who waits with {y} more boxes",
    "If every one of the {x} children in the class of {a} brings {y} {t} to school, how many does {b} count at the end of the day after {z} {u}",
)


def values(rng, names):
    a, b = rng.sample(names, 2)
    x, y, z = rng.sample(range(2, 900), 3)
    return {"a": a, "b": b, "x": x, "y": y, "z": z, "u": rng.choice(UNITS)}


def test_recall(spark):
    rng = random.Random(11)
    items, docs = [], []
    for k in range(60):
        form, thing = FORMS[k % len(FORMS)], THINGS[k % len(THINGS)]
        v = values(rng, NAMES[:8])
        items.append((k, form.format(t=thing, **v)))
        pad = " ".join(f"word{rng.randrange(10_000)}" for _ in range(40))
        docs.append((k, f"{pad}. {form.format(t=thing, **values(rng, NAMES[8:]))} {pad}"))
        # the same name for both people, and the same number for two: not the question with other values
        w = values(rng, NAMES[8:])
        docs.append((1000 + k, f"{pad}. {form.format(t=thing, **{**w, 'b': w['a'], 'y': w['x']})} {pad}"))
    found = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id): r.reparameterised for r in found}
    hit = [k for k in range(60) if pairs.get((k, k))]
    assert len(hit) >= 54
    assert not [p for p in pairs if p[0] >= 1000]
