"""The filter audit against a plain form that takes every document through every order."""

import itertools
import re
from collections import Counter

from tests.llm import cases
from tremorlake.llm import op11_audit as op


def failing(docs):
    """(doc_id, part, set of failed filters) of every row."""
    least: dict = {}
    for d, t, _ in docs:
        least[t or ""] = min(d, least.get(t or "", d))
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), least[t] < d]
        yield d, s or "", {f for f, x in zip("ABCDE", tests) if x}


def plain(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    rows = [(d, p, f) for d, p, f in failing(docs)]
    out = {}
    for part in {p for _, p, _ in rows}:
        shapley: Counter = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[1] == part]
            for k, x in enumerate(order):
                gone = [r for r in left if x in r[2]]
                left = [r for r in left if x not in r[2]]
                mine = [r for r in rows if r[1] == part and x in r[2]]
                shapley[x] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), len(mine) - len(gone), sum(r[2] == {x} for r in mine), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, True) for r in docs], "doc_id long, text string, source string, mask int, first boolean").repartition(3)
    found = op.interactions(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {tuple(r)[:3]: tuple(r)[3:] for r in found}


def test_every_order_equals_the_plain_form(spark):
    say = cases.documents(2, 40)
    docs = [(d, t, [None, "", "a", "b"][d % 4]) for d, t, *_ in say]
    base = " ".join(f"Word{i}" for i in range(220))
    docs += [(100, base, "a"), (101, base, "b"), (101, base, "b"), (102, base.lower(), "a"), (103, base.lower() + " 5%", "a"), (104, "x " * 400, "a"), (105, "A\x0bB\x0cA " * 90 + "$", "c"), (90, base, "c")]
    docs += [(7, "another text of a doc_id", "a"), (7, base, "d")]
    labels = [(d, d % 2, d % 3 % 2) for d in range(0, 106, 2)] + [(100, 0, 1), (101, 1, None), (103, None, 1), (None, 1, 1), (5000, 1, 1)]
    got = run(spark, [*docs, (None, "no id", "e")], labels)
    assert got == plain(docs, labels)
    assert len(got) == 600 * 5


def test_empty_tables_and_texts(spark):
    assert not run(spark, [], [(1, 1, 1)])
    got = run(spark, [(1, None, None), (2, "", "")], [])
    assert got == plain([(1, None, None), (2, "", "")], [])
    assert got["", "AEBCD", 1] == (0, 2, 0, 1, 0, 0, 180) and got["", "EABCD", 2] == (0, 1, 1, 1, 0, 0, 180)


def test_a_very_long_text(spark):
    text = "word " * 400_000 + "end"
    assert run(spark, [(1, text, "a")], []) == plain([(1, text, "a")], [])
