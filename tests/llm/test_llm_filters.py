"""The filter audit against brute force over documents, and its odd rows."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from mizan.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def by_brute_force(docs, labels):
    """docs: (doc_id, text, source); every order is applied to every document."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)

    def fails(i, text):
        words = WORDS.findall(text)
        caps = len(re.findall("[A-Z]", text))
        held = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * caps > 5 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        return {k for k, v in (held | {"E": i is not None and i > first[text]}).items() if v}

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(source or "", fails(i, text or ""), i in good, i in toxic) for i, text, source in docs]
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            every = left
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                before = [r for r in every if r[1] & set(order[: step - 1])]
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in r[1] for r in before), sum(r[1] == {f} for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone))
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def words(n, tail=""):
    return " ".join(f"w{i}" for i in range(n)) + tail


DOCS = [
    (1, words(60), "s"), (2, words(60), "s"), (2, words(60), "s"), (3, words(60), None), (4, words(60), ""), (0, words(60), "late"),
    (5, None, "s"), (6, "", "s"), (7, "", None), (None, "", "s"), (None, words(60), "s"), (None, None, None),
    (8, "same " * 80, "s"), (9, "same " * 80, "t"), (9, "same " * 80, "t"), (10, "SHOUT " * 70, "s"), (11, words(55, " $"), "t"), (12, words(49, "|"), "t"),
    (13, "É" * 90 + "A" * 5, "t"), (14, "ABCDE" + "x" * 95, "t"), (15, "ABCDEF" + "x" * 94, "t"), (16, words(64) + " w1" * 36, "t"), (17, words(65) + " w1" * 35, "t"),
    (18, "a b\x0bc\x0cd\x1ce " * 20, "t"), (19, words(30_000), "t"), (20, "x" * 300_000, "t"), (21, "\U0001f600" * 60, "t"), (22, " \t\n", "t"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (5, 0, 1), (8, 1, None), (9, 1, 1), (9, 1, 1), (None, 1, 1), (11, 1, 1), (12, 2, 2), (13, 1, 0), (99, 1, 1)]


def frames(spark, docs=DOCS, labels=LABELS):
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_by_brute_force(spark):
    docs, labels = frames(spark)
    assert got(filter_audit.audit(docs, labels)) == by_brute_force(DOCS, LABELS)


def test_audit_of_a_table(spark, small):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got(filter_audit.op11_filter_audit(spark, small)) == by_brute_force(docs, labels)


def test_audit_of_empty_tables_and_clashing_columns(spark):
    docs, labels = frames(spark)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert got(filter_audit.audit(docs, labels.limit(0))) == by_brute_force(DOCS, [])
    names = ("part", "copy", "mask", "words", "n", "good", "salt", "first", "kept", "own", "before", "a.b")
    more = lambda d: d.withColumns({c: F.lit(c) for c in names})
    assert got(filter_audit.audit(more(docs), more(labels))) == by_brute_force(DOCS, LABELS)


def test_own_filters(spark):
    docs, labels = frames(spark)
    found = got(filter_audit.audit(docs, labels, {"X": lambda text, _: F.length(text) > 100}, "Y"))
    assert {k[1] for k in found} == {"XY", "YX"} and {k[2] for k in found} == {1, 2}
    for part in {k[0] for k in found}:
        n = sum((s or "") == part for _, _, s in DOCS)
        x, y = found[part, "XY", 1], found[part, "XY", 2]
        assert x[0] + x[1] == n and y[0] + y[1] == x[0] and x[6] == x[1] + found[part, "YX", 2][1]
    for wrong in ({"AB": lambda t, w: t == ""}, {"E": lambda t, w: t == ""}, {c: lambda t, w: t == "" for c in "ABCDFGHI"}):
        with pytest.raises(ValueError, match="letter"):
            filter_audit.audit(docs, labels, wrong)


def test_audit_runs_no_python(spark):
    docs, labels = frames(spark)
    plan = filter_audit.audit(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
