import re
from itertools import permutations

import pytest
from helpers import DOCS, clashing, empty, odd_rows, prose
from pyspark.sql import functions as F
from textgauge.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """One set of letters a document, from the plain conditions."""
    out = []
    for i, text, *_ in rows:
        t = text or ""
        words = re.findall("[^\\x20\\x09-\\x0D]+", t)
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            bad.add("C")
        if re.search("[#$%&*|]", t):
            bad.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows):
            bad.add("E")
        out.append(bad)
    return out


def plain(rows, labels):
    bad = fails(rows)
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    parts, out = {(r[2] or "") for r in rows}, []
    for part in parts:
        mine = [(r[0], b) for r, b in zip(rows, bad, strict=True) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[1]]
                before = set(order[: step - 1])
                lines.append([part, "".join(order), step, f, len(alive) - len(gone), len(gone), sum(f in b and bool(b & before) for _, b in mine), sum(b == {f} for _, b in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
                shapley[f] += len(gone)
                alive = [d for d in alive if f not in d[1]]
        out += [(*x, shapley[x[3]]) for x in lines]
    return sorted(out)


def rows():
    extra = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([
        (prose(300, 3), "en"), ("WORD " * 250, "en"), (prose(300, 3), "de"), ("a # " + prose(250, 4), ""), ("", "fr"), (prose(300, 3), None), ("x y\x0bz\x1fq " * 90, "fr"), ("ÄÖ " * 220, "de"),
        ("ok  \n " * 199, "en"), (prose(300, 3), "en"),
    ], 20)]
    return odd_rows() + extra + [extra[0], (None, prose(300, 3), "en", "s", 0)]


def test_equals_a_plain_walk_through_all_orders(spark):
    labels = [(20, 1, 0), (20, 0, 1), (22, 1, None), (29, 1, 1), (4, 1, 1), (None, 1, 1), (21, None, None), (24, 0, 1), (999, 1, 1)]
    made = audit.audit_orders(clashing(spark.createDataFrame(rows(), DOCS).repartition(3)), clashing(spark.createDataFrame(labels, LABELS)))
    assert made.columns == ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, made.collect())) == plain(rows(), labels)


def test_edges_of_the_lattice(spark):
    masks = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 2, 1)], "part string, mask int, n long, good long, toxic long")
    edges = audit.lattice_edges(masks, 5).collect()
    assert len(edges) == 80 and len(audit.order_steps(list("ABCDE"))) == 600
    assert all(e.kept + e.removed <= 7 for e in edges) and {(e.bit, e.shapley) for e in edges} == {(1, 120), (2, 120), (4, 0), (8, 0), (16, 0)}


def test_empty_tables_and_other_filters(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit.audit_orders(empty(spark), none).count() == 0
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", "en")], "doc_id long, text string, lang string")
    found = audit.audit_orders(docs, none, {"X": F.coalesce(F.col("text") == "a", F.lit(False)), "Y": F.lit(True)}, copies=None).orderBy("filter_order", "step").collect()
    told = [(r.filter_order, r.step, r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found]
    assert told == [("XY", 1, "X", 1, 1, 0, 0, 1), ("XY", 2, "Y", 0, 1, 1, 1, 3), ("YX", 1, "Y", 0, 2, 0, 1, 3), ("YX", 2, "X", 0, 0, 1, 0, 1)]
    with pytest.raises(ValueError):
        audit.audit_orders(docs, none, dict.fromkeys("ABCDEFG", F.lit(False)))
