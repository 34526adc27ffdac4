"""The filter audit against a count document by document."""

import random
import re
from itertools import permutations

from scanloom.llm import filter_audit as fa

DOC = "doc_id long, text string, source string, row int, failed int, part string, key int, n int"
LABELS = "doc_id long, quality int, toxic int, part string"


def plain(docs, labels):
    texts = [(d, t or "", s or "") for d, t, s, *_ in docs]
    failed = []
    for d, t, _ in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copies = [e for e, u, _ in texts if u == t and e is not None]
        failed.append({
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and min(copies) < d,
        })
    mark = lambda d, k: d is not None and any(x[0] == d and x[k] == 1 for x in labels)
    out, shapley = {}, {}
    for part in {s for *_, s in texts}:
        rows = [i for i, x in enumerate(texts) if x[2] == part]
        for order in permutations("ABCDE"):
            for step, name in enumerate(order):
                before = [i for i in rows if not any(failed[i][x] for x in order[:step])]
                hit = [i for i in before if failed[i][name]]
                shapley[part, name] = shapley.get((part, name), 0) + len(hit)
                out[part, "".join(order), step + 1] = [
                    len(before) - len(hit), len(hit), sum(failed[i][name] for i in rows) - len(hit), sum(failed[i][name] and sum(failed[i].values()) == 1 for i in rows),
                    sum(mark(texts[i][0], 1) for i in hit), sum(mark(texts[i][0], 2) for i in hit),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_counts_equal_a_walk_over_all_documents_in_all_orders(spark):
    rng = random.Random(3)
    pieces = ["a", "Bc", "D", "é", "x y z", "word word", "#", "|", " ", "\n", "\x0b", " "]
    texts = [None, "", " ", "A", "Word " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(40000)), "x" * 200000]
    texts += [" ".join(rng.choice([f"w{rng.randint(0, 300)}", *pieces]) for _ in range(rng.choice([5, 50, 52, 120]))) for _ in range(60)]
    docs = [(i, t, rng.choice(["s", "t", None, ""]), 1, 2, "p", 3, 4) for i, t in enumerate(texts)]
    docs += [(1000 + i, rng.choice(texts), rng.choice(["s", "t"]), 1, 2, "p", 3, 4) for i in range(40)]
    docs += [(None, texts[5], "s", 1, 2, "p", 3, 4), (7, texts[7], "s", 1, 2, "p", 3, 4), (1005, "Only twice", "t", 1, 2, "p", 3, 4), (1005, "Only twice", "t", 1, 2, "p", 3, 4)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in list(range(0, 60)) + [1003, 1005]] + [(3, 1, 1, "x"), (3, 0, 0, "x"), (None, 1, 1, "x")]
    out = fa.filter_audit(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABELS))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()}
    assert got == plain(docs, labels)
    assert all(sum(v[1] for (p, o, _), v in got.items() if (p, o) == ("s", order)) == sum(v[1] for (p, o, _), v in got.items() if (p, o) == ("s", "ABCDE")) for order in ("EDCBA", "CABED"))


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOC), spark.createDataFrame([], LABELS)
    assert fa.filter_audit(none, labels).count() == 0
    one = fa.filter_audit(spark.createDataFrame([(1, "a", "s", 1, 2, "p", 3, 4)], DOC), labels).collect()
    assert len(one) == 600 and {r.kept for r in one if r.filter_order == "BCDEA" and r.step < 5} == {1} and {r.good_lost for r in one} == {0}


def test_audit_of_other_filters(spark):
    members = spark.createDataFrame([(i, "all", i % 3 == 0, False) for i in range(12)], "row long, part string, good boolean, toxic boolean")
    failing = {"X": spark.range(0, 6).toDF("row"), "Y": spark.range(4, 9).toDF("row")}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in fa.audit(members, failing).collect()}
    assert got == {("XY", 1): (6, 6, 0, 4, 2, 10), ("XY", 2): (3, 3, 2, 3, 1, 8), ("YX", 1): (7, 5, 0, 3, 1, 8), ("YX", 2): (3, 4, 2, 4, 2, 10)}
