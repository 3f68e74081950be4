"""The filter audit against running every order, and its defined cases."""

import random
import re
from itertools import permutations

from meridia.llm import filter_audit

DOCS = "doc_id long, text string, source string, mask string, part string"
LABELS = "doc_id long, quality int, toxic int, n string"


def removed_by_orders(rows, labels):
    """What each order removes step by step, and the removals of a filter over all orders."""
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x, _ in labels if x == 1 and i is not None}
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    judged = []
    for i, t, source, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        judged.append((source or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shares = {}, {}
    for part in {x[0] for x in judged}:
        own = [x for x in judged if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
                redundant = sum(f in x[1] for x in own) - len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(out) == len(got)
    return out


def test_audit_against_every_order(spark):
    r = random.Random(4)
    long = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", "short", "A" * 9 + " " + long, long, long + " #", "x " * 300, "X " * 300, "short | Text", long + "\x0b\x85end ", "word " * 4000, "😀" * 200 + " AB"]
    rows = [(i, r.choice(texts), r.choice(["a", "b", None, ""]), "clash", "clash") for i in range(80)]
    rows += [(3, "short", "a", "", ""), (3, "short", "a", "", ""), (None, "short", "b", "", ""), (None, None, None, "", ""), (-5, long, "z", "", "")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None]), "x") for i in range(0, 80, 2)] + [(2, 1, 0, "x"), (2, 0, 1, "x"), (None, 1, 1, "x"), (999, 1, 1, "x")]
    assert audited(spark, rows, labels) == removed_by_orders(rows, labels)


def test_audit_of_one_text_many_times(spark):
    rows = [(i, "same text", f"s{i % 2}", "", "") for i in range(500)]
    got = audited(spark, rows, [])
    assert got == removed_by_orders(rows, [])
    assert got["s0", "EABCD", 1][1] == 249 and got["s1", "EABCD", 1][1] == 250


def test_audit_empty(spark):
    assert audited(spark, [], []) == {}


def test_potential_is_the_games_recursion(spark):
    counts = [("p", m, 1 + m * m % 11, 0, 0) for m in range(32)]
    row = filter_audit.removal_games(spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long")).first()
    v = [sum(c[2] for c in counts if c[1] & s) for s in range(32)]
    p = [0.0] * 32
    for s in range(1, 32):
        p[s] = (v[s] + sum(p[s ^ 1 << k] for k in range(5) if s >> k & 1)) / s.bit_count()
    assert list(row.n) == v and row.total == sum(c[2] for c in counts)
    assert all(abs(a - 120 * b) < 1e-6 for a, b in zip(row.potential, p, strict=True))
    # the shares of the five filters add up to all that is removed
    assert sum(row.potential[31] - row.potential[31 ^ 1 << k] for k in range(5)) == 120 * v[31]
