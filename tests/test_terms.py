"""The term table's matcher: automaton, shards and join agree with plain search."""

import random
import re

import pytest

from meridia.operators import terms


def normal(x):
    return " ".join(re.findall("[a-z0-9]+", (x or "").lower()))


@pytest.mark.parametrize("shard_bytes,most", [(1 << 20, 8), (40, 100), (10, 1)])
def test_terms_as_by_plain_search(spark, shard_bytes, most):
    r = random.Random(5)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 3)))
    texts = [(k, " ".join(word() for _ in range(r.randint(0, 30)))) for k in range(60)] + [(100, None), (101, "A-b,  ÀB"), (101, "A-b,  ÀB")]
    named = [(k, " ".join(word() for _ in range(r.randint(1, 3)))) for k in range(40)] + [(90, "--"), (91, "AB"), (92, "ab"), (93, None)]
    got = terms.match_terms(spark.createDataFrame(texts, "id long, x string"), ["id"], "x", spark.createDataFrame(named, "term_id long, term string"), "term", shard_bytes, most)
    assert got.columns == ["id", "term_id", "term", "hits", "first"]
    want = []
    for i, x in texts:
        body = f" {normal((x or '').replace('À', 'a'))} "
        for k, w in named:
            n = normal(w)
            places = [m.start() + 1 for m in re.finditer(f"(?= {n} )", body)] if n else []
            if places:
                want.append((i, k, w, len(places), places[0]))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_no_terms(spark):
    texts = spark.createDataFrame([(1, "a b")], "id long, x string")
    for most in (8, -1):
        assert terms.match_terms(texts, ["id"], "x", spark.createDataFrame([], "term string"), "term", most_shards=most).count() == 0
