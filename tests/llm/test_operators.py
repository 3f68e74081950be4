"""The corpus operators against brute force on small fixtures, and their defined cases."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from meridia.llm import bpe, chat, exact_dedup, language, mixture, pii, quality, simhash, topk, url_filter
from meridia.operators.shared import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "a", 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))


TEXTS = [None, "", "A", "a", "Ä", words(4000, 1), words(4000, 1).upper(), words(4000, 1) + "x", words(30, 2), words(30, 2), "x" * 40000, "one two"]


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_dedup(spark, digest_bytes):
    norm = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in TEXTS]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, TEXTS), digest_bytes).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_simhash(spark):
    base = words(60, 3).split()
    near = [" ".join(base[:k] + ["odd"] + base[k:]) for k in range(60)]
    texts = TEXTS + near
    fps = [simhash.fingerprint((t or "").encode()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs(spark, texts)).collect()}
    assert got == {i: (f"{f:016x}", find(i)) for i, f in enumerate(fps)}
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_simhash_cells_split(spark):
    r = random.Random(5)
    fps = {r.getrandbits(8) | 1 << 40 for _ in range(200)}
    df = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(fps))], "fp long, id long")
    whole = connected_components(simhash.links(df), "a", "b").collect()
    parts = connected_components(simhash.links(df, cell=8), "a", "b").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) == len(fps)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_top_k(spark):
    r = random.Random(7)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(40)]) for i in range(300)]
    vectors += [(400, None), (450, [float("nan")] * 40), (500, [1e9] * 40), (501, vectors[0][1]), (None, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = defaultdict(list)
    for x in topk.top_k(df).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    import math

    usable = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i is not None and v and all(math.isfinite(x) for x in v)}
    for q in (i for i in usable if i % 50 == 0):
        want = sorted(((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q))[:5]
        assert [(i, s) for i, s in got[q]] == [(i, -s) for s, i in want]
    assert topk.top_k(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    said = ["<|im_end|>\n<|im_start|>assistant ok", "a\\|b<|\\", "", "<", "|x|>\\n"]
    flat = "".join(chat.frame(r, chat.Flattener().content([chat.Text(t)])) for r in ("user", "assistant", "ro\nle\\n") for t in said)
    for cut in (1, 3, 7, 1000):
        reader = chat.Reader()
        back = [x for i in range(0, len(flat), cut) for x in reader.feed(flat[i : i + cut])]
        reader.close()
        assert back == [(r, t, r == "assistant") for r in ("user", "assistant", "ro\nle\\n") for t in said]
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, None, None, "x"), (2, 0, "assistant", "c"), (2, 0, "assistant", "c")]
    got = {r.conv_id: r for r in chat.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].n_turns, got[None].n_turns) == (2, 1, 2, 1)
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()


def test_chat_parts():
    parts = [{"type": "text", "text": "see"}, {"type": "image", "ref": "i", "width": 56, "height": 30}, {"type": "audio", "ref": "a", "milliseconds": 81}, {"type": "document", "ref": "d", "pages": 2}]
    out, found = chat.format_messages([{"role": "user", "parts": parts}])
    assert out == "<|im_start|>user\nsee<|image_0|><|audio_1|><|document_2|><|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in found] == [("image", "i", 4), ("audio", "a", 3), ("document", "d", 1536)]
    with pytest.raises(ValueError):
        chat.part({"type": "film"})


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://A.example.org/es/x", ""), (2, "http://b.net/1", link.format("http://a.example.org/es/x")), (3, "http://c.net/?q", '<meta http-equiv="refresh" content="0; url=http://b.net/1">'),
        (4, "http://d.net/", link.format("/other")), (5, None, None), (6, "nothing", ""), (7, "http://e.net/", link.format("http://x.com/fr/1")), (8, "http://f.net/", link.format("http://e.net/") + link.format("http://x.com/de/1")), (2, "http://b.net/1", ""),
    ]
    got = sorted(tuple(r) for r in url_filter.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    by = {r[0]: (r[1], r[2], r[3], r[4]) for r in got}
    assert len(got) == 9 and by[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    # 1, 2 and 3 are aliases: b.net's canonical URL is blocked, though it differs from page 1's in case only of the host
    assert by[2][3] == by[3][3] == "block"
    assert by[5] == ("", "", None, "allow") and by[6] == ("", "", None, "allow")
    assert by[7][3] == by[8][3] == "allow" and by[4][3] == "allow"


def test_mixture(spark):
    r = random.Random(9)
    texts = [" ".join(["w"] * r.randint(0, 60)) for _ in range(400)] + [None]
    sources = [r.choice(["a", "b", "c", "d", None]) for _ in texts]
    df = docs(spark, texts, sources)
    rows = mixture.mix(df).collect()
    assert len(rows) == len(texts) and sorted(map(tuple, rows)) == sorted(map(tuple, mixture.mix(df).collect()))
    total = sum(x.size for x in rows)
    goal, taken = {}, defaultdict(int)
    for x in rows:
        goal[x.source] = x.target
        taken[x.source] += x.taken
        assert x.taken in (0, x.size, 2 * x.size)
    assert abs(sum(goal.values()) - 1.5 * total) < 1e-6
    assert all(0 <= goal[s] - taken[s] < 2 for s in goal)
    assert mixture.mix(docs(spark, [])).count() == 0
    out = mixture.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(x.copies for x in rows if x.taken)


def test_fit_budget():
    r = random.Random(11)
    for _ in range(200):
        n = r.randint(1, 5)
        lengths, counts = r.sample(range(1, 30), n), [r.randint(0, 3) for _ in range(n)]
        budget = r.randint(0, 120)
        sums = {0}
        for a, c in zip(lengths, counts, strict=True):
            sums = {s + k * a for s in sums for k in range(c + 1)}
        take = mixture.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        assert sum(a * t for a, t in zip(lengths, take, strict=True)) == max(s for s in sums if s <= budget)


def test_pii_base():
    r = random.Random(13)
    alphabet = "a1.@+-% 4()255,Z_é"
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, card, phone = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    for _ in range(3000):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        want = [("email", *m.span()) for m in pattern.finditer(s)]
        want += [("ip", *m.span()) for m in ip.finditer(s) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(s) if 13 <= len(d := digits(m[0])) <= 19 and sum(n if k % 2 == 0 else 2 * n - 9 * (n > 4) for k, n in enumerate(d[::-1])) % 10 == 0]
        want += [("phone", *m.span()) for m in phone.finditer(s) if 9 <= len(digits(m[0])) <= 15]
        assert pii.base_spans(s) == want


def test_pii_query(spark):
    texts = [None, "", "mail me: joe@x.example.com", "call +1 (555) 555-0100 or phone 555-123-4567", "a" * 50000 + "@"] + ["phone 555-123-%04d" % i for i in range(30)]
    got = {r.doc_id: r for r in pii.span_digests(docs(spark, texts)).collect()}
    assert got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].spans == "email:9:26" and got[3].n_phone == 1 and got[3].spans.startswith("phone:5:22")
    assert pii.span_digests(docs(spark, [])).count() == 0


def test_pii_method(spark):
    """Planted spans of every kind are added, stand-ins and look-alikes are not; other columns may clash."""
    r = random.Random(31)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    value = lambda n: "".join(r.choice("abcdef0123456789") for _ in range(n))

    def card():
        body = "4" + number(14)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    made = {
        "card": card, "secret": lambda: f'token = "{value(40)}"', "hidden": lambda: f"api_key: {value(24)}", "spelt": lambda: f"mail joe.{value(4)} [at] example [dot] com", "long": lambda: f"+1 (2{number(2)}) 555-{number(4)} {number(16)}",
        "decoy": lambda: next(x for _ in range(99) if not pii.luhn(x := "7" + number(15))), "stand": lambda: "password=your_password_here", "mail": lambda: f"{value(5)}@mail.example.com", "prose": lambda: "meet bob at home. then go on: dot by dot at last",
    }
    texts, kinds = [], []
    for k in range(270):
        kind = list(made)[k % 9]
        texts.append(f"{words(6, k)} {made[kind]()} {words(5, k + 1)}")
        kinds.append(kind)
    df = docs(spark, texts).withColumn("spans", F.lit(1)).withColumn("votes", F.lit("x")).withColumn("base", F.lit(2))
    hit, total = defaultdict(int), defaultdict(int)
    for x in pii.span_digests(df).collect():
        found = {"secret": x.n_secret, "hidden": x.n_secret, "spelt": x.n_other, "long": x.n_other, "card": x.n_card, "mail": x.n_email}.get(kinds[x.doc_id], int(x.personal) or x.n_secret + x.n_other)
        total[kinds[x.doc_id]] += 1
        hit[kinds[x.doc_id]] += found > 0
        assert kinds[x.doc_id] in ("decoy", "stand", "prose") or x.personal
    assert all(hit[k] == total[k] for k in ("card", "secret", "hidden", "spelt", "long", "mail")), hit
    assert not any(hit[k] for k in ("decoy", "stand", "prose")), hit


def test_pii_reliability():
    # of three labelers on hidden truths, the one that is wrong half the time comes out as least reliable
    r = random.Random(37)
    counts = defaultdict(float)
    for _ in range(2000):
        truth = r.random() < 0.5
        counts[tuple(int(truth if r.random() < right else not truth) for right in (0.95, 0.9, 0.55, 0.92))] += 1
    import numpy as np

    votes = np.array(list(counts))
    p, right = pii.estimate(votes, np.array(list(counts.values())))
    assert [round(float(x), 1) for x in right] == [0.9, 0.9, 0.6, 0.9] or right.argmin() == 2
    assert p[[tuple(v) == (1, 1, 1, 1) for v in votes]].min() > 0.95 and p[[tuple(v) == (0, 0, 0, 0) for v in votes]].max() < 0.05


def test_quality(spark):
    good, bad = [words(80, i) for i in range(60)], ["%%% ".join(words(80, i).upper().split()) for i in range(60)]
    texts = [x for pair in zip(good, bad, strict=True) for x in pair] + [None, ""]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(120)] + [(5, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_documents(df, labels).collect()}
    assert all(got[i].predicted == 1 - i % 2 for i in range(120)) and 0 <= got[120].score <= 1 and got[120].score == got[121].score
    assert quality.keep_good(df, labels).columns == df.columns
    assert {r.score for r in quality.score_documents(df, labels.limit(0)).collect()} == {0.5}


def test_bpe():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, most_pieces=50)
    codec.machine.most = 200
    r = random.Random(17)
    texts = ["", words(500, 1), "".join(r.choice("aeiounstr") for _ in range(20000)), " " * 5000, "it's 12½　\x1c\x85 中文\U0001f600"]
    texts += ["".join(r.choice("ab cdeé中 \n\t'st9-") for _ in range(40)) for _ in range(500)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == want.encode_ordinary(t)
        assert "".join(codec.decode_stream([[i] for i in ids])) == t


def test_bpe_query(spark):
    out = bpe.encode_documents(docs(spark, [None, "a b", "中" * 3000]), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert [r.n_tokens > 0 for r in sorted(out)] == [False, True, True]
    assert sorted(out)[2].decoded_sha256 == hashlib.sha256(("中" * 3000).encode()).hexdigest()


def test_bpe_parts():
    texts = ["a" * 10, None, "b" * (bpe.PART + 1), "", "c", "é" * bpe.PART, "d"]
    batch = pa.record_batch([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    for b in (batch, batch.slice(1), batch.slice(2, 3)):
        got = list(bpe.parts([b, b.slice(0, 0)]))
        assert [i for x in got for i in x.column("doc_id").to_pylist()] == b.column("doc_id").to_pylist()
        assert all(x.num_rows == 1 or sum(len((t or "").encode()) for t in x.column("text").to_pylist()) <= bpe.PART for x in got)


def test_language(spark):
    en, fr = "the house and the garden of the king " * 20, "la maison et le jardin du roi avec une " * 20
    train = spark.createDataFrame([(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(20)], "doc_id long, text string, lang string")
    pages = [(1, "http://a.example/x", f'<html lang="en"><p>{en}</p></html>'), (2, "http://b.example/", f"<p>{fr}</p><script>{en}</script>"), (3, None, None), (4, "http://b.example/2", "<html lang='fr'></html>")]
    got = {r.page_id: r.lang for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), train).collect()}
    assert got[1] == "en" and got[2] == "fr" and got[4] == "fr" and len(got) == 4
    assert language.identify(spark.createDataFrame([], "page_id long, url string, html string"), train.limit(0)).count() == 0


def test_stages_with_repeated_ids(spark):
    # each group once, whatever ids its rows have: repeated, null, or one that another group's kept row has
    texts = ["A b", "a B", "a b", words(200, 21), words(200, 21), words(200, 22), words(200, 22), words(200, 23), words(200, 23)]
    ids = [3, 3, 5, 5, 4, None, None, 4, 4]
    df = spark.createDataFrame([(i, t, "en", "a", k, "clash") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)
    for digest_bytes in (16, 1):
        out = exact_dedup.drop_exact_copies(df, digest_bytes)
        assert out.columns == df.columns
        assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(5, "a b"), (5, texts[3]), (0, texts[5]), (4, texts[7])])
    near = simhash.drop_near_copies(df)
    assert near.columns == df.columns
    assert sorted((r.doc_id or 0, r.text.lower()) for r in near.collect()) == sorted([(3, "a b"), (4, texts[3]), (0, texts[5]), (4, texts[7])])


def test_mixture_with_repeated_ids(spark):
    r = random.Random(23)
    texts = [" ".join(["w"] * r.randint(1, 60)) for _ in range(300)]
    rows = [(r.choice([None, 1, 2, k]), t, "en", r.choice("abc"), k, "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixture.mixed_documents(df)
    times = defaultdict(int)
    for x in out.collect():
        times[x.n_chars] += 1
    assert out.columns == df.columns and max(times.values()) <= mixture.CAP
    assert sum(len(texts[k].split()) * n for k, n in times.items()) == sum(x.taken for x in mixture.mix(df).collect())


def test_pipeline_keeps_tokens(spark):
    import corpus_pipeline

    out = corpus_pipeline.STAGES[-1][1](spark, docs(spark, ["a b", None, "中文 c"]), None)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f), special_tokens={})
    for r, t in zip(sorted(out.collect()), ["a b", "", "中文 c"], strict=True):
        ids = [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]
        assert ids == want.encode_ordinary(t) and len(ids) == r.n_tokens


def test_top_k_repeated_query(spark):
    import math

    r = random.Random(29)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(20)]) for i in range(1, 120)]
    first = [r.uniform(-1, 1) for _ in range(20)]
    vectors += [(0, first), (0, [x + 0.01 for x in first]), (0, [-x for x in first]), (7, vectors[6][1])]
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors]
    best = sorted((-max(sum(a * b for a, b in zip(q, v, strict=True)) for k, q in usable if k == 0), i) for i, v in usable if i != 0)[:5]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(df).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]


def test_url_resolve(spark):
    base = "http://h.net/a/b/c.html?x=1#top"
    want = [
        (base, "page.html", "http://h.net/a/b/page.html"), (base, "./x", "http://h.net/a/b/x"), (base, "../x?y=2", "http://h.net/a/x?y=2"), (base, "../../../x", "http://h.net/x"),
        (base, "?id=2", "http://h.net/a/b/c.html?id=2"), (base, "#end", "http://h.net/a/b/c.html?x=1#end"), (base, "..", "http://h.net/a/"), (base, ".", "http://h.net/a/b/"),
        (base, "/go?u=http://x/", "http://h.net/go?u=http://x/"), (base, "/p/./q/../r/", "http://h.net/p/r/"), (base, "go?u=http://x/", "http://h.net/a/b/go?u=http://x/"),
        (base, "//o.org/x/../y", "http://o.org/y"), (base, "//o.org", "http://o.org"), (base, "https://o.org/a/../b", "https://o.org/a/../b"), (base, "mailto:a@b", None),
        ("http://h.net", "x", "http://h.net/x"), ("http://h.net?q=/z/", "x", "http://h.net/x"), ("http://h.net/a/", "x/y", "http://h.net/a/x/y"), ("nothing", "x", None),
    ]
    df = spark.createDataFrame([(k, a, to) for k, (a, to, _) in enumerate(want)], "k int, base string, target string")
    got = df.select("k", url_filter.resolve(F.col("base"), F.col("target")).alias("url")).orderBy("k").collect()
    assert [r.url for r in got] == [b for _, _, b in want]


def test_url_filter_relative(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    pages = [
        (1, "http://e.org/es/a/one", ""), (2, "http://e.org/en/b", link.format("../es/a/one")), (3, "http://e.org/es2/x/p", refresh.format("two")),
        (4, "http://e.org/es2/x/two", link.format("?id=2")), (5, "http://e.org/es2/x/two?id=2", link.format("http://e.org/es/a/one")), (6, "http://n.net/", link.format("/go?u=http://e.org/es/a/one")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_pages(df, (("block", "e.org/es/"),)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_url_filter_aliases(spark):
    """Chains over mixed case, fragments, relative forms and a base element, by brute force and by the SQL."""
    import duckdb

    from meridia.llm import queries

    link, refresh = '<link rel="canonical" href="{}">', '<meta content="0; URL={}" http-equiv="Refresh">'
    pages = [
        (1, "HTTP://A.example.ORG/es/x", ""), (2, "http://b.net/1", link.format("http://a.EXAMPLE.org/es/x#top")), (3, "http://B.net/1#part", ""), (4, "http://c.net/", refresh.format("HTTP://b.NET/1#z")),
        (5, "http://d.net/q/r", "<link rel='alternate canonical' href='../s?id=1'>"), (6, "http://D.net/s?id=1#u", link.format("http://c.net/#")), (7, "http://e.net/", '<link rel="canonical" data-href="http://c.net/" >'),
        (8, "http://f.net/", "<!-- " + link.format("http://c.net/") + " -->"), (9, "http://g.net/", '<base href="http://x.com/fr/"><link href=one rel=canonical>'), (10, "http://x.com/fr/one", ""),
        (11, "http://h.net/", link.format("http://g.net/") + link.format("http://x.com/de/1")), (12, None, link.format("http://c.net/")), (13, "none", link.format("/a")), (14, "http://i.net/", None), (3, "http://B.net/1#part", ""),
    ]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, rule string, node int")
    got = sorted(map(tuple, url_filter.judge_pages(df).collect()), key=str)
    want = {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "allow", 13: "allow", 14: "allow"}
    assert {r[0]: r[4] for r in got} == want and len(got) == len(pages)
    db = duckdb.connect()
    db.register("pages", df.select("page_id", "url", "html").toPandas())
    assert got == sorted(db.sql(queries.oracle_sql()["op6_url_filter"]).fetchall(), key=str)
    assert url_filter.judge_pages(df.limit(0)).count() == 0


def test_url_filter_random(spark):
    # random graphs of links against a plain search
    r = random.Random(41)
    hosts = ["a.example.org", "b.net", "c.com", "d.com", "e.io"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['es', 'en', 'de', 'fr', 'x'])}/{k}" for k in range(120)]
    links = [(r.choice(urls), r.choice(urls)) for _ in range(70)]
    html = defaultdict(str)
    for a, b in links:
        html[a] += f'<link rel="canonical" href="{b if r.random() < 0.5 else b.upper().replace("/ES/", "/es/").replace("/EN/", "/en/").replace("/DE/", "/de/").replace("/FR/", "/fr/").replace("/X/", "/x/")}">'

    def rule(u):
        host, path = u[7:].split("/", 1)
        fit = [(len(x), v) for v, x in url_filter.RULES if (host == x.split("/", 1)[0] or host.endswith("." + x.split("/", 1)[0])) and path.startswith(x.split("/", 1)[1])]
        return max(fit)[1] if fit else None

    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for k, u in enumerate(urls):
        seen, todo = {u}, [u]
        while todo:
            for v in near[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        found = {rule(v) for v in seen}
        want[k] = rule(u) or ("allow" if "allow" in found else "block" if "block" in found else "allow")
    df = spark.createDataFrame([(k, u, html[u]) for k, u in enumerate(urls)], "page_id long, url string, html string")
    assert {x.page_id: x.verdict for x in url_filter.judge_pages(df).collect()} == want


def test_top_k_prunes():
    """Small blocks enter the branch that drops candidates: same results as brute force, ties
    included, and fewer candidates alive in later dimension blocks; with and without seeds."""
    import numpy as np

    r = np.random.default_rng(43)
    # a few heavy dimensions, as in learned embeddings, and small whole numbers for ties
    m = np.floor(r.normal(size=(3000, 64)) * np.geomspace(40, 0.5, 64))
    m[1000:1100] = m[:100]
    ids = np.arange(3000)
    queries, own = m[::100], ids[::100]
    scores = queries @ m.T
    want = [sorted((-int(s), int(i)) for s, i in zip(row, ids, strict=True) if i != q)[:5] for q, row in zip(own, scores, strict=True)]
    seeds = topk.Seeds.of([{"vec_id": int(i), "q": m[i].tolist()} for i in range(0, 3000, 10)])
    order = seeds.order(64)
    alive = []
    for floors, by in ((None, np.arange(64)), (seeds.floors(own, queries, 5), order)):
        best = topk.Best(own, queries[:, by], 5, floors)
        for a in range(0, 3000, 250):
            best.scan(ids[a : a + 250], ids[a : a + 250], m[a : a + 250][:, by])
        assert [[(s, i) for s, i, _ in f] for f in best.found] == want
        alive.append(best.scored)
    assert alive[1][0] == 3000 * len(own) and alive[1][1] < 0.6 * alive[1][0] and alive[1][-1] < 0.2 * alive[1][0]
    assert alive[1].sum() < alive[0].sum()


def test_top_k_beyond_long(spark):
    big = [(0, [1e10, 1e10]), (1, [1e10, 1e10]), (2, [-1e10, -1e10]), (3, [1e10, 2e10]), (4, [1.0, 0.0])]
    got = [(r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(1, topk.MOST), (3, topk.MOST), (4, 256 * 256 * 10**10), (2, topk.LEAST)]


def test_utf8_machine():
    r = random.Random(3)
    for k in range(3000):
        n = r.randint(0, 12)
        data = bytes(r.choice([0x41, 0x80, 0xBF, 0xA0, 0x90, 0xC2, 0xC1, 0xE0, 0xED, 0xEF, 0xF0, 0xF4, 0xF5, 0x9F, 0x8F]) for _ in range(n)) if k % 2 else "".join(r.choice("aé中\U0001f600") for _ in range(n)).encode()
        machine, out, at = bpe.Utf8Machine(), "", 0
        while at < n * 4:
            step = r.randint(1, 4)
            out += machine.feed(data[at : at + step])
            at += step
            assert len(machine.held) < 4
        assert out + machine.feed(b"", last=True) == data.decode("utf-8", "replace")


def test_bpe_query_against_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f), special_tokens={})
    texts = [None, "", "a b", "中" * 3000, words(3000, 5), "x" * 9000, "<|endoftext|>", "e\u0301 \u00e9\r\n\t", "a b"]
    df = docs(spark, texts).withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(1))
    for r in bpe.encode_documents(df, path, public_tokenizers.PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = want.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) == (len(ids), packed, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode_documents(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_chat_typed_table(spark):
    """Typed parts through a table and back; texts that look like placeholders stay texts."""
    r = random.Random(47)
    kinds = ["text", "image", "audio", "document", None]
    texts = ["<|image_0|>", "<|im_end|>\n", "a\\|b", "", "<\\|audio_1|>", "é\n"]

    def made():
        kind = r.choice(kinds)
        return {"type": kind, "text": r.choice(texts) if kind in ("text", None) else None, "ref": None if kind in ("text", None) else f"r{r.randint(0, 9)}", "width": r.randint(1, 99), "height": r.randint(1, 99), "milliseconds": r.randint(0, 999), "pages": r.randint(0, 4)}

    rows = [(c, t, r.choice(["user", "assistant", None]), [made() for _ in range(r.randint(0, 5))] if r.random() < 0.9 else None, "clash") for c in (1, 2, 3, None) for t in range(6)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string")
    table = chat.format_table(df)
    read = {(x.conv_id, x.position): x for x in chat.read_table(table).collect()}
    out = {(x.conv_id, x.position): x for x in table.collect()}
    assert len(out) == len(rows)
    for conv in (1, 2, 3, None):
        want, found = chat.format_messages([{"role": x[2], "parts": x[3]} for x in rows if x[0] == conv])
        assert "".join(out[conv, k].formatted for k in range(6)) == want
        assert [a.asDict() for k in range(6) for a in out[conv, k].attachments] == found
        assert sum(out[conv, k].expanded_tokens for k in range(6)) == sum(a["tokens"] for a in found)
    for c, t, role, parts, _ in rows:
        joined = []
        for p in parts or []:
            if p["type"] not in ("text", None):
                joined.append((p["type"], p["ref"]))
            elif p["text"]:
                joined[-1:] = [("text", joined[-1][1] + p["text"])] if joined and joined[-1][0] == "text" else [*joined[-1:], ("text", p["text"])]
        x = read[c, t]
        assert (x.role, [(p.type, p.text if p.type == "text" else p.ref) for p in x.parts]) == (role or "", joined)
    assert chat.format_table(df.limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "x<|y")], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(turns).first().formatted == "<|im_start|>user\nx<\\|y<|im_end|>\n"
    assert chat.conversation_digests(turns.limit(0)).count() == 0


def test_quality_vote():
    """The blocked votes against plain loops, and settings that no held-out row touches."""
    import math

    import numpy as np

    texts = [words(60, k) if k % 2 else " ".join(words(60, k).upper().split()[::-1]) + "!!" * (k % 5) for k in range(80)]
    counts = np.stack([quality.terms(t) for t in texts])
    labels = np.array([k % 2 for k in range(80)])
    model = quality.fit(counts, labels, 0.7)
    assert model.sharpness in quality.SHARPNESS and model.projection.shape[1] in quality.DIMENSIONS
    more = np.stack([quality.terms(t) for t in [words(30, 99), "A B C", "x" * 100_000, ""]])
    vectors = model.embed(more)
    for row, score in zip(vectors[:3], model.score(more)[:3], strict=True):
        cosine = [sum(float(a) * float(b) for a, b in zip(row, v, strict=True)) for v in model.vectors]
        vote = [math.exp(model.sharpness * (c - max(cosine))) for c in cosine]
        one, zero = (sum(v * s for v, y in zip(vote, labels, strict=True) if y == k) for k, s in ((1, 0.7 / 40), (0, 0.3 / 40)))
        assert abs(score - one / (one + zero)) < 1e-3
    assert abs(model.score(more)[3] - 0.7) < 1e-6


def test_quality_never_learns_from_held_out_rows(spark):
    import zlib

    texts = [words(80, i) if i % 2 else "%%% ".join(words(80, i).upper().split()) for i in range(100)] + [None]
    df = docs(spark, texts).withColumn("quality", F.lit(0)).withColumn("terms", F.lit("clash"))
    out = {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0}
    scores = []
    for flip in (False, True):
        rows = [(i, (1 - i % 2 if flip else i % 2) if i in out else i % 2, 0) for i in range(100)]
        got = quality.score_documents(df, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
        assert {r.doc_id for r in got if r.held_out} == {i for i in range(101) if zlib.crc32(str(i).encode()) % 5 == 0}
        scores.append({r.doc_id: r.score for r in got})
    assert scores[0] == scores[1] and all((scores[0][i] >= 0.3) == (i % 2 == 1) for i in out)
    assert quality.score_documents(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def _majority(text, n, bits):
    """A fingerprint and shingles by plain loops, apart from the operator's code."""
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[ \\t\\n\\x0b\\x0c\\r]+", low) if x]
    shingles = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(bits) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)), set(shingles)


def test_simhash_fingerprint():
    for k, t in enumerate([*TEXTS, *(words(n, n) for n in range(1, 30)), "É a\x0bB\x85c d"]):
        assert simhash.fingerprint((t or "").encode()) == _majority(t, 3, 64)[0], k


def test_simhash_pivots_discard():
    """The pivot tables lose no near pair and leave few others, counted before and after."""
    import numpy as np

    r = np.random.default_rng(53)
    fps = r.integers(0, 2**63, 600, dtype=np.uint64)
    near = fps[:40] ^ (np.uint64(1) << r.integers(0, 60, 40).astype(np.uint64))
    rows = np.concatenate([fps, near])[:, None]
    tally = simhash.Tally()
    got = {(int(i), int(j)) for a, b, _ in simhash.near_pairs(rows, tally=tally) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i, j in combinations(range(640), 2) if int(rows[i, 0] ^ rows[j, 0]).bit_count() <= 3}
    assert got == want and tally.pairs == 640 * 639 // 2 and tally.near == len(want) >= 40
    assert tally.left < tally.pairs / 1000 + 2 * tally.near
    # pivots from the members: crowds around two texts fall apart
    wide = r.integers(0, 2**63, (2, 8), dtype=np.uint64)
    crowd = np.concatenate([wide[k] ^ (np.uint64(1) << r.integers(0, 60, (200, 8)).astype(np.uint64)) for k in (0, 1)])
    tally = simhash.Tally()
    assert sum(len(x[0]) for x in simhash.near_pairs(crowd, simhash.expected_bits(), pivots=simhash.members(crowd), tally=tally)) == 2 * (200 * 199 // 2)
    assert tally.left == tally.near and tally.pairs > 2 * tally.left - 400


def _edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_against_brute_force(spark):
    """Pairs of similarity 0.8 or more, five words, by sets: at least nine in ten lose one;
    rows that are like no other stay. Crowded cells are split without losing any."""
    r = random.Random(59)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = text(60)
    bases = [text(r.choice([60, 150, 400])) for _ in range(60)]
    texts = [*bases, *(_edited(b, r.choice([1, 2, 4]), k) for k, b in enumerate(bases)), *(passage + " " + text(80) for _ in range(60)), "", "one two", "One  two"]
    sets = [_majority(t, 5, 1)[1] for t in texts]
    like = lambda i, j: len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and like(i, j) >= 0.8]
    best = {i: max(like(i, j) for j in range(len(texts)) if j != i) for i in range(len(texts))}
    df = docs(spark, texts).withColumn("_row", F.lit(1)).withColumn("id", F.lit("clash"))
    for cell in (2048, 16):
        out = simhash.drop_near_copies(df, cell)
        kept = {x.doc_id for x in out.collect()}
        assert out.columns == df.columns
        caught = sum(not (i in kept and j in kept) for i, j in pairs)
        assert len(pairs) > 30 and caught >= 0.9 * len(pairs)
        assert all(i in kept for i in best if best[i] < 0.8)
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


def test_language_fusion(spark):
    """The posterior by plain loops on pages whose evidence conflicts, and accuracy apart from
    the rows that were learned from."""
    import math

    import numpy as np

    texts = {"en": "the house and the garden of the king with", "fr": "la maison et le jardin du roi avec une", "de": "das haus und der garten des koenigs mit einer"}
    r = random.Random(61)
    made = lambda lang, n: " ".join(r.choice(texts[lang].split()) for _ in range(n))
    train = spark.createDataFrame([(k, made(lang, 60), lang) for k, lang in enumerate(list(texts) * 12)], "doc_id long, text string, lang string")
    hosts = {"en": "a.example.uk", "fr": "b.example.fr", "de": "c.other.de"}
    pages, truth = [], {}
    for k in range(90):
        lang = list(texts)[k % 3]
        truth[k] = lang
        said = lang if r.random() < 0.8 else r.choice(list(texts))
        pages.append((k, f"http://{hosts[lang if r.random() < 0.9 else 'en']}/{k}", f'<html lang="{said}"><p>{made(lang, r.choice([0, 1, 3, 30]))}</p>'))
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    got = {x.page_id: x for x in language.identify(df, train).collect()}
    names, logs = language.fit_text(train)
    rows = {x.page_id: x for x in language.evidence(df, names, logs).collect()}
    host = {k: u.split("/")[2] for k, u, _ in pages}
    domain, suffix = ({k: ".".join(h.split(".")[-n:]) for k, h in host.items()} for n in (2, 1))
    p = {k: np.array(x.p) for k, x in rows.items()}
    total = sum(p.values())
    base = (total + 1) / (total.sum() + 3)

    def given(value):
        n = len(set(value.values()))
        return {k: np.log((sum(p[j] for j in p if value[j] == v) + 1) / (total + n)) for k, v in value.items()}

    log_declared, log_suffix = given({k: x.declared for k, x in rows.items()}), given(suffix)
    for k in p:
        in_domain = np.maximum(sum(p[j] for j in p if domain[j] == domain[k]) - p[k], 0)
        d = (in_domain + language.KAPPA_DOMAIN * base) / (in_domain.sum() + language.KAPPA_DOMAIN)
        in_host = np.maximum(sum(p[j] for j in p if host[j] == host[k]) - p[k], 0)
        h = (in_host + language.KAPPA_HOST * d) / (in_host.sum() + language.KAPPA_HOST)
        log = np.array(rows[k].loglik) + np.log(h) + log_declared[k] + log_suffix[k]
        assert got[k].lang == names[int(log.argmax())] and math.isclose(got[k].probability, 1 / np.exp(log - log.max()).sum(), rel_tol=1e-9)
    assert sum(got[k].lang == truth[k] for k in truth) >= 0.9 * len(truth)
    assert sum(got[k].lang != rows[k].declared for k in truth) > 5


def test_mixture_targets(spark):
    """Targets against a plain loop: weights by code point, null last, capped and reshared."""
    r = random.Random(67)
    for _ in range(3):
        size = {s: r.choice([5, 50, 500, 5000]) for s in ["b", "a", "é", "Z", None]}
        rows = [(s, n) for s, n in size.items()]
        order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        goal, free, want = 1.5 * sum(size.values()), set(order), {}
        while free:
            share = (goal - sum(want.values())) / sum(weight[s] for s in free)
            over = {s for s in free if weight[s] * share > 2 * size[s]}
            want |= {s: 2.0 * size[s] for s in over} if over else {s: weight[s] * share for s in free}
            free -= over or free
        got = {x.source: x.target for x in mixture.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixture_beyond_the_programme(spark):
    # a budget far above the words left to the programme, one very long text, equal lengths
    lengths, counts = [1, 7, 50, 900], [5000, 3000, 400, 40]
    for budget in (50_000, 77_777, 3_999):
        take = mixture.fit_budget(lengths, counts, budget)
        assert all(0 <= a <= b for a, b in zip(take, counts, strict=True)) and sum(a * b for a, b in zip(take, lengths, strict=True)) == budget
    texts = ["w " * 30_000, *("w w w" for _ in range(50)), *("w" for _ in range(20))]
    df = docs(spark, texts, ["a"] * 41 + ["b"] * 30).withColumn("_copies", F.lit(3)).withColumn("size", F.lit("clash"))
    out = mixture.mixed_documents(df)
    assert out.columns == df.columns and out.count() == mixture.mix(df).agg(F.sum("copies")).first()[0]


def test_exact_dedup_clashing_names(spark):
    df = docs(spark, ["a", "A", "b"]).withColumn("_row", F.lit(1)).withColumn("recipe", F.lit("x")).withColumn("_doc", F.lit(2))
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == [1, 2]


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages over a small corpus with copies, repeated and null ids: each text group once
    before the mix, caps and tokens after it."""
    import corpus_pipeline

    r = random.Random(71)
    good = [words(80, 300 + k) + f" tail{k}" for k in range(40)]
    bad = ["%%% ".join(words(60, 400 + k).upper().split()) for k in range(40)]
    rows = [(k, t, "en", "ab"[k % 2], len(t)) for k, t in enumerate([*good, *bad])]
    rows += [(7, good[3].upper(), "en", "a", 0), (7, good[3], "en", "b", 0), (None, good[5], "en", "a", 0), (None, good[6], "en", "a", 0), (200, good[8] + " x", "en", "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(stages.items()):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        at = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = at.collect()
    texts = {name: [x.text for x in rows] for name, rows in seen.items() if "text" in rows[0].asDict()}
    assert {t.lower() for t in texts["quality classifier"]} == {g.lower() for g in good} | {good[8] + " x"}
    assert sorted(t.lower() for t in texts["exact dedup"]) == sorted({t.lower() for t in texts["quality classifier"]})
    assert len(texts["simhash near-dedup"]) == 40 and set(texts["simhash near-dedup"]) <= set(texts["exact dedup"])
    times = defaultdict(int)
    for x in seen["mixture"]:
        times[x.text] += 1
    assert max(times.values()) <= 2 and set(times) <= set(texts["simhash near-dedup"])
    total = sum(len(t.split()) for t in texts["simhash near-dedup"])
    assert 1.5 * total - 4 <= sum(len(t.split()) * n for t, n in times.items()) <= 1.5 * total
    assert len(seen["byte-level bpe"]) == len(seen["mixture"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["byte-level bpe"])


def test_top_k_huge_components(spark):
    """Finite components up to the largest double, against whole numbers of any size."""
    import math
    from fractions import Fraction

    r = random.Random(83)
    rows = [(0, [1e200, 1.0, 2.0]), (1, [-1e200, 3.0, 1.0]), (2, [1.0, 1e200, 0.0]), (50, [7e305, 0.0, 1.0]), (100, [0.0, 0.0, 5e-324]), (150, [1.0, 2.0, 3.0])]
    rows += [(200 + k, [r.choice([-1, 1]) * 10.0 ** r.randint(-3, 300) if r.random() < 0.3 else r.uniform(-5, 5) for _ in range(3)]) for k in range(120)]
    whole = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        score = lambda i, q=q: min(topk.MOST, max(topk.LEAST, sum(a * b for a, b in zip(whole[q], whole[i], strict=True))))
        best = sorted((-score(i), i) for i in whole if i != q)[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {tuple(x) for x in got} == want
    ends = spark.createDataFrame([(0, [1.7976931348623157e308, 1.0]), (1, [-1.7976931348623157e308, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.top_k(ends).collect()] == [(0, 1, 1, topk.LEAST)]


def test_top_k_where_a_square_overflows():
    import numpy as np

    q, x = np.zeros((1, 32)), np.zeros((3, 32))
    q[0, 0], q[0, 20], x[:, 0] = 1, 1e200, (5, 9, 7)
    best = topk.Best(np.array([50]), q, 1)
    for k in range(3):
        best.scan(np.array([k]), np.array([k]), x[k : k + 1])
    assert best.found == [[(-9, 1, 1)]]


def test_top_k_in_groups(spark, monkeypatch):
    import numpy as np

    for name, value in (("CANDIDATE_BLOCK", 16), ("HELD", 2), ("WAVE", 3), ("QUERY_BLOCK", 3), ("SEED_ROWS", 7)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(85)
    m = r.integers(-3, 4, (500, 20)) / 256
    rows = [(int(i), v.tolist()) for i, v in enumerate(m)] + [(50, m[3].tolist()), (600, [0.5, 0.25]), (650, [0.5, 0.25])]
    by = defaultdict(lambda: defaultdict(lambda: None))
    for q, a in rows:
        for n, (i, b) in enumerate(rows):
            if q % 50 == 0 and i != q and len(a) == len(b):
                s = round(sum(x * y for x, y in zip(a, b, strict=True)) * 65536)
                by[q][n] = s if by[q][n] is None else max(s, by[q][n])
    want = {(q, k, rows[n][0], s) for q, found in by.items() for k, (n, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], rows[x[0]][0]))[:5], 1)}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_mixture_of_one_id_and_size(spark, monkeypatch):
    """Many rows without an id, all of one length: any number of them is taken exactly, by
    digits of their own hashes, and no rank sees more than a bucket."""
    monkeypatch.setattr(mixture, "BUCKET", 16)
    rows = [(None, "w w w", "en", "a", k, "clash") for k in range(10_000)] + [(7, "w w", "en", "b", k, "clash") for k in range(3000)] + [(k, "w " * 9, "en", "c", k, "clash") for k in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixture.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert len(got) == 3 and all(0 <= x.target - x.taken < 9 and x.most <= 2 for x in got)
    out = mixture.mixed_documents(df)
    assert out.count() == mixture.mix(df).agg(F.sum("copies")).first()[0]
    sized = spark.range(5000).select(F.lit("a").alias("source"), F.lit(3).cast("long").alias("size"), *mixture.hashes(F.lit(None), F.col("id"), 42))
    for extra in (1, 2, 37, 2500, 4999):
        cut = spark.createDataFrame([("a", 3, 5000, extra)], "source string, size long, n long, extra long")
        (end,) = mixture._ends(sized, cut).collect()
        assert sized.where((F.col("h") < end.h) | ((F.col("h") == end.h) & (F.col("r") <= end.r))).count() == extra


def test_interleaved_chains(spark, tmp_path):
    """Stages of two chains, none written before the next is called: both can still be read."""
    import corpus_pipeline

    a, b = ([words(60, 700 + k + n) for n in range(9)] for k in (0, 100))
    for name, texts in (("a", a), ("b", b)):
        docs(spark, [*texts, *texts[:4]]).write.parquet(str(tmp_path / name))
    stages = dict(corpus_pipeline.STAGES)
    at = {name: spark.read.parquet(str(tmp_path / name)) for name in "ab"}
    out = [(name, stages[stage](spark, at[name], None)) for stage in ("exact dedup", "simhash near-dedup", "mixture") for name in "ab"]
    for name, df in out:
        assert {x.text for x in df.collect()} <= set(a if name == "a" else b)
    assert [df.count() for _, df in out[:4]] == [9] * 4


def test_keys_of_file_rows(spark, tmp_path):
    from meridia.llm.common import DOC, ROW, with_row_key

    rows = docs(spark, TEXTS * 3).withColumn("_metadata_", F.lit(1))
    rows.repartition(3).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    for df in (read, read.where("doc_id > 5"), read.unionByName(read), rows, rows.withColumn("_metadata", F.lit(2))):
        keyed = with_row_key(df)
        first = {r[ROW]: r[DOC] for r in keyed.collect()}
        assert len(first) == df.count() and first == {r[ROW]: r[DOC] for r in keyed.select(ROW, DOC).collect()}
        assert keyed.select(f"{DOC}.*").columns == df.columns
