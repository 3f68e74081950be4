"""Personal data by weak-supervision aggregation.

Base spans come from four patterns with their checks and always stay. Besides, wider
candidate patterns find what may be personal data or a secret in another form (an address
with the at sign written out, a phone number without a country code or run into other
digits, a card number that fails its check digit, an identity number, a value assigned to
the name of a secret). Labelers vote on every candidate and base span: regex labelers on
its form, gazetteer labelers on known words in it, context labelers on the words before
it. Spans are counted over all documents by kind, votes and binned features (length,
share of digits, variety of characters), a bounded table. Expectation-maximisation over
these counts estimates each labeler's reliability by kind and each span's probability; a
logistic classifier over kinds, votes and features is trained with these probabilities,
and it alone decides which candidates are added and which base spans count as personal.

Text is scanned once and whole; spans go by code points, end exclusive.

Defined cases: a null text is empty; a document without spans has empty lists and the
digest of the empty string; repeated rows, and rows of one or of no doc_id, each get their
own spans; spans of one start go by kind; no documents: no rows; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails at the start of a run of digits fails at each later digit of it
# too, so runs are entered at their start only: same matches, linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: A span is added, or counts as personal, from this probability on.
CERTAIN = 0.8


def emails(text: str) -> list[tuple[int, int]]:
    """What [A-Za-z0-9._%+-]+@DOMAIN finds, going out from each @ in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not re.search("[0-9]", text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# Candidates: forms that the base patterns leave out.
_NAME = r"[A-Za-z0-9-]++"
_SPELT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?{_NAME}(?:(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?|\.){_NAME})+", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?<!\+\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_LONG_PHONE = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])")
_NUMBER = re.compile(r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?i)(?<![a-z0-9])([a-z0-9]*[_-]?(?:token|secret|password|passwd|pwd|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key))\x20?(?:=|:|:=|=>)\x20?([\"'])?([^\s\"'<>|;,]{8,})")

#: Words that tell a span's kind when they stand before it (fixed values).
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "tarjeta", "carte", "karte", "kreditkarte"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"),
    "number": ("ssn", "social", "passport", "identity", "id", "national"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "credential", "login", "auth"),
}
#: Words that tell that a number before them is none of these (fixed values).
ELSEWISE = ("isbn", "issn", "doi", "order", "invoice", "part", "version", "page", "figure", "table", "serial", "example", "sample")
#: Words and numbers known to belong to a kind, and values known to be stand-ins (fixed values).
MAIL_ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info")
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
STAND_INS = ("xxxx", "changeme", "your", "example", "placeholder", "****", "none", "null", "true", "false")
LABELERS = ("form", "shape", "known", "cue", "other", "edge")
#: Characters before a span that the context labelers read.
BEFORE = 40


def _shape_and_known(kind: str, s: str, digits: str) -> tuple[int, int]:
    """The votes on a span's shape and on known words in it."""
    if kind == "email":
        ending = re.split(r"[.\x20)\]]", s.lower())[-1]
        return int(bool(re.search(r"[.@]|dot", s, re.I))), int(ending in MAIL_ENDINGS)
    if kind == "ip":
        return int(len(s) >= 7), -1 if 1 <= int(s.split(".")[0]) <= 239 else 0
    if kind == "card":
        return int(len(digits) in (14, 15, 16)), int(digits.startswith(CARD_STARTS))
    if kind == "phone":
        return int(len(digits) in (10, 11, 12, 13)), int(digits.startswith(COUNTRY_CODES)) if s.startswith("+") else -1
    if kind == "number":
        return int(not digits.startswith(("000", "666", "9"))), -1
    low = s.lower()
    mixed = bool(digits) and any(c.isalpha() for c in s) or len(s) >= 20
    drawn = bool(digits) and len(s) >= 16 and bool(re.fullmatch(r"[A-Za-z0-9+/_=.-]+", s))
    return int(mixed and len(set(s)) >= 6), 0 if any(x in low for x in STAND_INS) else 1 if drawn else -1


def _votes(kind: str, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The labelers' votes: 1 personal, 0 not, -1 abstains."""
    s, before = text[start:end], text[max(0, start - BEFORE) : start].lower()
    words = re.findall(r"[^\W\d_][\w-]*", before)[-4:]
    form = 1 if base else 0 if kind == "card" else -1
    shape, known = _shape_and_known(kind, s, _digits(s))
    stems = {x for w in words for x in (w, w.rstrip("s"), *re.split("[_-]", w))}
    cue = not stems.isdisjoint(CONTEXT[kind])
    other = any(not stems.isdisjoint(cues) for k, cues in CONTEXT.items() if k != kind) or not stems.isdisjoint(ELSEWISE)
    edge = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return form, shape, known, 1 if cue else -1, 0 if other and not cue else -1, int(edge)


def _bins(s: str) -> tuple[int, ...]:
    """A span's features beyond votes, three bins each: length, share of digits, variety."""
    digits, kinds = sum(c.isdigit() for c in s) / len(s), len(set(s)) / len(s)
    return (len(s) > 12) + (len(s) > 24), (digits > 0.3) + (digits > 0.7), (kinds > 0.4) + (kinds > 0.7)


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that may be personal data or secrets and touch no base span."""
    found = []
    low = text.lower()
    if "at]" in low or "at)" in low or " at " in low and " dot " in low:
        found += [("email", *m.span()) for m in _SPELT.finditer(text)]
    if any(x in low for x in ("token", "secret", "passw", "pwd", "credential", "key")):
        found += [("secret", *m.span(3)) for m in _SECRET.finditer(text)]
    if re.search("[0-9]", text):
        found += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        found += [("number", *m.span()) for m in _NUMBER.finditer(text)]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and len(_digits(m[0])) in (15, 16)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _LONG_PHONE.finditer(text)]
    taken, out = sorted((a, b) for _, a, b in base), []
    for k, a, b in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        at = bisect_left(taken, (a, b))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            out.append((k, a, b))
            taken.insert(at, (a, b))
    return out


ALL_KINDS = (*KINDS, "number", "secret")
ORDER = {k: i for i, k in enumerate(ALL_KINDS)}
SPAN = "struct<kind:string,start:long,stop:long,base:boolean,votes:string>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans: base spans and candidates with the labelers' votes and the bins."""

    def run(batches):
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("votes", pa.string())])
        for b in batches:
            out = []
            for x in b.column("text"):
                text = x.as_py() or ""
                base = base_spans(text)
                both = [(*s, True) for s in base] + [(*s, False) for s in candidates(text, base)]
                out.append([{"kind": k, "start": s, "stop": e, "base": own, "votes": ",".join(map(str, (*_votes(k, text, s, e, own), *_bins(text[s:e]))))} for k, s, e, own in both])
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.list_(kind))], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: the probability that each vote pattern is personal data,
    and each labeler's reliability (its chance to vote rightly where it votes)."""
    voted = votes >= 0
    up = np.where(voted, votes, 0)
    p = np.clip((up.sum(axis=1) + 0.5) / (voted.sum(axis=1) + 1), 0.05, 0.95)
    for _ in range(rounds):
        w1, w0 = (counts * p)[:, None], (counts * (1 - p))[:, None]
        # a prior of two right votes and one wrong holds labelers that hardly vote
        hit = ((w1 * (voted & (votes == 1))).sum(axis=0) + 2) / ((w1 * voted).sum(axis=0) + 3)
        miss = ((w0 * (voted & (votes == 1))).sum(axis=0) + 1) / ((w0 * voted).sum(axis=0) + 3)
        share = np.clip((counts @ p + 1) / (counts.sum() + 2), 0.02, 0.98)
        log = np.log(share / (1 - share)) + (voted * (up * np.log(hit / miss) + (1 - up) * np.log((1 - hit) / (1 - miss)))).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    right = ((counts * p)[:, None] * (voted & (votes == 1)) + (counts * (1 - p))[:, None] * (voted & (votes == 0))).sum(axis=0)
    return p, right / np.maximum(1e-9, (counts[:, None] * voted).sum(axis=0))


def _features(kinds: list[str], votes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """One column for each vote either way, each bin of a feature, and each kind."""
    own = np.array([ORDER[k] for k in kinds])[:, None] == np.arange(len(ALL_KINDS))
    binned = (bins[:, :, None] == np.arange(3)).reshape(len(bins), -1)
    return np.concatenate([votes == 1, votes == 0, binned, own, np.ones((len(votes), 1))], axis=1).astype(float)


def fit_classifier(x: np.ndarray, p: np.ndarray, counts: np.ndarray, rounds: int = 30, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression with soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    weight = counts / counts.sum() * min(counts.sum(), 10_000)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - q)) - ridge * w
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


@dataclass
class Judgement:
    """What the counts say: each pattern's probability by the classifier, and the
    labelers' reliabilities by kind."""

    patterns: list[tuple[str, str]]
    probability: np.ndarray
    reliability: dict[str, dict[str, float]]

    def personal(self) -> list[str]:
        return [f"{k}:{v}" for (k, v), q in zip(self.patterns, self.probability, strict=True) if q >= CERTAIN]


def judge(patterns: list[tuple[str, str]], counts: np.ndarray) -> Judgement:
    """Estimates by kind, then one classifier for all kinds."""
    if not patterns:
        return Judgement([], np.zeros(0), {})
    kinds = [k for k, _ in patterns]
    numbers = np.array([[int(x) for x in v.split(",")] for _, v in patterns])
    votes, bins = numbers[:, : len(LABELERS)], numbers[:, len(LABELERS) :]
    p, reliability = np.zeros(len(patterns)), {}
    for kind in sorted(set(kinds)):
        at = [i for i, k in enumerate(kinds) if k == kind]
        p[at], right = estimate(votes[at], counts[at])
        reliability[kind] = dict(zip(LABELERS, right.round(4).tolist(), strict=True))
    x = _features(kinds, votes, bins)
    q = 1 / (1 + np.exp(-np.clip(x @ fit_classifier(x, p, counts), -30, 30)))
    return Judgement(patterns, q, reliability)


def count_patterns(found: DataFrame) -> tuple[list[tuple[str, str]], np.ndarray]:
    """(kind, votes and bins) over all documents, and how many spans have them: at most 6
    kinds times 3^9 patterns."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
    return [(r["kind"], r["votes"]) for r in rows], np.array([float(r["n"]) for r in rows])


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, stop, base, personal), sorted by kind as listed, then
    start: base spans, and the candidates that the classifier adds."""
    found = materialise(scan(docs))
    keys = judge(*count_patterns(found)).personal()
    fits = lambda s: F.concat(s["kind"], F.lit(":"), s["votes"]).isin(keys) if keys else F.lit(False)
    place = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])

    def row(s):
        return F.struct(place[s["kind"]].alias("place"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["base"].alias("base"), fits(s).alias("personal"))

    spans = F.transform(F.filter("spans", lambda s: s["base"] | fits(s)), row)
    return found.select("doc_id", F.array_sort(spans).alias("spans"))


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans; then n_secret and n_other of the
    added spans, and personal: whether the classifier holds any span for personal."""
    row = lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])
    base = F.filter("spans", lambda s: s["base"])

    def count(test):
        return F.size(F.filter("spans", test)).cast("long")

    def is_base(kind: str):
        return lambda s: s["base"] & (s["kind"] == kind)

    n = {f"n_{k}": count(is_base(k)) for k in KINDS}
    more = {"n_secret": count(lambda s: s["kind"] == "secret"), "n_other": count(lambda s: ~s["base"] & (s["kind"] != "secret")), "personal": F.exists("spans", lambda s: s["personal"])}
    lists = {"b": F.array_join(F.transform(base, row), ","), "listed": F.array_join(F.transform("spans", row), ",")}
    out = personal_spans(docs).select("doc_id", *[v.alias(k) for k, v in {**n, **more, **lists}.items()])
    return out.select("doc_id", *n, F.sha2("b", 256).alias("base_sha256"), F.col("listed").alias("spans"), *more)
