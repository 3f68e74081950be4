"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

A text becomes counts of terms: pairs of neighbouring byte classes (letters by case,
vowel or not, digits, kinds of punctuation, space, line ends), byte pairs, and shape terms of
three families (what repeats, how lines run, how long words are). Log counts times
inverse document frequency, projected on the leading singular vectors of the labelled
rows, give its latent vector. The labelled vectors are broadcast: at most MAX_LABELLED of
them, a documented bound; for every document the cosines with all of them are computed
exactly, in blocks, and labels vote with weight exp(sharpness * cosine), each class
weighted by its share of all training labels. Sharpness, the number of dimensions and which
families of shape terms are used are those of the lists below under which the training
rows foretell one another best: each is left out of its own vote, and the mean log loss counts.

Only rows whose crc32(doc_id as text) mod 5 is not 0 are ever learned from, settings
included; the sample of them is the MAX_LABELLED / 2 of each label that come first in
seeded hash order. Byte pairs are hashed to N_BYTES terms.

Defined cases: a null text is empty; a text of less than two bytes, and any text when there
are no labels at all, scores the training share of label 1 (0.5 without labels); labels null or other
than 0 and 1, or without a document, are ignored; of several labels of one document the
larger counts; repeated rows each get the same score; equal cosines vote alike; texts of
any length are read whole; no documents: no rows; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LABELLED, THRESHOLD, SEED = 2400, 0.3, 9
#: The settings that the training rows choose from.
DIMENSIONS, SHARPNESS = (16, 32, 64), (10.0, 20.0, 40.0, 60.0, 80.0)
#: Weight of a shape term, and documents scored at a time.
SHAPE, BLOCK = 4.0, 256


def _classes() -> np.ndarray:
    """A class from 0 to 31 for each byte."""
    out = np.full(256, 31, np.uint8)
    out[0xC0:] = 30  # leads a character of several bytes
    for number, group in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" ", b"\t\v\f", b"\r\n", b".", b",", b";:", b"!", b"?", b"'\"`", b"-", b"_", b"()", b"[]{}", b"<>", b"/\\", b"|", b"@", b"#", b"$", b"%", b"&", b"*", b"+=~^")):
        out[list(group)] = number
    return out


CLASSES = _classes()
N_PAIRS, N_BYTES = 32 * 32, 2048
#: Families of shape terms; a term is there twice, as its measure and as what that lacks of one.
FAMILIES = {"repetition": 3, "lines": 2, "words": 2}
N_SHAPES = 2 * sum(FAMILIES.values())
N_TERMS = N_PAIRS + N_BYTES + N_SHAPES


def terms(text: str) -> np.ndarray:
    """Counts of a text's terms, the whole text."""
    data = text.encode()
    out = np.zeros(N_TERMS, np.float32)
    if not data:
        return out
    raw = np.frombuffer(data, np.uint8)
    kind = CLASSES[raw].astype(np.int64)
    out[:N_PAIRS] = np.bincount(kind[:-1] * 32 + kind[1:], minlength=N_PAIRS)
    wide = raw.astype(np.int64)
    out[N_PAIRS : N_PAIRS + N_BYTES] = np.bincount((wide[:-1] * 257 + wide[1:] * 31) % N_BYTES, minlength=N_BYTES)
    lines, words = [x for x in data.split(b"\n") if x.strip()], data.split()
    n = len(words)
    shapes = (
        sum(map(eq, words, words[1:])) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(words)) / max(1, n),
        n / max(1, len(lines)) / 100, max(map(len, lines), default=0) / 1000,
        sum(map(len, words)) / max(1, n) / 10, max(map(len, words), default=0) / 100,
    )
    at = N_PAIRS + N_BYTES
    for k, x in enumerate(shapes):  # as counts in proportion to the text, so that the log treats them like terms
        out[at + 2 * k], out[at + 2 * k + 1] = SHAPE * x * len(data), SHAPE * max(0.0, 1 - x) * len(data)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithms of the terms' rates a thousand, times their inverse document frequency."""
    x = counts / np.maximum(1, counts[:, :N_PAIRS].sum(axis=1, keepdims=True))
    x *= 1000
    np.log1p(x, out=x)
    x *= idf
    return x


@dataclass
class Model:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    weights: np.ndarray  # by vector and class
    prior: float
    sharpness: float = SHARPNESS[0]

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.idf) @ self.projection)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        full = counts[:, :N_PAIRS].sum(axis=1) > 0
        cosine = self.embed(counts) @ self.vectors.T
        near = np.exp(self.sharpness * (cosine - cosine.max(axis=1, keepdims=True)))
        votes = near @ self.weights
        share = votes[:, 1] / np.maximum(1e-12, votes.sum(axis=1))
        return np.where(full, share, self.prior).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)


def own_loss(vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray, sharpness: float) -> float:
    """Mean log loss of the rows' votes on one another, each left out of its own; a class
    counts by its weights."""
    loss = 0.0
    for a in range(0, len(vectors), BLOCK):
        cosine = vectors[a : a + BLOCK] @ vectors.T
        rows = np.arange(len(cosine))
        cosine[rows, a + rows] = -np.inf
        votes = np.exp(sharpness * (cosine - cosine.max(axis=1, keepdims=True))) @ weights
        share = votes[rows, labels[a : a + BLOCK].astype(int)] / np.maximum(1e-12, votes.sum(axis=1))
        own = weights[a : a + BLOCK].sum(axis=1)
        loss -= float((own * np.log(np.clip(share, 1e-3, 1))).sum())
    return loss / max(1e-12, float(weights.sum()))


def fit(counts: np.ndarray, labels: np.ndarray, prior: float) -> Model:
    """From the sample's term counts; prior is the share of label 1 in all training rows. The
    families are chosen at the middle settings, the settings with the families chosen."""
    if not len(counts):
        return Model(np.ones(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros((0, 2), np.float32), prior)
    ones = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    weights = np.stack([(labels == 0) * (1 - prior) / ones[1], (labels == 1) * prior / ones[0]], axis=1).astype(np.float32)
    full = (np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))) + 1).astype(np.float32)
    x = weighted(counts, full)
    ends = np.cumsum([0, N_PAIRS + N_BYTES, *(2 * n for n in FAMILIES.values())])
    # inner products of the rows, by family: those of any choice are a sum of these
    inner = [x[:, p:q] @ x[:, p:q].T for p, q in zip(ends, ends[1:], strict=False)]
    best, found = np.inf, None
    for chosen in sorted(product((False, True), repeat=len(FAMILIES)), key=sum):  # a tie takes fewer
        gram = sum((k for k, on in zip(inner, (True, *chosen), strict=True) if on), np.zeros_like(inner[0]))
        values, rows = leading(gram, max(DIMENSIONS) + 1)
        # the first direction is what all texts share
        latent = (rows * np.sqrt(values))[:, 1:]
        loss = own_loss(unit(latent[:, : DIMENSIONS[1]]), labels, weights, SHARPNESS[2])
        if loss < best - 1e-6:
            best, found = loss, (chosen, values, rows, latent)
    chosen, values, rows, latent = found
    used = np.repeat([True, *chosen], np.diff(ends))
    del inner, gram
    best = np.inf
    for n in DIMENSIONS:
        for sharpness in SHARPNESS:
            loss = own_loss(unit(latent[:, :n]), labels, weights, sharpness)
            if loss < best - 1e-6:
                best, found = loss, (n, sharpness)
    n, sharpness = found
    idf = np.where(used, full, 0).astype(np.float32)
    # singular vectors of the terms from those of the rows
    projection = np.ascontiguousarray((x * used).T @ (rows / np.sqrt(values))[:, 1 : n + 1]).astype(np.float32)
    return Model(idf, projection, unit(latent[:, :n]), weights, prior, sharpness)


def leading(gram: np.ndarray, n: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The n largest eigenvalues of a matrix of inner products and their vectors, as columns,
    by subspace iteration."""
    n = min(n, len(gram))
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(gram), min(len(gram), 2 * n))).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(gram @ q)[0]
    values, vectors = np.linalg.eigh((q.T @ (gram @ q)).astype(np.float64))
    top = np.argsort(-values)[:n]
    return np.maximum(values[top], 1e-9).astype(np.float32), (q @ vectors[:, top]).astype(np.float32)


def held_out(c: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out())
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    have = dict(own.groupBy("quality").count().collect())  # two rows at most
    prior = have.get(1, 0) / max(1, sum(have.values())) if have else 0.5
    picked = [own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(max_labelled // 2).collect() for q in (0, 1)]
    rows = [r for part in picked for r in part]  # at most max_labelled
    if not rows:
        return fit(np.zeros((0, N_TERMS), np.float32), np.zeros(0), prior)
    chosen = F.broadcast(spark.createDataFrame(rows, "doc_id long, quality int"))

    def run(batches):
        for b in batches:
            m = np.stack([terms(x.as_py() or "") for x in b.column("text")]) if b.num_rows else np.zeros((0, N_TERMS), np.float32)
            yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.array([x.tobytes() for x in m], pa.binary())], names=["doc_id", "quality", "terms"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    # a doc_id that many rows share adds one row to the sample
    got = sample.mapInArrow(run, "doc_id long, quality int, terms binary").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("terms").alias("terms"))
    counts, told = np.zeros((len(rows), N_TERMS), np.float32), np.full(len(rows), -1)
    place = {i: k for k, i in enumerate(sorted(r["doc_id"] for r in rows))}
    for r in got.toLocalIterator():
        counts[place[r["doc_id"]]], told[place[r["doc_id"]]] = np.frombuffer(r["terms"], np.float32), r["quality"]
    if (told < 0).any():  # labels of documents that are not there
        counts, told = counts[told >= 0], told[told >= 0]
    return fit(counts, told, prior)


def scorer(docs: DataFrame, model: Model):
    """A column function: a text column's scores."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        m = sent.value
        out = [np.zeros(0)]
        for a in range(0, len(texts), BLOCK):
            out.append(m.score(np.stack([terms(x.as_py() or "") for x in texts[a : a + BLOCK]])))
        return pa.array(np.concatenate(out))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = scorer(docs, train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", held_out().alias("held_out"), score("text").alias("score")).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier predicts to be of quality 1; columns as they are."""
    score = scorer(docs, train(docs, labels))
    return docs.where(score(F.col("text").cast("string")) >= THRESHOLD)
