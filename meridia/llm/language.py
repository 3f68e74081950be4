"""Language identification by Bayesian evidence fusion.

Four kinds of evidence on a page meet in one posterior over the languages:

* text: a naive Bayes likelihood of the visible text's letter trigrams, tempered by its
  length, from models fitted on at most PER_LANGUAGE labelled documents a language;
* markup: the language that the page declares, through P(declared | language);
* address: the host's last label, through P(suffix | language);
* host: the host's own mix of languages, smoothed towards its registered domain's, and
  that towards all pages'.

The tables behind the last three are sums of the text posteriors, grouped by declared
language, suffix, domain and host over all pages: partial aggregates, and joins that may
split a crowded host. A page's own share is taken out of its host's and domain's sums.

Defined cases: null html or url is empty; a page without visible text keeps the other
evidence; no labelled documents: one language, ``und``; repeated rows count each; a tie
goes to the language that comes first by code point; html of any length is read whole; no
pages: no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import materialise, skew_join
from meridia.llm.url_filter import host_of

PER_LANGUAGE, BUCKETS, EFFECTIVE, SEED = 300, 1 << 15, 60.0, 5
KAPPA_HOST, KAPPA_DOMAIN, ALPHA = 8.0, 16.0, 0.5

_OPEN = re.compile(r"<(script|style)\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_ENTITY = re.compile(r"&#?\w{1,10};")
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def visible_text(html: str) -> str:
    """Markup gone, scripts, styles and comments with their content; what never closes stays.
    One pass: an end that was looked for in vain is not looked for again."""
    out, last, at, lost = [], 0, html.find("<"), set()
    end_of_tags = html.rfind(">")
    while 0 <= at < end_of_tags:
        end = -1
        opened = _OPEN.match(html, at)
        name = opened[1].lower() if opened else "comment" if html.startswith("<!--", at) else None
        if name and name not in lost:
            if name == "comment":
                end = html.find("-->", at + 4)
                end = end + 3 if end >= 0 else -1
            else:
                closed = _CLOSE[name].search(html, opened.end())
                end = closed.end() if closed else -1
            if end < 0:
                lost.add(name)
        if end < 0:
            end = html.find(">", at) + 1
        out += [html[last:at], " "]
        last, at = end, html.find("<", end)
    return _ENTITY.sub(" ", "".join([*out, html[last:]]))


def declared_language(html: str) -> str:
    """The lang of the first html tag that states one. A tag that opens within another's
    angle brackets holds nothing that the outer one does not."""
    at = 0
    while opened := _HTML.search(html, at):
        end = html.find(">", opened.end())
        at = len(html) if end < 0 else end
        told = _LANG.search(html, opened.end(), at)
        if told:
            return told[1].lower()
    return ""


def grams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased text's letters, white space run to one blank."""
    s = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(s) < 3:
        return np.zeros(0, np.int64)
    h = (s[:-2] * np.uint64(0x9E3779B1) + s[1:-1] * np.uint64(0x85EBCA77) + s[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return ((h >> np.uint64(7)) % np.uint64(BUCKETS)).astype(np.int64)


def fit_text(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram | language), from the documents that come first in
    seeded hash order, per_language of each; languages are few, and counted whole."""
    known = docs.where("lang is not null and lang <> '' and text is not null")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return ["und"], np.zeros((1, BUCKETS))
    # the first of each language: tasks hand on no more than so many rows a language each
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id"))
    ids = known.select("doc_id", "lang").withColumn("place", place).where(F.col("place") <= per_language).select("doc_id", "lang").distinct()
    picked = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)  # per_language rows a language
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])

    def run(batches):
        for b in batches:
            rows = [(lang, np.bincount(grams(t), minlength=BUCKETS).astype(np.float64)) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True)]
            sums: dict[str, np.ndarray] = {}
            for lang, v in rows:
                sums[lang] = sums.get(lang, 0) + v
            yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "sums"])

    counts = {x: np.zeros(BUCKETS) for x in languages}
    for r in sample.mapInArrow(run, "lang string, sums binary").toLocalIterator():
        counts[r["lang"]] += np.frombuffer(r["sums"])
    c = np.stack([counts[x] for x in languages]) + ALPHA
    return languages, np.log(c / c.sum(axis=1, keepdims=True))


def evidence(pages: DataFrame, languages: list[str], logs: np.ndarray) -> DataFrame:
    """page_id, url, declared, loglik (one a language), p (the text's own posterior)."""
    sent = pages.sparkSession.sparkContext.broadcast(logs.astype(np.float32))

    def run(batches):
        table = np.ascontiguousarray(sent.value.T)
        for b in batches:
            declared, lik = [], []
            for x in b.column("html"):
                html = x.as_py() or ""
                declared.append(declared_language(html))
                g = grams(visible_text(html))
                total = table[g].sum(axis=0, dtype=np.float64) if len(g) else np.zeros(table.shape[1])
                # trigrams overlap and repeat: beyond EFFECTIVE of them, more text adds no more certainty
                total *= min(1.0, EFFECTIVE / max(1, len(g)))
                lik.append(total - total.max())
            m = np.stack(lik) if lik else np.zeros((0, len(languages)))
            p = np.exp(m)
            p /= p.sum(axis=1, keepdims=True)
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(declared, pa.string()), pa.array(m.tolist(), pa.list_(pa.float64())), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["page_id", "url", "declared", "loglik", "p"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, declared string, loglik array<double>, p array<double>")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, lang, probability."""
    languages, logs = fit_text(docs)
    n = len(languages)
    host = host_of(F.col("url"))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    read = evidence(pages, languages, logs).withColumn("host", host).withColumn("domain", F.when(domain == "", F.col("host")).otherwise(domain)).withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    read = materialise(read)
    parts = [F.col("p")[k] for k in range(n)]

    def sums(*keys: str) -> DataFrame:
        return read.groupBy(*keys).agg(F.array(*[F.sum(x) for x in parts]).alias("s"))

    everything = read.agg(F.array(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in parts]).alias("s")).first()["s"]
    base = (np.array(everything) + 1) / (sum(everything) + n)
    flat = F.array(*[F.lit(float(x)) for x in base])
    hosts, domains = sums("host"), sums("domain")
    # P(value | language), smoothed: declared values and suffixes number as many as the pages hold
    n_declared, n_suffix = (max(1, read.select(c).distinct().count()) for c in ("declared", "suffix"))
    lang_total = F.array(*[F.lit(float(x)) for x in everything])

    def given(df: DataFrame, name: str, size: int) -> DataFrame:
        log = F.zip_with("s", lang_total, lambda a, t: F.log((a + 1.0) / (t + float(size))))
        return df.select(F.col(name), log.alias(f"log_{name}"))

    out = read
    for df, keys in ((hosts.withColumnRenamed("s", "s_host"), ["host"]), (domains.withColumnRenamed("s", "s_domain"), ["domain"]), (given(sums("declared"), "declared", n_declared), ["declared"]), (given(sums("suffix"), "suffix", n_suffix), ["suffix"])):
        out = skew_join(out, df, keys, "inner")

    def smoothed(s: str, prior, kappa: float):
        less = F.zip_with(s, "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        return F.zip_with(less, prior, lambda a, b: a + kappa * b), total(less) + kappa

    top, size = smoothed("s_domain", flat, KAPPA_DOMAIN)
    out = out.withColumn("d", top).withColumn("d_n", size).withColumn("d", F.expr("transform(d, x -> x / d_n)"))
    top, size = smoothed("s_host", F.col("d"), KAPPA_HOST)
    out = out.withColumn("h", top).withColumn("h_n", size).withColumn("prior", F.expr("transform(h, x -> ln(x / h_n))"))
    out = out.withColumn("log", F.expr("transform(loglik, (x, i) -> x + prior[i] + log_declared[i] + log_suffix[i])"))
    out = out.withColumn("top", F.array_max("log")).withColumn("mass", F.expr("aggregate(log, 0D, (a, x) -> a + exp(x - top))"))
    names = F.array(*[F.lit(x) for x in languages])
    return out.select("page_id", "host", "declared", F.element_at(names, F.array_position("log", F.col("top")).cast("int")).alias("lang"), (F.lit(1.0) / F.col("mass")).alias("probability"))
