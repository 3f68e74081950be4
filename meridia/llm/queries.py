"""The queries of this subpackage, one an operator over its whole table, and the SQL of
those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import bpe, chat, embedding_dedup, exact_dedup, filter_audit, hard_negatives, language, mixture, pii, quality, simhash, topk, url_filter
from meridia.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(rows.unionByName(extra))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).drop("ids")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dedup(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_language_id, op2_exact_dedup, op3_top_k, op4_simhash, op5_chat_format, op6_url_filter, op7_mixture, op8_pii, op9_quality, op10_byte_bpe, op11_filter_audit, op12_embedding_dedup, op13_hard_negatives, pipeline)
    return {f.__name__: f for f in own}


_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER

_OP2 = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

_OP3 = """
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, b.row, max(CAST(list_dot_product(a.q, b.q) AS BIGINT)) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, row) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

_OP5 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
                  + length(replace(replace(text, '\', '\\'), '<|', '<\|'))
                  + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


# The orders are run one by one, and a Shapley value is summed over them: no potential.
_OP11 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
      || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
      || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN first < w.doc_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT '' AS s UNION ALL SELECT s || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(s, x)),
p AS (SELECT s AS filter_order, CAST(k AS INTEGER) AS step, substr(s, k, 1) AS own, substr(s, 1, k - 1) AS before FROM o, range(1, 6) r(k) WHERE length(s) = 5),
q AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (WHERE translate(fails, before || own, '') = fails) AS kept,
         sum(n) FILTER (WHERE contains(fails, own) AND translate(fails, before, '') = fails) AS removed,
         sum(n) FILTER (WHERE contains(fails, own) AND translate(fails, before, '') <> fails) AS redundant,
         sum(n) FILTER (WHERE fails = own) AS unique_fails,
         sum(good) FILTER (WHERE contains(fails, own) AND translate(fails, before, '') = fails) AS good_lost,
         sum(toxic) FILTER (WHERE contains(fails, own) AND translate(fails, before, '') = fails) AS toxic_lost
  FROM c, p GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM q
"""


# All pairs, exactly: what the index is measured by.
_OP12 = """
WITH RECURSIVE r AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT * FROM r WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
k AS (SELECT a.row AS a, b.row AS b FROM u a JOIN u b ON a.row <> b.row AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
w AS (SELECT row AS a, row AS b FROM r UNION SELECT w.a, k.b FROM w JOIN k ON w.b = k.a),
c AS (SELECT w.a AS row, min(r.vec_id) AS component_id FROM w JOIN r ON w.b = r.row GROUP BY w.a)
SELECT r.vec_id, (SELECT count(*) FROM k WHERE k.a = r.row) AS n_links, c.component_id, r.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM r JOIN c ON r.row = c.row
"""


_OP13 = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row AND len(a.q) = len(b.q)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5),
n AS (SELECT p.anchor, p.row, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id, s.row) AS n
      FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE n <= 10
"""


# The parts of a URL, of an attribute and of a path without dots, as SQL; from the contract
# and the standards of HTML and URLs, not from the operator's expressions.
def _after(u: str) -> str:
    return f"substr({u}, nullif(strpos({u}, '://'), 0) + 3)"


def _host(u: str) -> str:
    return f"coalesce(translate(regexp_extract({_after(u)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '')"


def _path(u: str) -> str:
    return f"coalesce(regexp_extract({_after(u)}, '^[^/?#]*([^?#]*)', 1), '')"


def _scheme(u: str) -> str:
    return f"substr({u}, 1, strpos({u}, '://') - 1)"


def _alias(u: str) -> str:
    whole = f"split_part({u}, '#', 1)"
    return f"CASE WHEN strpos({u}, '://') > 0 THEN translate({_scheme(u)}, '{_UPPER}', '{_LOWER}') || '://' || {_host(u)} || regexp_replace({_after(whole)}, '^[^/?]*', '') END"


_QUOTES = "'\"''" + "'"


def _attribute(name: str) -> str:
    found = rf"""regexp_extract(tag, '(?is)[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""
    return f"trim(trim({found}, {_QUOTES}))"


def _no_dots(path: str) -> str:
    step = "CASE p WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || p END"
    return rf"(list_reduce(list_concat([''], string_split({path}, '/')[2:]), lambda done, p: {step}) || CASE WHEN regexp_matches({path}, '/\.\.?$') THEN '/' ELSE '' END)"


def _resolved(base: str, to: str) -> str:
    only = f"regexp_extract({to}, '^[^?#]*')"
    tail = f"substr({to}, length({only}) + 1)"
    folder = f"CASE WHEN strpos({_path(base)}, '/') > 0 THEN regexp_replace({_path(base)}, '[^/]*$', '') ELSE '/' END"
    site = f"{_scheme(base)} || '://' || {_host(base)}"
    return f"""CASE
      WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {to}
      WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*:') OR strpos({base}, '://') = 0 THEN NULL
      WHEN starts_with({to}, '//') THEN {_scheme(base)} || ':' || {to}
      WHEN starts_with({to}, '#') THEN split_part({base}, '#', 1)
      WHEN {only} = '' THEN {site} || {_path(base)} || {tail}
      WHEN starts_with({only}, '/') THEN {site} || {_no_dots(only)} || {tail}
      ELSE {site} || {_no_dots(f"(({folder}) || {only})")} || {tail} END"""


def _op6() -> str:
    # written out from the rules, longest last, so that a later CASE stands before it
    order = sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
    fits = []
    for verdict, rule in order:
        at, start = rule.split("/", 1)
        fits.append((f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{start}')", rule, verdict))
    pick = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    parts = lambda c: f"{_host(c)} AS host, {_path(c)} AS path"
    return rf"""
WITH RECURSIVE marked AS (
  SELECT url, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS html FROM pages
  WHERE url IS NOT NULL AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))),
based AS (SELECT url, html, {_attribute("href").replace("(tag,", "(regexp_extract(html, '(?is)<base" + chr(92) + "b[^>]*>'),")} AS told FROM marked),
tags AS (
  SELECT url, CASE WHEN told = '' THEN url ELSE coalesce({_resolved("url", "told")}, url) END AS base,
         unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM based),
targets AS (
  SELECT url, base, replace(CASE
    WHEN list_contains(string_split_regex(lower({_attribute("rel")}), '\s+'), 'canonical') THEN {_attribute("href")}
    WHEN lower({_attribute("http-equiv")}) = 'refresh' THEN regexp_extract({_attribute("content")}, '(?is)^\s*[0-9.]+\s*[;,]\s*url\s*=\s*["'']?([^"''\s]+)', 1)
    END, '&amp;', '&') AS t FROM tags),
links AS (SELECT url AS a, {_resolved("base", "t")} AS b FROM targets WHERE t <> ''),
edges AS (SELECT DISTINCT a, b FROM (SELECT {_alias("a")} AS a, {_alias("b")} AS b FROM links) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
  SELECT DISTINCT a AS alias, a AS other FROM both_ways
  UNION SELECT r.alias, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
others AS (SELECT r.alias, {parts('r.other')} FROM reach r),
reached AS (SELECT alias, max(({pick(2)}) = 'allow') AS allows, max(({pick(2)}) = 'block') AS blocks FROM others GROUP BY alias),
own AS (SELECT page_id, {_alias('url')} AS alias, {parts('url')} FROM pages)
SELECT o.page_id, host, path, {pick(1)} AS rule,
       coalesce({pick(2)}, CASE WHEN r.allows THEN 'allow' WHEN r.blocks THEN 'block' END, 'allow') AS verdict
FROM own o LEFT JOIN reached r ON o.alias = r.alias
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _OP2, "op3_top_k": _OP3, "op5_chat_format": _OP5, "op6_url_filter": _op6(), "op11_filter_audit": _OP11, "op12_embedding_dedup": _OP12, "op13_hard_negatives": _OP13}
