"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counts, fingerprints, jaccard, mixing, negatives, pii, quality, secrets, toxicity, trie, urls, warc
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary, by default the byte-level one; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.responses(table(spark, sf_dir, "pages")).withColumnRenamed("source_id", "page_id")
    return warc.derive(found)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.sort_array(F.concat("base", "extra"))
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.as_text(every).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    key = lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["kind"].alias("kind"), x["stop"].alias("stop"))
    every = F.sort_array(F.transform(F.concat("base", "extra"), key))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in secrets.KINDS], F.sha2(text(F.sort_array(F.transform("base", key))).cast("binary"), 256).alias("base_sha256"), text(every).alias("spans"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("lang", "text_hash")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "decided_by")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return trie.prefix_trie(trie.rebuilt(table(spark, sf_dir, "conversations"), 20, head))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), ["doc_id"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.whole_numbers(table(spark, sf_dir, "embeddings")).withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.coalesce(F.col("id") % 50 == 0, F.lit(False)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_warc_derivatives, op2_toxicity, op3_jaccard_join, op4_mix_sources, op5_bpe, op6_pii, op7_secrets, op8_quality_rules, op9_fingerprints, op10_url_filter, op11_conversation_trie, op12_token_counts, op13_hard_negatives]
    return {f.__name__: f for f in found}


_UUID = "'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"


#: References that the given pages hold, decoded after all markup is gone; & comes last.
_REFERENCES = [("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("&amp", "&")]
_END_SQL = r"([\x20\t\r\n\f/][^>]*)?(>|\z)"


def _decoded(c: str) -> str:
    for name, to in _REFERENCES:
        c = f"replace({c}, '{name}', '{to.replace(chr(39), chr(39) * 2)}')"
    return c


def _shown(c: str) -> str:
    hidden = "|".join(rf"<{n}([\x20\t\r\n\f/][^>]*)?(>.*?(</{n}{_END_SQL}|\z)|\z)" for n in warc.HIDDEN)
    return f"regexp_replace({c}, '(?is)<!--.*?(-->|\\z)|{hidden}', ' ', 'g')"


def _plain(c: str) -> str:
    for pattern, to in [(rf"(?i)</?({warc.LINES}){_END_SQL}", "chr(10)"), (r"<[A-Za-z/!?][^>]*(>|\z)", "''")]:
        c = f"regexp_replace({c}, '{pattern}', {to}, 'g')"
    c = _decoded(c)
    for pattern, to in [(r"[\x20\x09\x0D\x{A0}]+", "' '"), (r" ?\n[\n ]*", "chr(10)"), (r"^[\n ]+|[\n ]+$", "''")]:
        c = f"regexp_replace({c}, '{pattern}', {to}, 'g')"
    return c


def _title(c: str) -> str:
    inner = f"regexp_extract({c}, '(?is)<title([\\x20\\t\\r\\n\\f/][^>]*)?(>(.*?)(</title{_END_SQL}|\\z)|\\z)', 3)"
    return "trim(regexp_replace(" + _decoded(f"regexp_replace({inner}, '<[A-Za-z/!?][^>]*(>|\\z)', '', 'g')") + ", '[\\s]+', ' ', 'g'))"


OP1_SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS payload, md5('response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || coalesce(url, '')) AS h FROM pages
), r AS (
  SELECT page_id, url AS target_uri, payload, {_UUID.format(h="h")} AS record_id, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(payload) AS VARCHAR) AS head FROM p
), g AS (
  SELECT *, {_shown("payload")} AS shown FROM r
), t AS (
  SELECT * EXCLUDE shown, {_plain("shown")} AS body, 'sha256:' || sha256(payload) AS source_digest, {_title("shown")} AS title,
         md5('metadata' || chr(10) || record_id) AS mh, md5('conversion' || chr(10) || record_id) AS ch FROM g
), u AS (
  SELECT *, {_UUID.format(h="mh")} AS mid, {_UUID.format(h="ch")} AS cid,
         'source-status: 200' || chr(13) || chr(10) || 'source-content-type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-length: ' || CAST(strlen(payload) AS VARCHAR) || chr(13) || chr(10)
         || 'source-digest: ' || source_digest || chr(13) || chr(10) || 'text-length: ' || CAST(strlen(body) AS VARCHAR) || chr(13) || chr(10) || 'text-digest: sha256:' || sha256(body) || chr(13) || chr(10) || 'title: ' || title || chr(13) || chr(10) AS meta FROM t
), v AS (
  SELECT page_id, mid AS record_id, 'metadata' AS warc_type, target_uri, 'application/warc-fields' AS content_type, record_id AS refers_to, cid AS concurrent_to, source_digest, head, meta AS block FROM u
  UNION ALL
  SELECT page_id, cid, 'conversion', target_uri, 'text/plain; charset=utf-8', record_id, mid, source_digest, head, body FROM u
)
SELECT page_id, record_id, warc_type, target_uri, '{warc.EPOCH}' AS date, content_type, refers_to, concurrent_to, 'sha256:' || sha256(block) AS block_digest, source_digest AS payload_digest,
       '200' AS source_status, 'text/html; charset=utf-8' AS source_content_type, head AS source_headers, CAST(strlen(block) AS BIGINT) AS content_length, block FROM v"""

#: The same mix by sorting: each copy level takes rows by hash while their sum stays under the budget, then the row at the edge if that is nearer.
OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE i % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, CAST(2.0 * source_size AS DOUBLE) AS most, CAST(1.5 * sum(source_size) OVER () AS DOUBLE) AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (
  SELECT level FROM l WHERE level * w <= most ORDER BY most / w, level LIMIT 1
), t AS (
  SELECT l.source, l.source_size, least(l.most, coalesce((SELECT level FROM f), CAST('inf' AS DOUBLE)) * l.w) AS target FROM l
), c AS (
  SELECT d.doc_id, d.size, d.h, t.source, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS here
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT *, greatest(0.0, least(source_size, target)) AS b1, greatest(0.0, least(source_size, target - source_size)) AS b2 FROM c
)
SELECT doc_id, size, source_size, target, CAST(size * (
  CASE WHEN upto <= b1 OR (upto - here <= b1 AND upto - b1 < b1 - (upto - here)) THEN 1 ELSE 0 END
  + CASE WHEN upto <= b2 OR (upto - here <= b2 AND upto - b2 < b2 - (upto - here)) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM b"""


#: Every prefix of every rebuilt conversation; crc32 a bit at a time, over each byte and eight shifts.
OP11_SQL = r"""
WITH o AS (
  SELECT conv_id, id, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM (
    SELECT conv_id, turn, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, strlen(s) + 1), lambda i: [CAST(ascii(substr(s, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL)
), q AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.id, o.n FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.id, o.n FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h
), l AS (
  SELECT c.conv_id, coalesce(list(q.id ORDER BY part, pos) FILTER (WHERE q.id IS NOT NULL), []) AS ids, list(q.n ORDER BY part, pos) AS ns FROM c LEFT JOIN q ON q.conv_id = c.conv_id GROUP BY c.conv_id
), x AS (
  SELECT conv_id, unnest(range(0, len(ids) + 1)) AS d, ids, ns FROM l
), n AS (
  SELECT list_slice(ids, 1, d) AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(ns[d]), 0) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(ids) = d), '')) AS ends_sha256 FROM x GROUP BY 1, 2
), e AS (
  SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1
), f AS (
  SELECT n.*, coalesce(e.n_children, 0) AS n_children FROM n LEFT JOIN e ON e.path = n.path
), a AS (
  SELECT list_slice(path, 1, j) AS path, sum((n_convs - 1) * w) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM f) GROUP BY 1
)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN a ON a.path = f.path LEFT JOIN n u ON f.d > 0 AND u.d = f.d - 1 AND u.path = list_slice(f.path, 1, f.d - 1)"""

#: All anchors against all rows.
OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_derivatives": OP1_SQL, "op4_mix_sources": OP4_SQL, "op11_conversation_trie": OP11_SQL, "op13_hard_negatives": OP13_SQL}
