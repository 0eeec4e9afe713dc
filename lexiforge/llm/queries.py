"""Registered queries of this package, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.bpe_codec import bpe_encode
from lexiforge.llm.common import table
from lexiforge.llm.html_extract import extract_text
from lexiforge.llm.license_scan import scan_licenses
from lexiforge.llm.line_dedup import dedup_lines
from lexiforge.llm.merkle import compare_with_edit
from lexiforge.llm.near_dedup import near_duplicates
from lexiforge.llm.packing import best_fit_pack, token_pieces
from lexiforge.llm.prefix_trie import conversation_trie
from lexiforge.llm.quality_ranker import Ranker, learn_quality, score_quality
from lexiforge.llm.suffix_dedup import remove_repeats
from lexiforge.llm.topk_search import exact_topk
from lexiforge.llm.url_reputation import host_path, host_reputation, judge_urls
from lexiforge.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE = 4096


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), TOKENIZER, SEQUENCE)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit_pack(pieces, SEQUENCE)


@query("op9_bpe_codec")
def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe_encode(table(spark, sf_dir, "documents"), TOKENIZER, decode=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: Rules of the contract: verdict, host and path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]


@query("op3_host_reputation", """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS u FROM pages),
r AS (
  SELECT page_id, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM u),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM r),
lab AS (
  SELECT doc_id, CASE WHEN min(quality) = 1 AND max(coalesce(toxic, 0)) = 0 THEN 1 WHEN min(quality) IS NOT NULL THEN 0 END AS y
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT host, count(y) AS n, coalesce(sum(y), 0) AS good,
         list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') AS domain, string_split(host, '.')[-1] AS suffix
  FROM p LEFT JOIN lab ON lab.doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]+)(?:[.]html)?/?$', 1), '') AS BIGINT)
  GROUP BY host),
m AS (SELECT coalesce(sum(good) / nullif(sum(n), 0), 0.5) AS m FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, least(greatest(any_value(m), 1e-3), 0.999) AS q FROM h, m GROUP BY suffix),
s1 AS (SELECT 1 / least(greatest(coalesce((sum(CASE WHEN n > 0 THEN n * (good / n - q) ** 2 / (q * (1 - q)) END)
   - count(CASE WHEN n > 0 THEN 1 END)) / nullif(sum(CASE WHEN n > 0 THEN n - 1 END), 0), 0), 1 / 1001.0), 0.5) - 1 AS s FROM s0),
s2 AS (SELECT suffix, (good + q * s) / (n + s) AS rate FROM s0, s1),
d0 AS (SELECT domain, h.suffix, sum(n) AS n, sum(good) AS good, least(greatest(any_value(rate), 1e-3), 0.999) AS q
       FROM h JOIN s2 USING (suffix) GROUP BY ALL),
d1 AS (SELECT 1 / least(greatest(coalesce((sum(CASE WHEN n > 0 THEN n * (good / n - q) ** 2 / (q * (1 - q)) END)
   - count(CASE WHEN n > 0 THEN 1 END)) / nullif(sum(CASE WHEN n > 0 THEN n - 1 END), 0), 0), 1 / 1001.0), 0.5) - 1 AS s FROM d0),
d2 AS (SELECT domain, suffix, (good + q * s) / (n + s) AS rate FROM d0, d1),
h0 AS (SELECT host, n, good, least(greatest(rate, 1e-3), 0.999) AS q FROM h JOIN d2 USING (domain, suffix)),
h1 AS (SELECT 1 / least(greatest(coalesce((sum(CASE WHEN n > 0 THEN n * (good / n - q) ** 2 / (q * (1 - q)) END)
   - count(CASE WHEN n > 0 THEN 1 END)) / nullif(sum(CASE WHEN n > 0 THEN n - 1 END), 0), 0), 1 / 1001.0), 0.5) - 1 AS s FROM h0),
h2 AS (SELECT host, good + q * s AS a, n + s AS t FROM h0, h1),
rep AS (SELECT host, least(a / t + 1.645 * sqrt(a * (t - a) / (t * t * (t + 1))), 1) AS high FROM h2),
rules(verdict, rule, rh, rp) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
hit AS (
  SELECT DISTINCT host, path, first(rule ORDER BY length(rule) DESC) AS rule, first(verdict ORDER BY length(rule) DESC) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path)
SELECT p.page_id, p.host, p.path, hit.rule,
       coalesce(hit.verdict, CASE WHEN rep.high < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hit ON p.host = hit.host AND p.path = hit.path LEFT JOIN rep ON p.host = rep.host
""")
def host_reputation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document that its path names: good if of quality and not toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    good = F.when((F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0), 1).when(F.min("quality").isNotNull(), 0)
    labels = table(spark, sf_dir, "labels").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(good.alias("good"))
    number = F.regexp_extract(host_path(F.col("url"))[1], "/([0-9]+)(?:[.]html)?/?$", 1).try_cast("long")
    outcomes = pages.select("url", number.alias("doc_id")).join(labels, "doc_id", "left")
    return judge_urls(pages, host_reputation(outcomes), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op6_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


@query("op2_exact_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op8_merkle_fingerprints")
def merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = compare_with_edit(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op4_line_dedup", r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.*, keeper IS NOT NULL AND doc_id < keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op10_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


#: Scores from here on are predictions of label 1.
QUALITY_CUT = 0.3


def quality_model(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Learned from the labels outside the held-out fold."""
    return learn_quality(docs, labels.filter(~held_out()), at=QUALITY_CUT)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@query("op7_quality_ranking")
def quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


@query("op13_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op12_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query("op11_conversation_trie", """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
         sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS size FROM conversations),
o AS (SELECT c, list(struct_pack(d := d, size := size) ORDER BY i) AS own FROM t GROUP BY c),
f AS (
  SELECT c, own, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda ch: list_concat([ascii(ch)::UBIGINT], list_transform(range(8), lambda z: 1000::UBIGINT))))),
    lambda r, v: CASE WHEN v < 256 THEN xor(r, v) ELSE xor(r >> 1, (r & 1) * 3988292384) END), 4294967295::UBIGINT) % 9 AS h FROM o),
r AS (
  SELECT f.c, list_concat(coalesce(b.own[1:f.h::BIGINT], []), f.own[f.h::BIGINT + 1:]) AS s
  FROM f LEFT JOIN o b ON b.c = f.c - f.c % 5),
p AS (SELECT c, s, len(s) AS n, unnest(range(0, len(s) + 1)) AS depth FROM r),
q AS (SELECT c, n, depth, list_transform(s[1:depth], lambda e: e.d) AS k, coalesce(s[depth].size, 0) AS size FROM p),
v AS (
  SELECT k, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256 FROM q GROUP BY k, depth),
w AS (SELECT v.*, (SELECT count(*) FROM v u WHERE u.depth = v.depth + 1 AND u.k[1:v.depth] = v.k) AS n_children FROM v),
x AS (SELECT k, depth, n_convs, size, n_children, unnest(range(0, depth + 1)) AS up FROM w),
y AS (
  SELECT k[1:up] AS k, up AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM x GROUP BY ALL)
SELECT w.conv_id, w.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, y.n_leaves,
       y.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN y ON y.k = w.k AND y.depth = w.depth LEFT JOIN v u ON u.depth = w.depth - 1 AND u.k = w.k[1:w.depth - 1]
""")
def conversation_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
