"""The registered queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeprofile.llm import pieces, secrets, token_files
from lakeprofile.llm.common import read_table
from lakeprofile.llm.decontaminate import contamination
from lakeprofile.llm.fill_in_middle import fill_in_middle, restored_sha256
from lakeprofile.llm.language_id import with_language
from lakeprofile.llm.line_dedup import dedup_lines
from lakeprofile.llm.near_duplicates import near_duplicate_groups
from lakeprofile.llm.nearest import nearest_neighbours
from lakeprofile.llm.quality import with_quality
from lakeprofile.llm.repeats import without_repeats
from lakeprofile.llm.resampling import resample
from lakeprofile.llm.url_filter import host_of, url_verdicts


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)
), d AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
        FROM w CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)
), hit AS (SELECT doc_id, i, d.k, item_id FROM d JOIN win USING (win) WHERE d.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines before, lines removed, and the SHA-256 of what remains (of the empty text for a null one)."""
    return dedup_lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ls[i:i + 2], chr(10)) AS win
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM win
                         WHERE trim(translate(win, chr(10) || chr(13) || chr(9), '')) <> '')
  WHERE nth > 1
), gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later),
line AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (gone.i IS NULL) AS t, count(gone.i) AS n
  FROM line LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(kept.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM l LEFT JOIN kept USING (doc_id)
"""


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "documents"), width=4).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS sh
  FROM (SELECT doc_id, ws, least(len(ws), 4) AS k, unnest(range(1, len(ws) - least(len(ws), 4) + 2)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
), comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""

def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", secrets.scan(F.col("text")).alias("found")).select("doc_id", "found.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_language(read_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, their crc32, and whether decoding them gives the text back."""
    return pieces.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).drop("ids")


def op6_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Host, path and verdict of the rules that the query is asked to judge by.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words in a host whose URLs stand for a published list.
LISTED_HOSTS = "pills|casino|bets|adult|spam|ads-track"


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the URLs, in any spelling, of pages whose host has one of the words in ``LISTED_HOSTS``."""
    pages = read_table(spark, sf_dir, "pages")
    listed = pages.filter(host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_verdicts(pages, rules, listed).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


OP11_SQL = r"""
WITH u AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '://[^?#]*[?]([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|ref)(=|$)'))) AS kept FROM pages
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM u
), listed AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(host, 'pills|casino|bets|adult|spam|ads-track')),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
h AS (SELECT DISTINCT host, path FROM u),
best AS (
  SELECT host, path, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(rverdict, len(rhost || rpath)) AS rverdict
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path
)
SELECT page_id, c.host, c.path, rule, coalesce(rverdict, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best ON c.host = best.host AND c.path = best.path LEFT JOIN listed ON c.canonical = listed.canonical
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256",
        restored_sha256(F.col("output"), F.col("form")).alias("restored_sha256"))


OP12_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
d AS (SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::UBIGINT AS h1, ('0x' || x[9:16])::UBIGINT AS h2, ('0x' || x[17:24])::UBIGINT AS h3,
  ('0x' || x[25:32])::UBIGINT AS h4 FROM h),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS lo, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS hi,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(t, 1, lo) AS prefix, substring(t, lo + 1, hi - lo) AS middle, substring(t, hi + 1) AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select(
        F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH crc AS (  -- the table of the checksum, by its rule
  SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY 1, 2),
words AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM b)),
bucket AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::UBIGINT)),
    lambda c, v: xor(c >> 8, t[((xor(c, v) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 10000 AS bucket FROM words, crc
), s AS (SELECT bucket, sum(n) AS s FROM dw JOIN bucket USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN bucket USING (word) GROUP BY 1),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s, coalesce((SELECT sum(t) FROM t), 0) AS t),
gain AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (total.s + 10000)::DOUBLE / ((s.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket), total
), weight AS (SELECT doc_id, sum(n * g) AS weight FROM dw JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY 1),
score AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::UBIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN weight USING (doc_id)
), placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM score WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM score LEFT JOIN placed USING (doc_id)
"""


QUERIES = {
    "op1_decontamination": op1_decontamination, "op2_token_files": op2_token_files, "op3_quality": op3_quality, "op4_nearest": op4_nearest,
    "op5_line_dedup": op5_line_dedup, "op6_byte_repeats": op6_byte_repeats, "op7_secret_scan": op7_secret_scan, "op8_pieces": op8_pieces,
    "op9_language_id": op9_language_id, "op10_near_dedup": op10_near_dedup, "op11_url_filter": op11_url_filter,
    "op12_fill_in_middle": op12_fill_in_middle, "op13_resampling": op13_resampling,
}
ORACLES = {
    "op1_decontamination": OP1_SQL, "op5_line_dedup": OP5_SQL, "op10_near_dedup": OP10_SQL, "op11_url_filter": OP11_SQL, "op12_fill_in_middle": OP12_SQL,
    "op13_resampling": OP13_SQL,
}
