"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import byte_bpe, conversation_trie, embedding_dedup, kneser_ney, license_scan, maxent_lm, ngram_join, packing, quality_rules, sentencepiece_codec, sharding, spelling_variants, url_filter
from heddle.llm.common import table

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed: the canonical URLs of pages whose document (the number in the URL) is labelled toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    named = pages.select(
        url_filter.canonical(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("canonical"),
        F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') as bigint)").alias("doc_id"),
    )
    listed = named.join(toxic, "doc_id", "left_semi").select("canonical")
    return url_filter.filter_urls(pages, listed, RULES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.Classifier().judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_quality_rules": op4_quality_rules,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_license_scan": op7_license_scan,
    "op8_sharding": op8_sharding,
    "op9_ngram_join": op9_ngram_join,
    "op10_maxent_lm": op10_maxent_lm,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_byte_bpe": op13_byte_bpe,
}

#: crc32's table, and the checksum of a list of bytes `b` in lambda form.
_CRC_TABLE = """crc(t) AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)))"""


def _crc(data: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"


ORACLES: dict[str, str] = {
    "op1_url_filter": r"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '(\.html|/)$', '') END AS canonical FROM p),
listed AS (
  SELECT DISTINCT canonical FROM c
  WHERE try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r AS (
  SELECT c.*, canonical IS NOT NULL AND canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) AS listed,
    CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/'
    END AS rule
  FROM c)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.net/de/8' THEN 'block' WHEN 'example.com/en/7' THEN 'allow' WHEN 'com/en/' THEN 'block'
    WHEN 'net/de/' THEN 'allow' WHEN 'org/es/' THEN 'block' ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict,
  canonical, listed
FROM r""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM documents),
counted AS (SELECT doc_id, r, count(*) AS n FROM run WHERE length(r) >= 6 GROUP BY ALL),
points AS (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || r AS s FROM counted),
bytes AS (SELECT *, flatten(list_transform(list_transform(range(1, length(s) + 1), lambda i: unicode(substr(s, i, 1))), lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + c // 64, 128 + c % 64] END)) AS b FROM points),
summed AS (SELECT r, n, {_crc("b")} AS h FROM bytes, crc),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM summed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, i, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
pair AS (
  SELECT a.word AS word, b.word AS other FROM cut a JOIN cut b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON w.word = p || s
  UNION SELECT w.word, cut.word FROM cut JOIN w ON w.word = p || s),
near AS (
  SELECT pair.word, count(*) AS n_near, first(other ORDER BY o.n DESC, other) AS best, max(o.n) AS best_n
  FROM pair JOIN w o ON o.word = other GROUP BY pair.word),
judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
  FROM w LEFT JOIN near USING (word)),
walk AS (
  SELECT word, word AS head FROM judged
  UNION ALL SELECT walk.word, form FROM walk JOIN judged ON judged.word = head WHERE form IS NOT NULL)
SELECT j.word, j.form, head AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN walk USING (word) JOIN judged e ON e.word = head
WHERE e.form IS NULL""",
    "op12_conversation_trie": f"""
WITH {_CRC_TABLE},
conv AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
share AS (SELECT conv_id, own, {_crc("list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: unicode(substr(conv_id::VARCHAR, i, 1))::BIGINT)")} % 9 AS h FROM conv, crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.own, 1, c.h), []), list_slice(c.own, c.h + 1, len(c.own))) AS s
  FROM share c LEFT JOIN share b ON b.conv_id = c.conv_id - c.conv_id % 5),
member AS (SELECT conv_id, d, s[1:d] AS p, d = len(s) AS ended FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM member GROUP BY p, d),
child AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
own AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(p[depth].x)) END AS saved
  FROM node LEFT JOIN child USING (p, depth)),
up AS (SELECT p[1:e] AS p, e AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS e FROM own) GROUP BY ALL)
SELECT own.conv_id, own.depth, parent.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, own.ends_sha256
FROM own JOIN up USING (p, depth) LEFT JOIN node parent ON own.depth > 0 AND parent.depth = own.depth - 1 AND parent.p = own.p[1:own.depth - 1]""",
}
