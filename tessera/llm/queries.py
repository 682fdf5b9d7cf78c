"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.decontam import benchmark_hits, words_hit
from tessera.llm.exact_dedup import exact_groups
from tessera.llm.packing import pack_documents
from tessera.llm.token_files import token_file_digest
from tessera.llm.licenses import label_list, license_scan
from tessera.llm.pii import KINDS, personal_data, span_list
from tessera.llm.prefix_trie import prefix_trie, turns_of
from tessera.llm.quality import graded
from tessera.llm.quality_rules import quality_rules
from tessera.llm.simhash import simhash_components
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.toxicity import toxicity
from tessera.llm.whitening import whitened


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents' columns. A table of fewer splits than cores is dealt to all of them, as its size makes that cheap."""
    docs, cores = _table(spark, sf_dir, "documents").select("doc_id", "text", *columns), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    hits = benchmark_hits(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = words_hit("hits.runs")
    return hits.select(
        "doc_id",
        "hits.n_words",
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(_documents(spark, sf_dir))
    own = F.transform("detections", lambda x: x["label"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", label_list(F.col("base")).alias("base_labels"), label_list(F.col("base"), own).alias("labels"), "score")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_documents(spark, sf_dir), digest_all=True).drop("row_hash")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_documents(spark, sf_dir))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    own = F.size("added") + reduce(lambda a, b: a + b, [F.size(k) for k in KINDS])
    return found.select("doc_id", *counts, F.sha2(span_list(False), 256).alias("base_sha256"), span_list(True).alias("spans"), own.cast("long").alias("n_spans"), (own > 0).alias("personal"))


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_file_digest(_documents(spark, sf_dir), tokenizer, end_id=2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = graded(docs, _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "quality.expected_grade", F.col("quality.tail").alias("p_good"), F.col("quality.selected").alias("kept"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = toxicity(docs, _table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"),
        "toxicity.score",
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.select("vec_id", "whitening", F.posexplode("whitening.whitened").alias("place", "value")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "whitening.n",
        F.col("whitening.deviation").cast("long").alias("deviation"),
        F.col("value").alias("whitened"),
        F.get("whitening.explained", F.col("place")).alias("explained"),
        "whitening.identity_error",
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation begins with up to three turns of the one whose id is the next lower multiple of 20."""
    own = staged(turns_of(_table(spark, sf_dir, "conversations")), "turns")
    heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("of"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    turns = F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    both = own.join(heads, F.expr("conv_id - conv_id % 20") == F.col("of"), "left")
    return prefix_trie(both.select("conv_id", turns.alias("turns"))).withColumn("depth", F.col("depth").cast("long"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_documents(spark, sf_dir, "lang", "source"))
    return found.drop("row_hash").withColumn("failed", F.array_join("failed", ","))


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_packing": op2_packing,
        "op3_license_scan": op3_license_scan,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_personal_data": op6_personal_data,
        "op7_token_files": op7_token_files,
        "op8_quality": op8_quality,
        "op9_toxicity": op9_toxicity,
        "op10_simhash": op10_simhash,
        "op11_whitening": op11_whitening,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_quality_rules": op13_quality_rules,
    }


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, w, least(len(w), 10) AS m
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS g
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM i)
), lens AS (SELECT DISTINCT m FROM i
), dw AS (
  SELECT r, m, p, array_to_string(w[p : p + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, lens WHERE len(w) >= m)
), hit AS (SELECT DISTINCT r, dw.m, p, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g
), n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS x FROM hit) GROUP BY r
), t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, array_slice(b, p, p + 49) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT w.doc_id, p FROM w JOIN f USING (s) WHERE first < w.doc_id),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM h),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS e FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 1) AS prev FROM r),
c AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN a > prev THEN hex(array_slice(b, prev, a - 1)) ELSE '' END, '' ORDER BY a) AS head, max(e) AS tail FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN head IS NULL THEN b WHEN tail > octet_length(b) THEN unhex(head) ELSE unhex(head || hex(array_slice(b, tail, octet_length(b)))) END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS pos, role, text, words FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT) AS bytes FROM (SELECT DISTINCT conv_id FROM t)
), k AS (
  SELECT conv_id, base, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 4 AS h
  FROM c
), r AS (
  SELECT k.conv_id, pos AS place, role, text, words FROM k JOIN o ON o.conv_id = k.base AND pos <= h
  UNION ALL SELECT k.conv_id, 3 + pos, role, text, words FROM k JOIN o ON o.conv_id = k.conv_id AND pos > h
), d AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, {'role': role, 'text': text} AS x, words FROM r
), p AS (
  SELECT conv_id, depth, list(x) OVER (PARTITION BY conv_id ORDER BY depth) AS path, words FROM d
  UNION ALL SELECT conv_id, 0, [], 0 FROM k
), l AS (SELECT conv_id, max(depth) AS n FROM p GROUP BY conv_id
), e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p JOIN l USING (conv_id) WHERE depth = n GROUP BY path
), n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY path, depth
), f AS (SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), a AS (
  SELECT path[1 : up] AS path, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT n.path, depth, n_convs, words, n_children, unnest(range(0, depth + 1)) AS up FROM n LEFT JOIN f USING (path)) GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN f ON f.path = n.path JOIN a ON a.path = n.path LEFT JOIN e ON e.path = n.path LEFT JOIN n AS q ON n.depth > 0 AND q.depth = n.depth - 1 AND q.path = n.path[1 : n.depth - 1]
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, row_number() OVER () AS r, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, win) AS times FROM (SELECT r, p, array_to_string(w[p : p + 7], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM d))
), rep AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS x FROM g WHERE times > 1) GROUP BY r
), c AS (
  SELECT doc_id, lang, source, r, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals
  FROM d LEFT JOIN rep USING (r)
), m AS (
  SELECT r, lang, source, unnest([1, 2, 3, 4, 5]) AS rule,
         unnest([word_chars * 1000 // n_words, n_symbols * 1000 // n_words, n_dup_lines * 1000 // n_lines, n_repeat_words * 1000 // n_words, n_capitals * 1000 // word_chars]) AS v
  FROM c WHERE n_words > 0
), s AS (SELECT lang, source, rule, v - v % (2 ** greatest(length(bin(v)) - 7, 0))::BIGINT AS v FROM m
), lv AS (
  SELECT 1 AS level, lang, source, rule, v FROM s UNION ALL SELECT 2, lang, NULL, rule, v FROM s UNION ALL SELECT 3, NULL, NULL, rule, v FROM s
), o AS (
  SELECT *, row_number() OVER (PARTITION BY level, lang, source, rule ORDER BY v) AS k, count(*) OVER (PARTITION BY level, lang, source, rule) AS n FROM lv
), q AS (
  SELECT level, lang, source, rule, any_value(n) AS n, min(v) FILTER (4 * k >= n) AS q1, min(v) FILTER (4 * k >= 3 * n) AS q3 FROM o GROUP BY ALL
), f AS (
  SELECT *, q1 - 3 * greatest(q3 - q1, [100, 50, 100, 50, 25][rule]) AS low, q3 + 3 * greatest(q3 - q1, [100, 50, 100, 50, 25][rule]) AS high FROM q
), x AS (
  SELECT a.lang, a.source, a.rule, CASE WHEN a.n >= 100 THEN a.low WHEN b.n >= 100 THEN b.low ELSE e.low END AS low, CASE WHEN a.n >= 100 THEN a.high WHEN b.n >= 100 THEN b.high ELSE e.high END AS high
  FROM f AS a JOIN f AS b ON b.level = 2 AND b.rule = a.rule AND b.lang IS NOT DISTINCT FROM a.lang JOIN f AS e ON e.level = 3 AND e.rule = a.rule WHERE a.level = 1
), bad AS (
  SELECT r, string_agg(['word_length', 'symbols', 'duplicate_lines', 'repeated_words', 'capitals'][m.rule], ',' ORDER BY m.rule) AS failed
  FROM m JOIN x ON x.rule = m.rule AND x.lang IS NOT DISTINCT FROM m.lang AND x.source IS NOT DISTINCT FROM m.source WHERE v > high OR (m.rule = 1 AND v < low) GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(failed, '') AS failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND failed IS NULL AS kept
FROM c LEFT JOIN bad USING (r)
"""


def oracle_sql() -> dict:
    return {
        "op1_decontamination": OP1_SQL,
        "op4_suffix_dedup": OP4_SQL,
        "op5_exact_dedup": OP5_SQL,
        "op12_prefix_trie": OP12_SQL,
        "op13_quality_rules": OP13_SQL,
    }
