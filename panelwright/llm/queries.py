"""The operators as queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import pieces
from panelwright.llm.alignment import align
from panelwright.llm.decontamination import decontaminate
from panelwright.llm.hard_negatives import mine, usable
from panelwright.llm.line_dedup import dedup_lines
from panelwright.llm.mixing import mix
from panelwright.llm.near_dedup import near_duplicates
from panelwright.llm.pii import KINDS, find_pii, span_text
from panelwright.llm.quality import quality
from panelwright.llm.secrets import scan_secrets
from panelwright.llm.sharding import shard
from panelwright.llm.substring_dedup import dedup_substrings
from panelwright.llm.url_filter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left"
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)).drop("items", "text_hash")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.concat("base", "extra")).alias("spans")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), n_shards=8)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["layers"] == "")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.concat(s["layers"], s["kind"]), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("text_hash", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("text_hash")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align(table(spark, sf_dir, "documents"), *models)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 100 == 0)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(ids).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_near_dedup": op2_near_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_pii": op4_pii,
        "op5_sharding": op5_sharding,
        "op6_line_dedup": op6_line_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_secret_scan": op8_secret_scan,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_mixing": op10_mixing,
        "op11_token_alignment": op11_token_alignment,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_sentencepiece": op13_sentencepiece,
    }


OP1_SQL = r"""
WITH lines AS (
    SELECT doc_id, source, text, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words
    FROM (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
),
full_lines AS (
    SELECT doc_id, coalesce(source, '') AS host, text, pos, line, len(words) AS n,
           translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines WHERE len(words) > 0
),
hosts AS (SELECT coalesce(source, '') AS host, count(DISTINCT text) AS n_texts FROM documents GROUP BY 1),
above AS (
    SELECT host, key FROM full_lines JOIN hosts USING (host) GROUP BY host, key, n_texts
    HAVING count(DISTINCT text) > 10 AND count(DISTINCT text) > 0.02 * n_texts
),
gone AS (SELECT doc_id, sum(n) AS gone FROM full_lines JOIN above USING (host, key) GROUP BY doc_id),
dups AS (SELECT doc_id, sum(c - 1) AS n_dup FROM (SELECT doc_id, line, count(*) AS c FROM full_lines GROUP BY ALL) GROUP BY doc_id),
words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
wins AS (
    SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM words)
),
twice AS (SELECT doc_id, win FROM wins GROUP BY ALL HAVING count(*) > 1),
covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat
    FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM wins JOIN twice USING (doc_id, win)) GROUP BY doc_id
),
base AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
           CAST(len(words) - coalesce(gone, 0) AS BIGINT) AS words_left
    FROM words LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND words_left >= n_words / 3.0 AS kept
FROM base
"""

OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
bw AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hits) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6_SQL = r"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
    SELECT doc_id, pos, line,
           translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM texts)
),
shared AS (
    SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
),
flagged AS (
    SELECT l.doc_id, pos, line, s.key IS NOT NULL AND s.first <> l.doc_id AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

OP12_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scored AS (
    SELECT a.vec_id AS anchor_id, o.vec_id, o.label = a.label AS same, CAST(list_inner_product(a.x, o.x) AS BIGINT) AS score
    FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op3_decontamination": OP3_SQL, "op6_line_dedup": OP6_SQL, "op12_hard_negatives": OP12_SQL}
