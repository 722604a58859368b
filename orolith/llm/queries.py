"""The registered queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("detections")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(documents)
    return langid.identify(documents.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import byte_shards

    return byte_shards(table(spark, sf_dir, "documents"), 40)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(documents, table(spark, sf_dir, "benchmark")).drop("text")


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenbin import token_digests

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"), keep_trees=False).drop("tree")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixcount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import main_text

    return main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_language_id": op2_language_id,
        "op3_source_mix": op3_source_mix,
        "op4_byte_shards": op4_byte_shards,
        "op5_decontamination": op5_decontamination,
        "op6_token_binary": op6_token_binary,
        "op7_merkle_fingerprint": op7_merkle_fingerprint,
        "op8_token_counts": op8_token_counts,
        "op9_simhash_vptree": op9_simhash_vptree,
        "op10_html_text": op10_html_text,
    }


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
 src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS src FROM sized GROUP BY source),
 cap AS (SELECT *, CASE src % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, 2.0 * source_size AS cap, 1.5 * (SELECT sum(source_size) FROM src) AS amount FROM src),
 lev AS (SELECT *, CAST(amount - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM cap),
 tgt AS (SELECT source, src, source_size, amount, round(CASE WHEN cap / weight <= level THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT max(level) FROM lev WHERE cap / weight > level) END, 6) AS target FROM lev),
 blk AS (SELECT CAST(floor(max(amount)) AS BIGINT) AS amount, 256 AS block FROM tgt),
 slot AS (SELECT (i * 2654435769) % 4294967296 AS point FROM (SELECT unnest(range(0, -((-amount) // block) + 1)) AS i, -((-amount) // block) AS n FROM blk) WHERE i * (SELECT block FROM blk) < (SELECT amount FROM blk)),
 arc AS (SELECT src, hi, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo FROM (SELECT src, CASE WHEN upto = max(upto) OVER () THEN 4294967296 ELSE CAST(floor(upto / every * 4294967296) AS BIGINT) END AS hi
   FROM (SELECT src, sum(target) OVER (ORDER BY src) AS upto, sum(target) OVER () AS every FROM tgt WHERE target > 0))),
 slots AS (SELECT src, count(*) * (SELECT block FROM blk) AS upto FROM slot JOIN arc ON point >= lo AND point < hi GROUP BY src),
 taken AS (SELECT src, CASE WHEN target < 256 * (SELECT block FROM blk) THEN CAST(round(target) AS BIGINT) ELSE upto END AS upto FROM tgt LEFT JOIN slots USING (src)),
 laid AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.src, sum(d.size) OVER (PARTITION BY t.src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size AS place FROM sized d JOIN tgt t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(place + size, coalesce(upto, 0)) - place) + greatest(0, least(source_size + place + size, coalesce(upto, 0)) - source_size - place) AS BIGINT) AS taken FROM laid LEFT JOIN taken USING (src)
"""

CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
 win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, words[s : s + 9] AS phrase FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS s FROM b WHERE len(words) > 0)),
 part AS (SELECT doc_id, p, n, words[p : p + n - 1] AS phrase FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM d, (SELECT DISTINCT len(phrase) AS n FROM win))),
 hit AS (SELECT doc_id, p, n, item_id FROM part JOIN win USING (phrase)),
 pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id),
 item AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN item USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The others learn, tokenise, parse pages or hash by functions that DuckDB lacks; their tests use brute force."""
    return {"op3_source_mix": MIX_SQL, "op5_decontamination": CONTAMINATION_SQL}
