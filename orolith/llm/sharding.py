"""Contiguous shards of near-equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stable

#: Bytes counted for a document besides its text.
OVERHEAD = 16


def byte_shards(documents: DataFrame, n_shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each document of (doc_id, text).

    Documents lie in ascending doc_id order (null first, then by text); a document goes to the shard that holds the
    middle of its bytes, so shards are contiguous and differ from an equal share by at most one document's size at each
    end. Sizes are dealt into ranges once and kept in the shared folder; per-range totals give each range's start, and
    only sums within a range are taken row by row. Null text has no bytes and the checksum of the empty text. Repeated
    rows lie side by side. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    sized = documents.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("tie"))
    ranged = stable(sized.repartitionByRange("doc_id", "tie").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before, everything = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy()  # a row for each range
    starts = totals.select("part", (F.sum("bytes").over(before) - F.col("bytes")).alias("bytes_before"), (F.sum("rows").over(before) - F.col("rows")).alias("rows_before"), F.sum("bytes").over(everything).alias("total"))
    within = W.partitionBy("part").orderBy("doc_id", "tie", "size")
    summed = ranged.withColumn("own", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("nth", F.row_number().over(within))
    middle = 2 * (F.col("bytes_before") + F.col("own")) - F.col("size")
    placed = summed.join(starts, "part").select(
        "doc_id", "size", "text_crc32", F.least(F.lit(n_shards - 1), F.floor(middle.cast("decimal(38,0)") * n_shards / (2 * F.col("total")))).cast("int").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("row")
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows at most
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
