"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, stable, token_count

#: Weights of sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: 2 ** 32 over the golden ratio, odd: multiples of it modulo 2 ** 32 are the schedule's points.
GOLDEN, TURN = 2654435769, 1 << 32
CELLS = 1024
CHUNK = 1 << 16
BUCKET = 4096
#: Words of a block, at every size of the input.
BLOCK = 256
#: A source whose target is under so many blocks takes its target to the word: of some blocks, the schedule's are too coarse.
FEW_BLOCKS = 256


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds src (place in code-point order, null last, from 0), weight and target to (source, source_size).

    The targets share `share` times all sizes by weight; one stops at `most` times its source's size, and what is
    above is shared again by weight until none is above: the common level of a filling by weight. Its windows go over
    a row for each source."""
    order = W.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("src", (F.row_number().over(order) - 1).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("src") % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("amount", share * F.sum("source_size").over(W.partitionBy()).cast("double"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "src")
    full = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("amount") - full) / F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    common = F.max(F.when(~F.col("capped"), F.col("level"))).over(W.partitionBy())
    return filled.select("source", "src", "source_size", "n_rows", "weight", F.round(F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * common), 6).alias("target"), "amount")


def schedule(spark: SparkSession, mixed: DataFrame, n_slots: int) -> DataFrame:
    """(slot, src, block): the source of each slot and its rank among the source's slots.

    Slot t's point is t golden-ratio steps round a circle of 2 ** 32; the circle is divided among the sources by their
    targets. Points find their source over 1024 equal cells of the circle, an equi-join with at most 1024 rows and a
    row for each source. Ranks are counted in chunks of slots, so no task holds all slots of a source."""
    upto = W.orderBy("src")
    ends = mixed.where("target > 0").select("src", "target", F.sum("target").over(W.partitionBy()).alias("all"), F.sum("target").over(upto).alias("upto"))
    arcs = ends.select("src", F.floor((F.col("upto") - F.col("target")) / F.col("all") * TURN).alias("lo"), F.when(F.col("upto") == F.max("upto").over(W.partitionBy()), F.lit(TURN)).otherwise(F.floor(F.col("upto") / F.col("all") * TURN)).alias("hi")).where("hi > lo")
    arcs = arcs.withColumn("lo", F.when(F.col("lo") == F.min("lo").over(W.partitionBy()), F.lit(0)).otherwise(F.lag("hi").over(W.orderBy("src"))))
    cell = TURN // CELLS
    arcs = arcs.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    turn = F.pmod(F.col("id"), F.lit(TURN))  # the points recur after a turn; halves of its bits keep products within a long
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.pmod(F.shiftleft(F.pmod(F.shiftright(turn, 16) * GOLDEN, F.lit(1 << 16)), 16) + turn.bitwiseAND(F.lit(0xFFFF)) * GOLDEN, F.lit(TURN)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / cell))
    slots = points.join(arcs, "cell").where("point >= lo and point < hi").select("slot", F.floor(F.col("slot") / CHUNK).alias("chunk"), "src")
    counts = slots.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    starts = counts.select("src", "chunk", (F.sum("n").over(W.partitionBy("src").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = slots.withColumn("nth", F.row_number().over(W.partitionBy("src", "chunk").orderBy("slot")))
    return ranked.join(starts, ["src", "chunk"]).select("slot", "src", (F.col("before") + F.col("nth") - 1).alias("block"))


def _shuffle_key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document of (doc_id, text, source).

    A source's documents lie end to end in the order of md5(doc_id), once for each of `most` passes, and are cut into
    blocks of `block` words; the schedule's slots take the source's blocks in order. taken counts the words of a document
    in blocks that a slot takes, so it is at most `most` times its size, and a source's words differ from its target by
    the schedule's discrepancy, a few blocks. A source whose target is under FEW_BLOCKS blocks takes its words up to the
    target, whatever its slots. Places are prefix sums over buckets of the order, about 4096 rows each, so
    a hot source is spread. Null texts have no words; documents without words take none; repeated rows are mixed each.
    """
    spark = documents.sparkSession
    sized = stable(documents.select("doc_id", "source", token_count(F.col("text")).alias("size"), _shuffle_key().alias("key")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    mixed = stable(targets(sources, weights, share, most))
    amount = int((mixed.agg(F.max("amount")).first()[0]) or 0)
    n_slots = -(-amount // block)

    per_source = mixed.select(F.col("source").alias("its"), "src", "source_size", "target", F.ceil(F.col("n_rows") / BUCKET).alias("buckets"))
    rows = sized.join(per_source, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets") / TURN))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("sum"))
    starts = sums.select("src", "bucket", (F.sum("sum").over(W.partitionBy("src").orderBy("bucket")) - F.col("sum")).alias("start"))
    within = W.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = rows.withColumn("upto", F.sum("size").over(within)).withColumn("nth", F.row_number().over(W.partitionBy("src", "bucket").orderBy("key", "doc_id", "size")))
    laid = laid.join(starts, ["src", "bucket"]).withColumn("place", F.col("start") + F.col("upto") - F.col("size"))
    passes = laid.withColumn("place", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.col("place") + k * F.col("source_size"))))
    end = F.col("place") + F.col("size")
    few = F.col("target") < FEW_BLOCKS * block
    exact = passes.where(few).withColumn("part", F.greatest(F.lit(0), F.least(end, F.round("target").cast("long")) - F.col("place"))).withColumn("used", F.lit(True))
    pieces = passes.where(~few).withColumn("block", F.explode(F.sequence(F.floor(F.col("place") / block), F.floor((F.greatest(end, F.col("place") + 1) - 1) / block))))
    pieces = pieces.withColumn("part", F.greatest(F.lit(0), F.least(end, (F.col("block") + 1) * block) - F.greatest("place", F.col("block") * block)))
    slots = schedule(spark, mixed, n_slots).select("src", "block", F.lit(True).alias("used"))
    columns = ["src", "bucket", "nth", "doc_id", "size", "source_size", "target", "part", "used"]
    joined = pieces.join(slots, ["src", "block"], "left").select(*columns).unionByName(exact.select(*columns))
    taken = F.sum(F.when(F.col("used"), F.col("part")).otherwise(F.lit(0))).cast("long")
    return joined.groupBy("src", "bucket", "nth", "doc_id", "size", "source_size", "target").agg(taken.alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """documents as the mix takes them: each row as often as its taken words are of its size, to the nearest whole
    number; a document without words stays once. Rows that share a doc_id are repeated by their common share. The columns
    are untouched, whatever their names; an empty table gives no rows."""
    own, copies_of, nth = fresh(documents, "mixed_id", "mixed_copies", "mixed_nth")
    shares = mix(documents, **options).groupBy("doc_id").agg(F.sum("size").alias("sizes"), F.sum("taken").alias("takes"))
    copies = shares.select(F.col("doc_id").alias(own), F.when(F.col("sizes") > 0, F.floor(F.col("takes") / F.col("sizes") + 0.5)).otherwise(F.lit(1)).alias(copies_of)).where(F.col(copies_of) > 0)
    joined = documents.join(copies, F.col("doc_id").eqNullSafe(F.col(own)))
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies_of)))).select(*documents.columns)
