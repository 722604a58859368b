"""SimHash near-duplicates, linked exactly within a Hamming radius by shards of fingerprints that agree in a block of bits.

A vantage-point tree over 64-bit fingerprints prunes badly: distances between unrelated fingerprints crowd around 32, so a
radius of 3 overlaps both sides of most boundaries and a query visits most shards. So bit blocks replace vantage points: a
node splits the bits it has not yet fixed into radius + 1 blocks, and its children are the fingerprints with equal values of a
block. Two fingerprints within the radius agree in one block at least, so each such pair meets in a shard. Nodes of
more than `leaf` fingerprints split again on the bits that are left, whichever the input size, so no shard grows with a
group of near copies and none is cut short. Inside a shard the pairs are found by their exact distances, pruned by the
triangle bound on distances to the shard's pivot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, fresh, stable

SEED = 42
RADIUS = 3
#: Up to so many links (8 MB) one task unites; more take rounds of shuffles.
AT_HAND = 1 << 19
#: Rows that such a task writes at a time.
MOST_ROWS = 100_000


def text_tie() -> Column:
    """With doc_id it names a document; rows that share both are equal."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash: A-Z lower-cased, words between ASCII white space, word shingles with repeats, XXH64 with
    seed 42; a bit is set if over half the hashes have it. Texts of fewer words are one shingle; without words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    parts = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return of_hashes(np.array([digest(join(p), SEED) for p in parts], "<u8"))


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes; of none: 0."""
    n = len(hashes)
    planes = hashes.view(np.uint8).reshape(n, 8)
    if n < 2048:
        ones = np.unpackbits(planes, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(planes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tie, fp) of each document of (doc_id, text), of any type of doc_id; tie is the text's hash, fp the
    fingerprint as a signed long. A text costs time and memory in proportion to its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "tie", "fp"])

    kept = documents.select("doc_id", "text", text_tie().alias("tie"))
    return kept.mapInArrow(run, T.StructType([kept.schema["doc_id"], T.StructField("tie", T.LongType()), T.StructField("fp", T.LongType())]))


def _children(rest: np.ndarray, bits: int, blocks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, its value, the bits left without it) for each block of the `bits` low bits of rest."""
    at = 0
    for block in range(blocks):
        width = bits // blocks + (block < bits % blocks)
        low = rest & np.uint64((1 << at) - 1)
        high = (rest >> np.uint64(at + width)) << np.uint64(at) if at + width < 64 else np.zeros_like(rest)
        yield block, (rest >> np.uint64(at)) & np.uint64((1 << width) - 1), low | high
        at += width


def _left(bits: int, blocks: int, path: int, depth: int) -> int:
    """How many of 64 bits are left after the blocks that path names (base `blocks` digits, first lowest)."""
    for _ in range(depth):
        block = path % blocks
        path //= blocks
        bits -= bits // blocks + (block < bits % blocks)
    return bits


SHARD = "fp long, node long, path long, rest long"


def _split(blocks: int, depth: int):
    """Deals fingerprints of nodes of a depth to their children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node, path, rest = (np.asarray(batch.column(i)) for i in range(4))
            out = []
            for way in np.unique(path).tolist():
                here = path == way
                bits = _left(64, blocks, way, depth)
                for block, value, left in _children(rest[here].view(np.uint64), bits, blocks):
                    key = (value * np.uint64(blocks) + np.uint64(block + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ node[here].view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # nodes whose keys meet only share a shard
                    out.append((fp[here], (key ^ (key >> np.uint64(32))).view(np.int64), np.full(int(here.sum()), way + block * blocks**depth), left.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["fp", "node", "path", "rest"])

    return run


def close_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of the pairs of fps within radius: sorted by distance to a pivot, only those whose distances differ
    by at most the radius can be pairs (triangle bound)."""
    order = np.argsort(np.bitwise_count(fps ^ fps[0]), kind="stable")
    ranked = fps[order]
    shell = np.bitwise_count(ranked ^ fps[0]).astype(np.int64)
    ends = np.searchsorted(shell, shell + radius, side="right")
    left, right = [], []
    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.bitwise_count(ranked[i + 1 : ends[i]] ^ ranked[i]) <= radius)
        left.append(np.full(len(near), i))
        right.append(near + i + 1)
    return (order[np.concatenate(left)], order[np.concatenate(right)]) if left else (np.zeros(0, np.int64),) * 2


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _links(radius: int):
    """For rows sorted by node, the links of each node's fingerprints: each linked one to the smallest it reaches there."""

    def of(fps: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
        sizes = np.diff(np.append(starts, len(fps)))
        src, dst = [], []
        for size in np.unique(sizes[sizes <= 8]).tolist():  # small shards side by side
            rows = starts[sizes == size][:, None] + np.arange(size)
            block = fps[rows]
            for i in range(size):
                for j in range(i + 1, size):
                    near = np.bitwise_count(block[:, i] ^ block[:, j]) <= radius
                    src.append(block[near, i].view(np.int64))
                    dst.append(block[near, j].view(np.int64))
        for start, size in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
            own = np.sort(fps[start : start + size].view(np.int64)).view(np.uint64)
            parent = list(range(size))
            for i, j in zip(*(x.tolist() for x in close_pairs(own, radius)), strict=True):
                a, b = _find(parent, i), _find(parent, j)
                parent[max(a, b)] = min(a, b)
            roots = np.array([_find(parent, i) for i in range(size)])
            moved = np.flatnonzero(roots != np.arange(size))
            src.append(own[moved].view(np.int64))
            dst.append(own[roots[moved]].view(np.int64))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (src, dst))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, nodes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            fps = np.concatenate([fps, np.asarray(batch.column(0)).view(np.uint64)])
            nodes = np.concatenate([nodes, np.asarray(batch.column(1))])
            last = int(np.searchsorted(nodes, nodes[-1])) if len(nodes) else 0  # the last node may go on in the next batch
            if last:
                yield of(fps[:last], nodes[:last])
                fps, nodes = fps[last:], nodes[last:]
        if len(fps):
            yield of(fps, nodes)

    return run


def hamming_links(distinct: DataFrame, radius: int = RADIUS, leaf: int = 4096) -> DataFrame:
    """Links (a, b), a < b, that connect exactly the fingerprints (column fp, distinct) which lie within radius of each
    other, directly or through others. Not all pairs: within a shard each fingerprint is linked to one it reaches."""
    blocks, depth = radius + 1, 0
    nodes = distinct.select("fp", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("path"), F.col("fp").alias("rest"))
    found: DataFrame | None = None
    while nodes is not None:
        nodes = nodes.mapInArrow(_split(blocks, depth), SHARD)
        depth += 1
        sizes = stable(nodes.groupBy("node", "path").agg(F.count("*").alias("size")).where("size > 1"))
        large = sizes.where(F.col("size") > leaf)
        last = _left(64, blocks, 0, depth) < 2 * blocks
        more = not last and bool(large.take(1))
        small = sizes if not more else sizes.where(F.col("size") <= leaf)
        shards = nodes.join(small.select("node", "path"), ["node", "path"]).select("fp", "node")
        links = shards.repartition("node").sortWithinPartitions("node", "fp").mapInArrow(_links(radius), "a long, b long")
        found = links if found is None else found.unionByName(links)
        nodes = stable(nodes.join(large.select("node", "path"), ["node", "path"]).select("fp", "node", "path", "rest")) if more else None
    return found.distinct()


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links of a task, roots left out: ends take the least root at hand, again and again."""
    ends = [np.stack([np.asarray(c) for c in batch.columns]) for batch in batches if batch.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (open_ := root[a] != root[b]).any():
        x, y = root[a[open_]], root[b[open_]]
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while (up := root[root]).tolist() != root.tolist():
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    for k in range(0, len(moved), MOST_ROWS):
        part = moved[k : k + MOST_ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part], pa.int64()), pa.array(nodes[root[part]], pa.int64())], names=["node", "root"])


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each node of links (a, b) reaches. Up to AT_HAND links are united in a task, more
    by alternating large-star and small-star rounds; each round is kept in the shared folder."""
    links = stable(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if links.count() <= AT_HAND:
        return links.coalesce(1).mapInArrow(_unite, "node long, root long")
    before = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        star = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a != b").distinct()
        links = stable(star)
        state = links.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("decimal(38,0)")).alias("s"), F.max(F.xxhash64("a", "b")).alias("x")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).distinct()


def near_duplicates(documents: DataFrame, shingle: int = 3, radius: int = RADIUS, leaf: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document of (doc_id, text).

    fingerprint: 16 hexadecimal digits. component_id: the smallest doc_id among the documents reachable over links of
    at most radius differing bits, itself included. Null or wordless texts have fingerprint zero and link like any
    other; repeated rows give repeated rows; documents without id take part but name no component unless all lack it.
    """
    own = stable(fingerprints(documents, shingle))
    groups = stable(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return named(own, hamming_links(groups, radius, leaf), groups).select("doc_id", "fingerprint", "component_id")


def named(own: DataFrame, links: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(doc_id, tie, fingerprint, component_id, root) of (doc_id, tie, fp) by links between fps; groups, if at hand, has each
    fp's least doc_id. root, the least fp, tells components apart even if documents of several share their least doc_id."""
    if groups is None:
        groups = stable(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links)
    placed = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("fp", "component_id", "root")
    return own.join(named, "fp").select("doc_id", "tie", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def deduplicate(documents: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row of each component of near_duplicates; see first_of_each."""
    own = stable(fingerprints(documents, shingle))
    groups = stable(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return first_of_each(documents, named(own, hamming_links(groups, radius), groups))


def first_of_each(documents: DataFrame, found: DataFrame) -> DataFrame:
    """One row of documents for each root of found (doc_id, tie, root): that of the smallest doc_id, null only if no row has
    an id, then of the smallest text hash. Different texts that share a doc_id are told apart; of rows that share both one
    stays. Columns are untouched, whatever their names."""
    own, kept_id, kept_tie = fresh(documents, "dedup_tie", "dedup_id", "dedup_kept")
    rows = found.groupBy("root", "doc_id", "tie").agg(F.count("*").alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "n")).alias("x"))
    kept = stable(least.select(F.col("x.doc_id").alias(kept_id), F.col("x.tie").alias(kept_tie), F.col("x.n").alias("n")))
    tied = documents.withColumn(own, text_tie())
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_tie))
    out = tied.join(kept.where("n = 1").drop("n"), same, "left_semi")
    repeated = kept.where("n > 1").drop("n")
    if repeated.take(1):  # else the texts need no second shuffle
        out = out.unionByName(tied.join(repeated, same, "left_semi").dropDuplicates(["doc_id", own]))
    return out.select(*documents.columns)
