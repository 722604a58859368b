"""Near copies by the Jaccard similarity of word shingles: SimHash finds candidates, MinHash bands find those that SimHash's
radius does not reach, and the shingle sets decide.

A text is its set of shingle hashes; equal sets are one node. Nodes whose SimHash is equal or within RADIUS bits are candidates,
by the exact search of simhash.hamming_links. At similarity 0.8 a SimHash differs in 9 bits in the median, where blocks of bits
prune nothing, so wider pairs come from MinHash: nodes that agree in the rows of one of the bands share a bucket: at similarity
0.8 that happens with a chance of 0.9996. All pairs of a small bucket are candidates. A large one gives pairs with a few pivots,
and its members meet again in buckets over more rows, so that a group of near copies makes rows in proportion to its size.
Candidates are verified family by family, SimHash's first, and only those that no verified links connect so far; in families
of many nodes this is done in rounds.
What pivots may leave open is settled exactly: the members of large buckets that links do not make one component are joined
by prefix and position filters, which lose no similar pair (see `crowded_pairs`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, release, scratch_path, small_batches, stable, tabled
from .simhash import SEED, components, hamming_links, named, of_hashes, text_tie

SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits of SimHash up to which nodes are candidates by it; five blocks of 12 or 13 bits, which split deep enough at once.
RADIUS = 4
BANDS, ROWS = 20, 5
#: Bands of MinHash that a bucket of each level agrees in: a band and the next ones.
LEVELS = (1, 2, 4)
#: All pairs of buckets of up to so many nodes are candidates.
SMALL = 16
#: Constants whose bitwise difference to a node orders the nodes; a bucket's least by each is a pivot.
PIVOTS = (0, -1, 0x1E3779B97F4A7C15, -0x40A7B892E31B1A47)
#: The bands whose first pivots each round takes, after SimHash's round; the last round takes all that is left.
ROUNDS = ((0, 2), (2, BANDS))
LAST = len(ROUNDS) + 1
#: Candidates' families of up to so many nodes are verified in one place, where each text comes once.
FAMILY = 128
#: Pairs of a node in larger ones that are verified in one place.
CELL = 64
#: Bits of the filter by which texts of no candidate stay where they are: 8 a node, within these powers of two.
FILTER = (16, 25)
#: Counters by which a crowd's shingles are ordered, rarest first; a fixed size, so that collisions cost time and no pair.
SLOTS = 1 << 18
#: Members of a shingle's list that meet at once; longer lists meet block by block.
BLOCK = 512
#: Pairs that a task writes at a time.
MOST_PAIRS = 100_000
#: A task remembers so many sets that it has written.
MOST_SEEN = 200_000
#: Rows that a worker takes and writes at a time: texts and sets are wide, and a batch of them is held on both sides.
AT_ONCE = 512

_DRAW = np.random.default_rng(SEED)
_XOR, _ODD = _DRAW.integers(0, 2**64, BANDS * ROWS, np.uint64), _DRAW.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of word shingles, words as for simhash.fingerprint. Texts of fewer words are one
    shingle; without words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    parts = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.unique(np.array([digest(join(p), SEED) for p in parts], np.uint64))


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """The key of a set's bucket in each band."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[at : at + 4096, None] ^ _XOR) * _ODD).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64)


def set_hash(hashes: np.ndarray) -> int:
    """What equal sets share: the id of a node."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        seen: set[int] = set()
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            fps, sizes, sims, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_set(text, shingle)
                fp = set_hash(hashes)
                fps.append(fp)
                fresh = len(hashes) > 0 and fp not in seen  # equal sets are written once by a task
                if fresh:
                    if len(seen) >= MOST_SEEN:
                        seen = set()
                    seen.add(fp)
                sizes.append(len(hashes))
                sims.append(of_hashes(hashes) if fresh else 0)
                keys.append(bucket_keys(hashes).view(np.int64).tolist() if fresh else None)
            longs = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (fps, sizes, sims)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *longs, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "tie", "fp", "n", "sim", "keys"])
        del seen
        release()  # a worker idles while later stages run in the JVM

    return run


def _read_hashes(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, np.uint64)


def _read_text(shingle: int) -> Callable[[bytes], np.ndarray]:
    """A text as _texts stores it, as its set."""

    def read(stored: bytes) -> np.ndarray:
        size = int.from_bytes(stored[:4], "little")
        return shingle_set(pa.Codec("zstd").decompress(stored[4:], size, asbytes=True).decode("utf-8", "surrogatepass"), shingle)

    return read


def _texts(shingle: int, bits: np.ndarray):
    """(fp, text packed) of the sets that the filter lets pass; once by a task, as long as it remembers."""
    shift = np.uint64(64 - (8 * len(bits)).bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = pa.Codec("zstd", compression_level=1), set()
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            fps, packed = [], []
            for text in batch.column(0).to_pylist():
                fp = set_hash(shingle_set(text, shingle))
                slot = fp >> int(shift)
                if fp in seen or not bits[slot >> 3] >> (slot & 7) & 1:
                    continue
                if len(seen) >= MOST_SEEN:
                    seen = set()
                seen.add(fp)
                raw = (text or "").encode("utf-8", "surrogatepass")
                fps.append(fp)
                packed.append(len(raw).to_bytes(4, "little") + codec.compress(raw, asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()), pa.array(packed, pa.binary())], names=["fp", "packed"])
        del seen
        release()

    return run


def _filter(nodes: DataFrame) -> np.ndarray:
    """Bits of which those of the leading bits of each fp are set: a filter of a size that the number of nodes gives, up to 4 MB."""
    power = min(max((8 * nodes.count()).bit_length(), FILTER[0]), FILTER[1])
    slot = F.shiftrightunsigned("fp", 64 - power)
    words = nodes.groupBy(F.shiftright(slot, 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(32)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (power - 5), "<u4")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _tabled(df: DataFrame, label: str) -> DataFrame:
    """The rows of df as a table in the shared folder, whose size Spark knows: it is broadcast only below the session's
    threshold, else joined by a shuffle."""
    return tabled(df, scratch_path(df.sparkSession, label))


def _edges(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _fits(n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be as similar."""
    return F.least(n, m) >= F.greatest(n, m) * (similarity - 1e-9)


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes (fp, sim) with equal SimHash or with SimHashes that hamming_links links, in proportion to both."""
    groups = _tabled(nodes.groupBy("sim").agg(F.min("fp").alias("least")), "shingle-sims")
    same = nodes.join(groups, "sim").where("fp != least").select(*_edges(F.col("fp"), F.col("least")))
    links = hamming_links(groups.select(F.col("sim").alias("fp")), RADIUS)
    for x in "ab":
        links = links.join(groups.select(F.col("sim").alias(x), F.col("least").alias(f"least_{x}")), x)
    return same.unionByName(links.select(*_edges(F.col("least_a"), F.col("least_b"))))


def band_pairs(nodes: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(a, b, round), a < b: pairs of nodes (fp, n, keys) that share a bucket, where n is a set's size; and (key, fp) of the
    large buckets, of whose pairs these are only some."""
    rows = nodes.select("fp", "n", F.posexplode("keys").alias("band", "key"))
    found = crowds = None
    for level in range(len(LEVELS)):
        bucket = Window.partitionBy("key")
        pivots = [F.min(F.col("fp").bitwiseXOR(F.lit(p))).over(bucket).bitwiseXOR(F.lit(p)).alias(f"p{i}") for i, p in enumerate(PIVOTS)]
        shared = _tabled(rows.select("*", F.count("*").over(bucket).alias("size"), *pivots).where("size > 1"), "shingle-buckets")
        turn = F.lit(LAST)
        for k, (lo, hi) in enumerate(ROUNDS):
            if level == 0:
                turn = F.when((F.col("band") >= lo) & (F.col("band") < hi), F.lit(k + 1)).otherwise(turn)
        first = shared.where("fp != p0").select(*_edges(F.col("fp"), F.col("p0")), turn.alias("round"))
        large = shared.where(F.col("size") > SMALL)
        crowds = large.select("key", "fp") if crowds is None else crowds
        others = large.select("fp", F.explode(F.array(*[f"p{i}" for i in range(1, len(PIVOTS))])).alias("p")).where("fp != p").select(*_edges(F.col("fp"), F.col("p")), F.lit(LAST).alias("round"))
        lists = shared.where((F.col("size") > 2) & (F.col("size") <= SMALL)).groupBy("key").agg(F.collect_list(F.struct("fp", "n")).alias("xs"))
        pairs = lists.select("xs", F.explode("xs").alias("x")).select("x", F.explode("xs").alias("y")).where("x.fp < y.fp").where(_fits(F.col("x.n"), F.col("y.n"), similarity))
        pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), F.lit(LAST).alias("round"))
        own = first.unionByName(others).unionByName(pairs)
        found = own if found is None else found.unionByName(own)
        if level + 1 == len(LEVELS) or not large.take(1):
            break
        keys = [F.col("keys")[F.pmod(F.col("band") + k, F.lit(BANDS))] for k in range(LEVELS[level + 1])]
        rows = large.select("fp", "n", "band").join(nodes.select("fp", "keys"), "fp").select("fp", "n", "band", F.xxhash64("band", *keys).alias("key"))
    return found, crowds


def candidates(nodes: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(a, b, round), a < b: SimHash's pairs of nodes (fp, n, sim, keys) in round 0, those of the bands later; and band_pairs'
    large buckets."""
    pairs, crowds = band_pairs(nodes, similarity)
    both = simhash_pairs(nodes).withColumn("round", F.lit(0)).unionByName(pairs)
    return _tabled(both.groupBy("a", "b").agg(F.min("round").alias("round")), "shingle-pairs"), crowds


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % SLOTS


def _slot_counts(read: Callable[[bytes], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(counts, _slots(read(x)), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["slot", "n"])

    return run


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The rarest shingles of a set, of which any set so similar holds at least one among its own. Every set is ordered by
    the same rule, and of n shingles a similar set has at least similarity * n in common."""
    ranked = hashes[np.lexsort((hashes, counts[_slots(hashes)]))]
    return ranked[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1]


def _prefixes(counts: np.ndarray, similarity: float, read: Callable[[bytes], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            sets = [read(x) for x in batch.column(2).to_pylist()]
            heads = [prefix(x, counts, similarity) for x in sets]
            if heads:
                sizes = np.array([len(x) for x in heads])
                of = [np.repeat(np.asarray(batch.column(i)), sizes) for i in (0, 1)]
                at = np.concatenate([np.arange(k) for k in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.concatenate(heads).view(np.int64), *of, np.repeat([len(x) for x in sets], sizes), at)], names=["token", "fp", "root", "n", "at"])

    return run


def _meet(similarity: float):
    """Of rows (token, low, high, block, fp, root, n, at) sorted by the first three: the pairs of each cell that differ in root
    and pass the size and position filters; a cell of two blocks pairs one with the other."""
    need = (similarity - 1e-9) / (1 + similarity)

    def of(block: np.ndarray, fp: np.ndarray, root: np.ndarray, n: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
        fit = (np.minimum((n - at)[x][:, None], (n - at)[y]) >= need * (n[x][:, None] + n[y])) & (root[x][:, None] != root[y])
        i, j = np.nonzero(fit)
        a, b = fp[x[i]], fp[y[j]]
        once = a < b if low == high else slice(None)
        return np.minimum(a, b)[once], np.maximum(a, b)[once]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: np.ndarray | None = None
        for batch in _and_last(batches):
            if batch is not None:
                rows = np.stack([np.asarray(c) for c in batch.columns])
                left = rows if left is None else np.concatenate([left, rows], axis=1)
            if left is None or not left.shape[1]:
                continue
            change = np.flatnonzero((left[:3, 1:] != left[:3, :-1]).any(0)) + 1
            ends = change.tolist() + ([left.shape[1]] if batch is None else [])  # the last cell may go on in the next batch
            start, out, size = 0, [], 0
            for end in ends:
                _, low, high, *rest = left[:, start:end]
                out.append(of(*rest, int(low[0]), int(high[0])))
                size, start = size + len(out[-1][0]), end
                if size and (size > MOST_PAIRS or end == ends[-1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                    out, size = [], 0
            left = left[:, start:]

    return run


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def crowded_pairs(crowds: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, read: Callable[[bytes], np.ndarray] = _read_hashes) -> DataFrame | None:
    """(a, b): the pairs that large buckets (key, fp) may still hold, None if there are none; roots (node, root) are the
    components so far, sets (fp, packed) the shingles, as read takes them; rows of it may repeat.

    The members of buckets with more than one root are a crowd. Two similar sets share a shingle among their rarest ones, and
    at the first one that they share, enough shingles follow in both; every pair of the crowd that differs in root and meets
    both conditions is kept, so no similar one is lost. A list of a shingle's holders is cut into blocks, and each two
    blocks meet in a task of their own: no task holds over two blocks' rows, however common the shingle.
    """
    placed = crowds.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    open_ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    members = _tabled(placed.join(open_, "key").select("fp", "root").distinct(), "shingle-crowds")
    if not members.take(1):
        return None
    crowd = _tabled(members.join(sets.toDF("fp", "packed"), "fp").dropDuplicates(["fp"]).select("fp", "root", "packed"), "shingle-crowd")
    counts = np.zeros(SLOTS, np.int64)
    for row in crowd.select("packed").mapInArrow(_slot_counts(read), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # SLOTS rows at most
        counts[row.slot] = row.n
    heads = stable(crowd.mapInArrow(_prefixes(counts, similarity, read), "token long, fp long, root long, n long, at long"))
    lists = heads.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    rows = heads.join(lists.select("token", "blocks"), "token").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp", "root", "n", "at")
    met = cells.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(_meet(similarity), "a long, b long")
    return met.distinct()


def _judge(similarity: float, read: Callable[[bytes], np.ndarray], spare: bool):
    """Of rows (cell, round, a, b, packed) sorted by the first four, those of a cell's sets (a, packed) before its pairs: the similar
    pairs; spare: without those that earlier ones of their cell connect."""

    def find(root: dict[int, int], i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        cell, stored, sets, root = None, {}, {}, {}
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            kept = []
            for place, turn, a, b, packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if place != cell:
                    cell, stored, sets, root = place, {}, {}, {}
                if turn < 0:
                    stored[a] = packed
                    continue
                if spare and find(root, a) == find(root, b):
                    continue
                for x in (a, b):
                    if x not in sets:
                        sets[x] = read(stored[x])
                x, y = sets[a], sets[b]
                if min(len(x), len(y)) < (similarity - 1e-9) * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= (similarity - 1e-9) * (len(x) + len(y) - both):
                    kept.append((a, b))
                    root[find(root, a)] = find(root, b)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])
        del stored, sets, root
        release()

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, read: Callable[[bytes], np.ndarray] = _read_hashes) -> DataFrame:
    """The pairs (a, b) whose sets (fp, packed) are at least so similar. If pairs have (round, cell), pairs of a cell are judged in
    one place by rounds, and those that others connect are left out; else a node's pairs are, CELL at a time, and none is."""
    spare = "cell" in pairs.columns
    if not spare:
        pairs = _tabled(pairs.select("a", "b"), "shingle-todo")
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).alias("parts")).where("parts > 1")  # few nodes have so many pairs
        split = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
        # read twice, as pairs and as what they need; joined once
        pairs = _tabled(pairs.join(many, "a", "left").select("a", "b", F.lit(0).alias("round"), F.xxhash64("a", split).alias("cell")), "shingle-cells")
    needs = pairs.select("cell", F.explode(F.array("a", "b")).alias("fp")).distinct()
    told = needs.join(sets.toDF("fp", "packed"), "fp").select("cell", F.lit(-1).alias("round"), F.col("fp").alias("a"), F.lit(0).cast("long").alias("b"), "packed")
    rows = told.unionByName(pairs.select("cell", "round", "a", "b", F.lit(None).cast("binary").alias("packed")))
    return rows.repartition("cell").sortWithinPartitions("cell", "round", "a", "b").mapInArrow(_judge(similarity, read, spare), "a long, b long")


def similar_links(documents: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that connect the similar nodes (fp, n, sim, keys) of documents, no others. Only candidates' texts travel,
    packed, and become sets again where they are compared, as hashes do not compress. The texts are read a second time."""
    pairs, crowds = candidates(nodes, similarity)
    families = _tabled(components(pairs), "shingle-families")
    bits = _filter(families.select(F.explode(F.array("node", "root")).alias("fp")).distinct())
    texts = _tabled(documents.select("text").mapInArrow(_texts(shingle, bits), "fp long, packed binary"), "shingle-texts")
    read = _read_text(shingle)
    sizes = families.groupBy("root").agg((F.count("*") + 1).alias("size"))
    placed = families.join(sizes, "root").unionByName(sizes.select("root", F.col("root").alias("node"), "size"))
    within = _tabled(pairs.join(placed.withColumnRenamed("node", "a"), "a"), "shingle-placed")
    links = stable(verified(within.where(F.col("size") <= FAMILY).select("a", "b", "round", F.col("root").alias("cell")), texts, similarity, read))
    wide = within.where(F.col("size") > FAMILY).select("a", "b", "round")
    if wide.take(1):
        stars = roots = None
        for k in range(LAST + 1):
            todo = wide.where(F.col("round") == k).select("a", "b")
            if roots is not None:
                for x in "ab":
                    todo = todo.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
                todo = todo.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
            new = verified(todo, texts, similarity, read)
            roots = stable(components(new if stars is None else stars.unionByName(new)))
            stars = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))  # a star for each component says as much
        links = links.unionByName(stars)
    if not crowds.take(1):
        return links
    rest = crowded_pairs(crowds, stable(components(links)), texts, similarity, read)
    return links if rest is None else links.unionByName(stable(verified(rest, texts, similarity, read)))


def near_copies(documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tie, fingerprint, component_id, root) as simhash.named, linked by shingle similarity; texts without words are
    equal. Of a text a worker holds its shingles' hashes; an empty table gives no rows."""
    spark = documents.sparkSession
    path = scratch_path(spark, "shingles")
    kept = documents.select("doc_id", "text", text_tie().alias("tie"))
    added = T.StructType.fromDDL("tie long, fp long, n long, sim long, keys array<long>")
    with small_batches(spark, AT_ONCE):  # everything that workers do is done within
        kept.mapInArrow(_sketch(shingle), T.StructType([kept.schema["doc_id"], *added.fields])).write.parquet(path)
        sketched = spark.read.parquet(path)
        nodes = _tabled(sketched.where("keys IS NOT NULL").select("fp", "n", "sim", "keys").dropDuplicates(["fp"]), "shingle-nodes")
        links = similar_links(documents, nodes, shingle, similarity)
    return named(sketched.select("doc_id", "tie", "fp"), links)
