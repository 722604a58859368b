"""Document fingerprints: Merkle trees over sections, paragraphs and sentences.

Leaves are sentences (long ones cut where a word's hash says), their parents paragraphs (lines), theirs sections (runs
of paragraphs, ended by a blank line or where a paragraph's hash says, so that an edit moves no cut beyond it). The
root tells equality; walking down unequal branches tells which leaves two documents share and where they differ.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, scratch_path, small_batches, tabled

SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
LONG = 400
SECTION_BITS, CUT_BITS = 3, 7


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _leaves(paragraph: str) -> list[str]:
    out = []
    for x in SENTENCE.findall(paragraph):
        if len(x) <= LONG:
            out.append(x)
            continue
        held = ""
        for word in re.findall(r"\S*\s*", x):
            held += word
            if held and (len(held) > 4 * LONG or hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=1).digest()[0] & CUT_BITS == 0):
                out.append(held)
                held = ""
        if held:
            out.append(held)
    return out


Paragraph = tuple[bytes, list[tuple[bytes, int]]]


class Tree:
    """sections: (hash, paragraphs) in order; a paragraph is (hash, leaves), a leaf (hash, code points). root: hexadecimal.
    A tree needs no text once it is made: packed() and unpacked() store it."""

    __slots__ = ("sections", "root")

    def __init__(self, text: str = ""):
        self.sections: list[tuple[bytes, list[Paragraph]]] = []
        held: list[Paragraph] = []
        for paragraph in text.splitlines(keepends=True):
            own = [(_hash(x.encode("utf-8", "surrogatepass")), len(x)) for x in _leaves(paragraph)]
            node = _hash(b"p" + b"".join([h for h, _ in own]))
            held.append((node, own))
            if node[0] & SECTION_BITS == 0 or not paragraph.strip():
                self._close(held)
                held = []
        if held:
            self._close(held)
        self._root()

    def _close(self, paragraphs: list[Paragraph]) -> None:
        self.sections.append((_hash(b"s" + b"".join([h for h, _ in paragraphs])), paragraphs))

    def _root(self) -> None:
        self.root = _hash(b"r" + b"".join([h for h, _ in self.sections])).hex()

    def packed(self) -> bytes:
        """Counts of paragraphs by section and of leaves by paragraph, then the leaves; inner hashes follow from these."""
        out = [struct.pack("<I", len(self.sections))]
        for _, paragraphs in self.sections:
            out.append(struct.pack(f"<I{len(paragraphs)}I", len(paragraphs), *[len(own) for _, own in paragraphs]))
        out += [struct.pack("<16sI", h, n) for _, paragraphs in self.sections for _, own in paragraphs for h, n in own]
        return b"".join(out)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        tree, at, shape = cls(), 4, []
        for _ in range(struct.unpack_from("<I", data)[0]):
            n = struct.unpack_from("<I", data, at)[0]
            shape.append(struct.unpack_from(f"<{n}I", data, at + 4))
            at += 4 + 4 * n
        leaves = struct.iter_unpack("<16sI", data[at:])
        for counts in shape:
            own = [[next(leaves) for _ in range(n)] for n in counts]
            tree._close([(_hash(b"p" + b"".join([h for h, _ in x])), x) for x in own])
        tree._root()
        return tree

    def size(self) -> int:
        return sum(n for _, paragraphs in self.sections for _, own in paragraphs for _, n in own)


def _apart(a: Tree, b: Tree) -> tuple[list[tuple[int, bytes, int]], list[tuple[int, bytes, int]]]:
    """The leaves (start, hash, code points) of each tree that no equal branch of the other covers: sections with equal
    hashes are left out whole, of the others paragraphs with equal hashes, of those leaves."""
    both = Counter(h for h, _ in a.sections) & Counter(h for h, _ in b.sections)
    rest: list[list[tuple[int, Paragraph]]] = []
    for tree in (a, b):
        left, at, own = Counter(both), 0, []
        for h, paragraphs in tree.sections:
            same = left[h] > 0
            left[h] -= same
            for x in paragraphs:
                if not same:
                    own.append((at, x))
                at += sum(n for _, n in x[1])
        rest.append(own)
    both = Counter(x[0] for _, x in rest[0]) & Counter(x[0] for _, x in rest[1])
    found: list[list[tuple[int, bytes, int]]] = []
    for own in rest:
        left, leaves = Counter(both), []
        for at, (h, parts) in own:
            if left[h] > 0:
                left[h] -= 1
                continue
            for leaf, n in parts:
                leaves.append((at, leaf, n))
                at += n
        found.append(leaves)
    both = Counter(h for _, h, _ in found[0]) & Counter(h for _, h, _ in found[1])
    out = []
    for leaves in found:
        left, own = Counter(both), []
        for x in leaves:
            if left[x[1]] > 0:
                left[x[1]] -= 1
            else:
                own.append(x)
        out.append(own)
    return out[0], out[1]


def likeness(a: Tree, b: Tree) -> float:
    """Code points in branches and leaves that both trees have, over all code points of both: 1 for equal trees."""
    if a.root == b.root:
        return 1.0
    every = a.size() + b.size()
    return 1 - sum(n for x in _apart(a, b) for _, _, n in x) / max(1, every)


def edits(a: Tree, b: Tree) -> list[tuple[str, int, int]]:
    """('-', start, stop) in code points for each run of leaves that only a has and ('+', start, stop) for those that only
    b has."""
    out: list[tuple[str, int, int]] = []
    if a.root == b.root:
        return out
    for sign, leaves in zip("-+", _apart(a, b), strict=True):
        for at, _, n in leaves:
            if out and out[-1][0] == sign and out[-1][2] == at:
                out[-1] = (sign, out[-1][1], at + n)
            else:
                out.append((sign, at, at + n))
    return out


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many first code points of following, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = [("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()), ("tree", T.BinaryType())]
RESULT = T.StructType([T.StructField(n, t) for n, t in FIELDS])
STEP = T.StructType([T.StructField("kind", T.StringType()), T.StructField("part", T.LongType()), *RESULT.fields, T.StructField("text", T.StringType())])
#: Documents that a worker holds at a time, besides the one before them.
AT_ONCE = 64
#: Rows of documents that are decoded at a time: vectors of thousands of texts are arrays of many MB each, which make the JVM's heap grow.
READ_AT_ONCE = 512
#: So many ranges' steps make a file (they are about a tenth of the texts), and a task compares so many pairs across ranges.
RANGES_A_FILE, PAIRS_A_TASK = 8, 64


def _compare(doc_id: int | None, text: str, tree: Tree, following: str, next_tree: Tree, keep_trees: bool) -> tuple:
    changed = edited(text, following)
    other = Tree(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), tree.root, other.root, likeness(tree, other), likeness(tree, next_tree), tree.packed() if keep_trees else None)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def trees(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, tree) of each document of (doc_id, text), of any type of doc_id; tree is for Tree.unpacked.
    Null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                made = [Tree(x or "") for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.root for x in made], pa.string()), pa.array([x.packed() for x in made], pa.binary())], names=["doc_id", "fingerprint", "tree"])

    kept = documents.select("doc_id", "text")
    return kept.mapInArrow(run, T.StructType([kept.schema["doc_id"], T.StructField("fingerprint", T.StringType()), T.StructField("tree", T.BinaryType())]))


def compare_with_next(documents: DataFrame, keep_trees: bool = True) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, tree) of each document of
    (doc_id, text); its next is the document below it in descending doc_id order, the last one's the first. Both
    likenesses come from the trees alone. Without keep_trees the trees are built and compared, but not stored: tree is null.

    Equal or null ids lie in the order of their texts' hashes, null last. Null text: empty. A single document is its own
    next; an empty table gives no rows; extra columns, whatever their names, are not read. A long text costs time and
    memory in proportion to its length. Texts are dealt once into ranges of doc_id; a range compares its own neighbours
    and hands on its first and last document, which are joined by range, so nothing is sorted in one task."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("merkle")
        part, before = TaskContext.get().partitionId(), None
        nothing = (None,) * 7
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                rows = []
                batch = whole.slice(at, AT_ONCE)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    text = text or ""
                    tree = Tree(text)
                    rows.append(("head", part, None, *nothing, text) if before is None else ("row", part, *_compare(*before, text, tree, keep_trees), None))
                    before = (doc_id, text, tree)
                yield _batch(rows, STEP)
        if before is not None:
            yield _batch([("open", part, before[0], *nothing, before[1])], STEP)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                part, doc_id, text, following = (whole.column(i)[at].as_py() for i in range(4))
                yield _batch([("row", part, *_compare(doc_id, text, Tree(text), following, Tree(following), keep_trees), None)], STEP)

    order = (F.col("doc_id").desc_nulls_last(), F.col("merkle_tie").asc())
    dealt = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("merkle_tie"))
    ranges = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    spark, path = documents.sparkSession, scratch_path(documents.sparkSession, "merkle-steps")
    ranges_most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark, AT_ONCE, READ_AT_ONCE):
        # few files and tasks, as each file that is written starts processes
        steps = tabled(ranges.mapInArrow(within, STEP).repartition(-(-ranges_most // RANGES_A_FILE)), f"{path}/within")
        heads = steps.where("kind = 'head'").select("part", F.col("text").alias("following"))
        parts = heads.select("part").select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next_part"))  # a row for each range
        opened = steps.where("kind = 'open'").select("part", "doc_id", "text").join(parts, "part")
        met = opened.join(heads.withColumnRenamed("part", "next_part"), "next_part").select("part", "doc_id", "text", "following")
        tabled(met.coalesce(-(-ranges_most // PAIRS_A_TASK)).mapInArrow(across, STEP), f"{path}/across")
    return spark.read.schema(STEP).parquet(f"{path}/within", f"{path}/across").where("kind = 'row'").select(*RESULT.names)
