"""Token ids in a binary format: Simple-8b words with escapes, in blocks that carry per-document offsets.

Format. A file set is a Parquet table with one row per block; `payload` is binary:

    header   8 little-endian int64: magic, documents, words, ids, 0, 0, 0, 0
    offsets  per document, int64: word offset, id count
    words    uint64 little-endian

A word has a selector in its top 4 bits and 60 bits of ids, the first id lowest. Selector 15 is the escape: the
next word holds one id of up to 64 bits as it is. A document starts on a word, so any document decodes alone and
documents can be packed where they are tokenised, before anything is shuffled.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, held, scratch_path, small_batches, tabled

#: Fixed values of the format: ids per word and bits per id, by selector; 15 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BARRIER = 14
MAGIC = 0x4F524F38
END_ID = 2


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, as uint8; of ids over 2 ** 53 perhaps one too many."""
    if len(ids) and ids.max() < len(_LENGTHS):
        return _LENGTHS[ids.astype(np.int64)]
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


_LENGTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def pack_flat(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Simple-8b words (uint64) of documents' ids, which lie end to end, counts of them each: at each place the
    selector that takes most ids, ids of over 60 bits escaped; and each document's end among the words. Documents are
    packed together, with a barrier after each that no word crosses."""
    total = len(ids) + len(counts)
    barrier = np.cumsum(counts + 1) - 1
    values = np.zeros(total, np.uint64)
    real = np.ones(total, bool)
    real[barrier] = False
    values[real] = ids
    ids = values
    bits = _bit_lengths(ids)
    bits[barrier] = 255
    most = bits.copy()  # of the next ids, as many as the selector takes
    choice = np.full(total, ESCAPE, np.uint8)
    seen = 1
    for selector in range(len(COUNTS) - 1, -1, -1):
        count = COUNTS[selector]
        if count > total:
            break
        while seen < count:
            np.maximum(most[: total - seen], bits[seen:], out=most[: total - seen])
            seen += 1
        fits = most[: total - count + 1] <= WIDTHS[selector]
        if not fits.any():
            break
        choice[: total - count + 1][fits] = selector
    choice[barrier] = BARRIER
    step = bytes(np.array(COUNTS + (1, 1), np.uint8)[choice])
    starts, at = [], 0
    push = starts.append
    while at < total:
        push(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    kinds = choice[starts]
    width = np.where(kinds == ESCAPE, 2, (kinds != BARRIER).astype(np.int64))
    places = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for selector in np.unique(kinds).tolist():
        if selector == BARRIER:
            continue
        here = kinds == selector
        first, place = starts[here], places[here]
        if selector == ESCAPE:
            words[place] = np.uint64(ESCAPE << 60)
            words[place + 1] = ids[first]
            continue
        word = np.full(len(first), selector << 60, np.uint64)
        for k in range(COUNTS[selector]):
            word |= ids[first + k] << np.uint64(k * WIDTHS[selector])
        words[place] = word
    return words, places[kinds == BARRIER]


def pack_documents(documents: list[np.ndarray]) -> list[np.ndarray]:
    """The Simple-8b words of each document's ids; see pack_flat."""
    if not documents:
        return []
    words, ends = pack_flat(np.concatenate(documents), np.array([len(x) for x in documents], np.int64))
    return np.split(words, ends[:-1])


def pack(ids: np.ndarray) -> np.ndarray:
    """The Simple-8b words of one document's ids."""
    return pack_documents([np.asarray(ids, np.uint64)])[0]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of Simple-8b words, all words of one selector at a time."""
    kinds = (words >> np.uint64(60)).astype(np.int8)
    escapes = np.flatnonzero(kinds == ESCAPE)
    raw = np.zeros(len(words), bool)
    last = -1
    for at in escapes.tolist():  # the word after an escape is an id, whatever its top bits say
        if at > last:
            raw[at + 1] = True
            last = at + 1
    coded = np.flatnonzero(~raw)
    kinds = kinds[coded]
    ends = np.cumsum(np.array(COUNTS + (0, 1), np.int64)[kinds])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector in np.unique(kinds).tolist():
        here = kinds == selector
        at = coded[here]
        if selector == ESCAPE:
            out[ends[here] - 1] = words[at + 1]
            continue
        count, width = COUNTS[selector], WIDTHS[selector]
        mask = np.uint64((1 << width) - 1)
        first = ends[here] - count
        for k in range(count):
            out[first + k] = (words[at] >> np.uint64(k * width)) & mask
    return out


def write_block(documents: list[tuple[bytes, int]]) -> bytes:
    """documents: (Simple-8b words, id count) in order."""
    sizes = np.array([len(w) // 8 for w, _ in documents], np.int64)
    counts = np.array([n for _, n in documents], np.int64)
    offsets = np.cumsum(sizes) - sizes
    header = np.array([MAGIC, len(documents), sizes.sum(), counts.sum(), 0, 0, 0, 0], "<i8")
    return b"".join([header.tobytes(), np.stack([offsets, counts], 1).astype("<i8").tobytes(), *(w for w, _ in documents)])


def read_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block, and the id count of each document."""
    header = np.frombuffer(payload, "<i8", 8)
    if header[0] != MAGIC:
        raise ValueError("not a block of token ids")
    documents, n_words = int(header[1]), int(header[2])
    index = np.frombuffer(payload, "<i8", 2 * documents, 64).reshape(documents, 2)
    ids = unpack(np.frombuffer(payload, "<u8", n_words, 64 + 16 * documents))
    return ids, index[:, 1]


#: Unicode white space, as the byte-level pattern takes it.
SPACE = "\\t\\n\\x0b\\x0c\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: ASCII marks that the byte-level pattern joins to nothing but marks; the apostrophe may join letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that libraries of different Unicode versions may not agree on.
LATE_LETTER = "[^\\x00-\\x{4ff}]"
#: Stands before a piece that no space precedes.
BARE = "\x01"
#: Longer pieces are not remembered.
LONGEST = 64


def _byte_letters() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others in order
    from U+0100 (a published convention)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {x: x for x in shown} | {x: 256 + i for i, x in enumerate(x for x in range(256) if x not in shown)}


def _gathered(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of rows of a ragged table, end to end, and where each row's end."""
    starts = ends[rows]
    sizes = ends[rows + 1] - starts
    upto = np.cumsum(sizes)
    return flat[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)], upto


def _listed(strings: pa.Array) -> list[str]:
    """As to_pylist, but several times as fast; the strings have no NUL."""
    if not len(strings):
        return []
    ends = pa.array([0, len(strings)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, strings), pa.scalar("\0", strings.type))[0].as_py().split("\0")


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library, with what words give remembered.

    The library's pre-tokenizer never joins a space and a following non-space with what stands before them, and a line
    feed between non-spaces is a piece of its own, so a text without two white-space characters side by side is the
    concatenation of its pieces, each with its leading space. Other texts, and those with a special token's string, go
    to the library whole. Arrow finds a batch's distinct pieces and parts them into a word and the marks after it, which
    the pre-tokenizer always parts; the library's model gives the ids of words that the worker has not seen, and the
    library those of other pieces. What is remembered is bounded by entries and, as long keys are not kept, by bytes.

    A key is a piece or word; a space stands before it unless it begins with BARE.
    """

    def __init__(self, path: str, remember: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([f"[{SPACE}][{SPACE}]", "\\x00", BARE, *map(re.escape, special)])
        self.width = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        stages = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer, self.tokenizer.post_processor
        if type(stages[0]).__name__ != "ByteLevel" or not stages[0].use_regex or stages[0].add_prefix_space or stages[1] is not None:
            raise ValueError("not a byte-level tokenizer that splits by its pattern")
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        """Row 0 is empty, rows 1 to 128 are the ASCII characters without a space before them."""
        self.rows: dict[str, int] = {}
        self.flat, self.ends = array(self.width), array("q", [0, 0])
        for x in range(128):
            self.added([i for y in self.library([chr(x)]) for i in y])

    def library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def added(self, ids: list[int]) -> int:
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        return len(self.ends) - 2

    def words(self, keys: list[str]) -> list[int]:
        """The rows of what the pre-tokenizer takes as one token each."""
        out = list(map(self.rows.get, keys))
        if None not in out:
            return out
        tokenize, letters, flat, ends, space = self.model.tokenize, self.letters, self.flat, self.ends, chr(self.letters[32])
        fresh, ids, row = {}, [], len(ends) - 1
        for i, known in enumerate(out):
            if known is None:
                key = keys[i]
                shown = key[1:] if key[0] == BARE else space + key
                if not key.isascii():
                    shown = (key[1:] if key[0] == BARE else " " + key).encode().decode("latin-1").translate(letters)
                ids += [x.id for x in tokenize(shown)]
                ends.append(len(flat) + len(ids))
                out[i] = row
                if len(key) <= LONGEST:
                    fresh[key] = row
                row += 1
        flat.extend(ids)
        self.rows.update(fresh)
        return out

    def piece(self, key: str) -> int:
        """The row of any piece."""
        row = self.rows.get(key)
        if row is None:
            text = key[1:] if key[:1] == BARE else key if key == "\n" else " " + key
            row = self.added(self.library([text])[0]) if text else 0
            if len(key) <= LONGEST:
                self.rows[key] = row
        return row

    def distinct(self, keys: pa.Array) -> np.ndarray:
        """The rows of distinct pieces, two each: a word's or other piece's, and that of the marks after a word."""
        out = np.zeros((len(keys), 2), np.int64)
        words = pc.utf8_rtrim(keys, MARKS)
        good = pc.and_(pc.utf8_is_alpha(pc.utf8_ltrim(words, BARE)), pc.invert(pc.match_substring_regex(words, LATE_LETTER)))
        right = good.to_numpy(zero_copy_only=False)
        found = words.filter(good).dictionary_encode()
        out[right, 0] = np.array(self.words(_listed(found.dictionary)), np.int64)[found.indices.to_numpy()]
        marks = pc.subtract(pc.binary_length(keys), pc.binary_length(words)).to_numpy()
        one = right & (marks == 1)
        offsets = np.frombuffer(keys.buffers()[1], np.int64, len(keys) + 1, 8 * keys.offset)
        out[one, 1] = 1 + np.frombuffer(keys.buffers()[2] or b"\0", np.uint8)[offsets[1:][one] - 1]
        more = right & (marks > 1)
        out[more, 1] = [self.piece(BARE + x[len(x) - n :]) for x, n in zip(keys.filter(pa.array(more)).to_pylist(), marks[more].tolist(), strict=True)]
        out[~right, 0] = [self.piece(x) for x in keys.filter(pa.array(~right)).to_pylist()]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), and the id count of each."""
        if max(len(self.rows), len(self.flat) // 16, len(self.ends) // 2) > self.remember:
            self.forget()
        kind = pa.large_string()
        texts = texts.cast(kind).fill_null("")
        aside = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(aside), pa.scalar("", kind), texts)
        marked = pc.binary_join_element_wise(pa.scalar("", kind), pc.replace_substring(plain, "\n", f" \n {BARE}"), pa.scalar(BARE, kind))
        pieces = pc.split_pattern(marked, " ")
        found = pieces.flatten().dictionary_encode()
        rows = self.distinct(found.dictionary)
        flat, ends = _gathered(np.frombuffer(self.flat, f"<u{self.flat.itemsize}"), np.frombuffer(self.ends, np.int64), rows.ravel())
        ids, ends = _gathered(flat, np.concatenate(([0], ends[1::2])), found.indices.to_numpy())
        stops = np.concatenate(([0], ends))[pieces.offsets.to_numpy()]
        counts = np.diff(stops)
        if not aside.any():
            return ids, counts
        split = np.split(ids, stops[1:-1])
        others = np.flatnonzero(aside)
        for i, x in zip(others.tolist(), self.library(texts.take(pa.array(others)).to_pylist()), strict=True):
            split[i], counts[i] = np.array(x, ids.dtype), len(x)
        return np.concatenate(split), counts


def encoder(path: str) -> Encoder:
    """One for each Python worker, until it runs another operator."""
    return held(("encoder", path), lambda: Encoder(path))


#: Texts handed to a worker and encoded at a time: what is built on the way takes several times their ids' memory, and the
#: batch is held once more by each end of the pipe.
AT_ONCE = 256


def encoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, id count, words) of each document of (doc_id, text): its ids and end_id, packed. Null text: empty."""
    coder = encoder(tokenizer_path)
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(at, AT_ONCE)
            ids, counts = coder.encode(batch.column(1))
            ids = np.insert(ids.astype(np.uint64), np.cumsum(counts), np.uint64(end_id))
            words, ends = pack_flat(ids, counts + 1)
            data, starts = words.tobytes(), (8 * np.concatenate(([0], ends))).tolist()
            for doc, n, a, b in zip(batch.column(0).to_pylist(), (counts + 1).tolist(), starts, starts[1:], strict=False):
                yield doc, n, data[a:b]


BLOCKS = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "block", "n_ids")] + [T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])


def write_ids(documents: DataFrame, path: str, tokenizer_path: str, block_ids: int = 1 << 18, end_id: int = END_ID) -> None:
    """Writes the ids of documents in ascending doc_id order as blocks of at least block_ids ids (fewer at a part's end).

    Texts are dealt by ranges of doc_id before they are tokenised, so that neither the sampling of the ranges nor
    anything else tokenises twice. Null ids come first, equal ids in the order of their texts' hashes. Parts ascend with
    doc_id; an empty table gives an empty file set.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, full = TaskContext.get().partitionId(), 0, 0
        ready: list[tuple[bytes, int]] = []
        names: list[int | None] = []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([full], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([write_block(ready)], pa.binary())], names=BLOCKS.names)

        for doc, n, words in encoded(batches, tokenizer_path, end_id):
            ready.append((words, n))
            names.append(doc)
            full += n
            if full >= block_ids:
                yield row()
                ready, names, full, block = [], [], 0, block + 1
        if ready:
            yield row()

    dealt = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    with small_batches(documents.sparkSession, AT_ONCE):
        tabled(dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, BLOCKS), path)


DIGESTS = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "block", "place", "doc_id", "before", "n_tokens", "ids_crc32")])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of each document of a file set, decoded block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, counts = read_block(payload)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([ids[e - n : e].astype(np.int64) for e, n in zip(ends, counts, strict=True)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return spark.read.parquet(path).select("doc_ids", "payload").mapInArrow(run, "doc_id long, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the blocks: start is the number of ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token-digests")  # the encoder goes
        for batch in batches:
            for part, block, docs, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, counts = read_block(payload)
                flat, ends = ids.astype("<u4"), np.cumsum(counts)
                crcs = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(docs)
                columns = [np.full(n, part), np.full(n, block), np.arange(n), docs, ends - counts, counts, crcs]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=DIGESTS.names)

    blocks = spark.read.parquet(path)
    from pyspark.sql import Window as W

    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = sums.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("part_start"))  # a row for each part
    within = W.partitionBy("part").orderBy("block")
    index = blocks.select("part", "block", "n_ids").withColumn("block_start", F.sum("n_ids").over(within) - F.col("n_ids")).join(parts, "part")
    index = index.select("part", "block", (F.col("part_start") + F.col("block_start")).alias("base"))
    digests = blocks.select("part", "block", "doc_ids", "payload").mapInArrow(run, DIGESTS)
    return digests.join(index, ["part", "block"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(documents: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Writes the ids of documents and reads them back; see write_ids and read_digests."""
    spark = documents.sparkSession
    path = path or scratch_path(spark, "token-ids")
    write_ids(documents, path, tokenizer_path)
    return read_digests(spark, path)
