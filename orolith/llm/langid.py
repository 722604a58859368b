"""Language identification by bit-sliced Bloom filters of character n-grams.

One array of slots holds the filters of all languages: a slot is a mask with a bit for each language, so the masks at
an n-gram's slots, combined by AND, are the set of languages that have the n-gram. A text's hits for a language are
the popcount of that language's bit over its n-grams; what the filter's own false-positive rate would give is taken off.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held, scratch_path, tabled

#: The fit's sample: about so many training documents of each language.
PER_LANGUAGE = 600
#: Slots of the filters and hashes of an n-gram. A slot has a word of BITS bits for every so many languages.
SLOTS = 1 << 20
HASHES = 3
BITS = 64
UNDETERMINED = "und"
SIZES = (2, 3, 4)
#: Texts are taken together up to so many and so many bytes, a longer one by itself: their n-grams take about 130 bytes for each byte of text.
TEXTS, TEXT_BYTES = 128, 1 << 17
#: An n-gram belongs to a language if its share there is at least so much of its greatest share in any.
BELONGS = 0.4

def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it is no letter."""
    points = np.zeros(0x110000, np.uint32)
    for x in range(0x110000):
        c = chr(x)
        if c.isalpha():
            low = c.lower()
            points[x] = ord(low) if len(low) == 1 else x
    return points


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of the n-grams of all texts, within words and over their edges, and the text of each."""
    joined = "".join(f"\n{x or ''}\n" for x in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = held("letters", _letters)[np.minimum(points, 0x10FFFF)]
    lengths = np.array([len(x or "") + 2 for x in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    keep = letters != 0
    keep[1:] |= letters[:-1] != 0  # one edge after each word
    keep[np.cumsum(lengths) - lengths] = True  # and one before each text, so that a text's n-grams are the same in any company
    word, owner = letters[keep].astype(np.uint64), owner[keep]
    out, of = [], []
    for size in SIZES:
        n = len(word) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, np.uint64)
        good = np.ones(n, bool)
        for k in range(size):
            part = word[k : k + n]
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            if 0 < k < size - 1:
                good &= part != 0
        good &= owner[:n] == owner[size - 1 :]
        if size == 2:
            good &= (word[:n] != 0) & (word[1 : n + 1] != 0)
        out.append(h[good])
        of.append(owner[:n][good])
    order = np.argsort(np.concatenate(of), kind="stable") if out else np.zeros(0, np.int64)
    return (np.concatenate(out)[order], np.concatenate(of)[order]) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def pieces(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, whose column at has the texts, in slices of up to TEXTS rows and TEXT_BYTES bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            most = TEXT_BYTES + (int(ends[start - 1]) if start else 0)
            stop = max(start + 1, min(start + TEXTS, int(np.searchsorted(ends, most, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts and their languages' numbers: (lang, gram, n), where a pair may come several times."""
    for batch in pieces(batches, 0):
        h, owner = grams(batch.column(0).to_pylist())
        lang = np.asarray(batch.column(1))[owner]
        for number in np.unique(lang):
            keys, n = np.unique(h[lang == number], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number), pa.int64()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def _slots(h: np.ndarray) -> list[np.ndarray]:
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(k) * b) % np.uint64(SLOTS)).astype(np.int64) for k in range(HASHES)]


def _bit(masks: np.ndarray, i: int) -> np.ndarray:
    """Language i's bit of each column of masks, whose rows are a mask's words."""
    return (masks[i // BITS] >> np.uint64(i % BITS)) & np.uint64(1)


@dataclass
class Model:
    languages: list[str]
    masks: np.ndarray  # a column for each slot, a row for each word of the mask
    common: int  # the language with most training documents
    rates: np.ndarray = field(init=False)  # each language's false-positive rate: its share of set slots, to the number of hashes

    def __post_init__(self) -> None:
        self.rates = np.array([float(_bit(self.masks, i).mean()) ** HASHES for i in range(len(self.languages))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (the winner's share of all corrected hits) and coverage (the winner's corrected hits for
        each n-gram) of each text."""
        n, k = len(texts), len(self.languages)
        h, owner = grams(texts)
        total = np.bincount(owner, minlength=n).astype(float)
        lettered = np.array([any(c.isalpha() for c in x) if x else False for x in texts], bool)
        hits = np.zeros((n, max(k, 1)))
        if len(h) and k:
            found = np.bitwise_and.reduce([self.masks[:, s] for s in _slots(h)])
            for i in range(k):
                hits[:, i] = np.bincount(owner, _bit(found, i).astype(float), n)
        rates = self.rates if k else np.zeros(1)
        true = np.maximum(0, (hits - total[:, None] * rates) / np.maximum(1 - rates, 1e-9))
        best = np.where(true.max(1) > 0, true.argmax(1), self.common)
        won, every = true[np.arange(n), best], true.sum(1)
        score = np.where(every > 0, won / np.maximum(every, 1e-12), 0.0)
        coverage = np.minimum(1.0, won / np.maximum(total, 1))
        known = lettered & (k > 0)
        names = [self.languages[i] if y else UNDETERMINED for i, y in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, score, 0.0), np.where(known, coverage, 0.0)


def held_out() -> Column:
    """Documents whose crc32 of doc_id as text leaves 2 on division by 4; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def train(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits a model on (doc_id, text, lang) of the documents that are not held out and have a language.

    The sample is bounded: about per_language documents of each language, those with the smallest hashes of doc_id. All
    their n-grams that occur twice in a language are weighed, in Spark; only the filters' set slots come to the driver, at
    most SLOTS rows for every BITS languages, whatever the texts' lengths. An empty table gives a model of no languages."""
    rows = documents.where(~held_out() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    languages = sorted(counts)
    masks = np.zeros((max(1, -(-len(languages) // BITS)), SLOTS), np.uint64)
    if not languages:
        return Model([], masks, 0)
    spark = documents.sparkSession
    numbers = spark.createDataFrame([(x, i, min(1.0, per_language / counts[x])) for i, x in enumerate(languages)], "lang string, number long, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.withColumn("draw", draw).join(F.broadcast(numbers), "lang").where("draw < share").select("text", "number")

    def set_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, h = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            mask = (np.uint64(1) << (lang % BITS).astype(np.uint64)).view(np.int64)
            for s in _slots(h):
                yield pa.RecordBatch.from_arrays([pa.array(lang // BITS, pa.int64()), pa.array(s, pa.int64()), pa.array(mask, pa.int64())], names=["word", "slot", "mask"])

    counted = tabled(sample.mapInArrow(count_grams, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1"), scratch_path(spark, "grams"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counted.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))  # a row of totals for each language
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    belongs = shares.join(most, "gram").where(F.col("share") >= BELONGS * F.col("most")).select("lang", "gram")
    for r in belongs.mapInArrow(set_slots, "word long, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
        masks[np.asarray(r.column(0)), np.asarray(r.column(1))] = np.asarray(r.column(2)).view(np.uint64)
    return Model(languages, masks, max(range(len(languages)), key=lambda i: counts[languages[i]]))


def identify(documents: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "coverage")) -> DataFrame:
    """The columns of documents (needs text) with lang_pred, score and coverage, or other names for them.

    `und` with score 0 is for null texts and texts without a letter, and for all if nothing was learned; a lettered text
    without any known n-gram gets the most frequent language, with score 0. Predictions see the text only. Input columns
    of these names are replaced. Repeated rows get the same result each, an empty table gives no rows, and a text costs
    time and memory in proportion to its length."""
    documents = documents.drop(*names)
    at = documents.columns.index("text")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # SLOTS words of 8 bytes for every BITS languages, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            found, score, coverage = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score), pa.array(coverage)], names=[*batch.schema.names, *names])

    added = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True)]
    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, *added]))


#: A text is rejected without a letter, or if its language accounts for less than this share of its n-grams.
LEAST_COVERAGE = 0.02


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of documents with an identified language, their columns untouched, whatever their names."""
    names = fresh(documents, "lang_pred", "score", "coverage")
    found = identify(documents, model, tuple(names))
    return found.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[2]) >= LEAST_COVERAGE)).select(*documents.columns)
