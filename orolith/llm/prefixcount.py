"""Exact token counts at every prefix, by dynamic programming over the places where a tokenizer cannot join.

count(prefix ending after piece i) = count(prefix ending after piece i - 1) + count(piece i), where pieces are what
single spaces separate: the pre-tokenizer drops white space and never joins across it, so the sum is exact. The
table of these counts answers counts, truncation and budgets; a prefix that ends inside a piece adds one piece's
own count, remembered by piece.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held

LIMIT = 2048
#: Pieces of more code points are not remembered.
LONGEST = 64


class PrefixCounter:
    """Prefix counts by a tokenizer file whose pre-tokenizer drops white space. Remembers up to `remember` short pieces."""

    def __init__(self, path: str, remember: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if any(" " in x.content or x.lstrip or x.rstrip for x in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("a special token may join across a space")
        if self.tokenizer.encode("a b", add_special_tokens=False).ids != self.tokenizer.encode("a  b", add_special_tokens=False).ids:
            raise ValueError("the tokenizer keeps white space")
        self.memory: dict[str, int] = {"": 0}
        self.remember = remember

    def learn(self, pieces: set[str]) -> dict[str, int]:
        """Counts of pieces; those of short ones are remembered."""
        if len(self.memory) > self.remember:
            self.memory = {"": 0}
        unknown = list(pieces.difference(self.memory))
        found = dict(zip(unknown, map(len, self.tokenizer.encode_batch_fast(unknown, add_special_tokens=False)), strict=True))
        self.memory.update((k, v) for k, v in found.items() if len(k) <= LONGEST)
        return found

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, the token count of the prefix that ends after each piece; texts must not be null."""
        pieces = [x.split(" ") for x in texts]
        fresh, known = self.learn(set().union(*pieces) if pieces else set()), self.memory
        return [np.cumsum(np.fromiter((fresh[x] if (n := known.get(x)) is None else n for x in p), np.int64, len(p))) for p in pieces]

    def count(self, text: str, table: np.ndarray, end: int) -> int:
        """The token count of text[:end], from its table."""
        whole = text.count(" ", 0, end)
        start = text.rfind(" ", 0, end) + 1
        return int(table[whole - 1] if whole else 0) + self.own(text[start:end])

    def own(self, piece: str) -> int:
        """A piece's count."""
        n = self.memory.get(piece)
        return self.learn({piece})[piece] if n is None else n

    def fit(self, text: str, table: np.ndarray, budget: int) -> int:
        """The largest end such that text[:end] has at most budget tokens; where the limit falls into a piece of over LONGEST
        code points, an end with at most budget tokens such that the next one has more (counts may fall again further on).

        Ends of a long piece are doubled until one is over, then halved in between: each trial encodes a prefix of the order
        of the budget, so a long spaceless text costs a few dozen of them, whatever its length."""
        whole = bisect_right(table, budget)
        if whole == len(table):
            return len(text)
        pieces = text.split(" ", whole + 1)
        start, left = sum(map(len, pieces[:whole])) + whole, budget - int(table[whole - 1] if whole else 0)
        piece = pieces[whole]
        if len(piece) <= LONGEST:
            return max(start + k for k in range(len(piece) + 1) if self.own(piece[:k]) <= left)
        good, over = 0, LONGEST
        while over < len(piece) and self.own(piece[:over]) <= left:
            good, over = over, 2 * over
        over = min(over, len(piece))
        while over - good > 1:
            middle = (good + over) // 2
            good, over = (middle, over) if self.own(piece[:middle]) <= left else (good, middle)
        return start + good


def counter(path: str) -> PrefixCounter:
    """One for each Python worker, until it runs another operator."""
    return held(("counter", path), lambda: PrefixCounter(path))


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            yield batch, [x or "" for x in batch.column(1).to_pylist()]


def prefix_tables(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, prefix_tokens) of each document of (doc_id, text): prefix_tokens[i] is the token count of the
    text up to its (i + 1)-th space, the last that of the whole text. Null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            tables = counter(tokenizer_path).tables(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([int(t[-1]) for t in tables], pa.int64()), pa.array(tables, pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "prefix_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, prefix_tokens array<long>")


def token_counts(documents: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars) of each document of (doc_id, text), from its prefix table;
    limit_chars: code points of a longest prefix within the limit, see PrefixCounter.fit. Null text: empty. Repeated rows
    count each, an empty table gives no rows, extra columns are not read, long texts need neither spaces nor a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            own = counter(tokenizer_path)
            tables = own.tables(texts)
            counts = [int(t[-1]) for t in tables]
            fits = [own.fit(x, t, limit) if n > limit else len(x) for x, t, n in zip(texts, tables, counts, strict=True)]
            columns = [pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts]), pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")
