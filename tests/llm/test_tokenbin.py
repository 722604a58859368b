import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from orolith.llm import prefixcount, tokenbin
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_simple8b_round_trip():
    rng = random.Random(3)
    documents = [np.array([rng.choice([0, 1, rng.randint(0, 50_256), rng.randint(0, 2 ** rng.randint(0, 63)), 2**60 - 1, 2**60, 2**64 - 1]) for _ in range(rng.randint(0, 300))], np.uint64) for _ in range(200)]
    documents += [np.zeros(0, np.uint64), np.zeros(1000, np.uint64), np.full(7, 2**61, np.uint64)]
    for ids, words in zip(documents, tokenbin.pack_documents(documents), strict=True):
        assert (tokenbin.unpack(words)[: len(ids)] == ids).all()
    assert tokenbin.pack_documents([]) == []
    assert len(tokenbin.pack(np.ones(600, np.uint64))) == 10  # 60 one-bit ids a word


def test_block_parts_documents_and_rejects_others():
    documents = [np.arange(5, dtype=np.uint64), np.zeros(0, np.uint64), np.array([2**62, 1], np.uint64)]
    payload = tokenbin.write_block([(w.tobytes(), len(d)) for w, d in zip(tokenbin.pack_documents(documents), documents, strict=True)])
    ids, counts = tokenbin.read_block(payload)
    assert counts.tolist() == [5, 0, 2]
    assert ids[:5].tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        tokenbin.read_block(bytes(128))


def test_encoder_equals_the_library():
    rng = random.Random(5)
    bits = ["a", "the", "é", "'s", "'", "\n", "\n\n", " ", "  ", "\t", "1", ".", ",", "%%%", "<|endoftext|>", "\xa0", "\x1c", "_", "日本", "\r\n", "\x85", "İ", "́", "😀", "Don't", "...", " \n", "\n "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    library, coder = Tokenizer.from_file(BYTE), tokenbin.Encoder(BYTE, remember=500)
    for at in range(0, len(texts), 300):
        ids, counts = coder.encode(pa.array(texts[at : at + 300]))
        for text, ids in zip(texts[at : at + 300], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_encoder_remembers_within_bounds():
    coder = tokenbin.Encoder(BYTE, remember=1000)
    rng = random.Random(6)
    for _ in range(40):
        coder.encode(pa.array([" ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(300)) + " " + "x" * 100_000]))
        assert len(coder.rows) <= 1700
        assert len(coder.flat) < 1_000_000
        assert max(map(len, coder.rows)) <= tokenbin.LONGEST


def test_encoding_many_texts_takes_little_memory():
    import tracemalloc

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2048)), pa.array([" ".join(rng.choices(words, k=400)) for _ in range(2048)])], names=["doc_id", "text"])
    tokenbin.encoder(BYTE).encode(batch.column(1).slice(0, 256))
    tracemalloc.start()
    n = sum(len(data) for _, _, data in tokenbin.encoded(iter([batch]), BYTE, 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1_000_000
    assert peak < 20e6


def test_texts_go_to_workers_in_small_batches(spark, odd, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], DataFrameWriter.parquet
    before = spark.conf.get(key)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(int(spark.conf.get(key))), write(self, *a, **k))[1])
    tokenbin.write_ids(odd, str(tmp_path / "ids"), BYTE)
    assert seen == [tokenbin.AT_ONCE]
    assert tokenbin.AT_ONCE <= 512
    assert spark.conf.get(key) == before


def brute(rows):
    library, start, out = Tokenizer.from_file(BYTE), 0, []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_digests_equal_brute_force(spark, odd):
    rows = odd.where("doc_id > 0").dropDuplicates(["doc_id"])
    want = brute([(r.doc_id, r.text) for r in sorted(rows.collect(), key=lambda r: r.doc_id)])
    got = sorted(tuple(r) for r in tokenbin.token_digests(rows, BYTE).collect())
    assert got == want


def test_digests_of_odd_rows_and_of_none(spark, odd, empty):
    got = tokenbin.token_digests(odd, BYTE).collect()
    assert len(got) == odd.count()
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert tokenbin.token_digests(empty, BYTE).collect() == []


def test_files_decode_to_ids(spark, odd, tmp_path):
    path = str(tmp_path / "ids")
    tokenbin.write_ids(odd.where("doc_id is not null"), path, BYTE, block_ids=50)
    library = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in tokenbin.read_ids(spark, path).collect():
        assert r.ids == [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]


def test_prefix_counts_are_exact():
    counter, library = prefixcount.PrefixCounter(WORD), Tokenizer.from_file(WORD)
    n = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    for text in ["", " ", "Hello  wörld, don't stop\nnow <|endoftext|> x", "a" * 200, "antidisestablishmentarianism of words", "\x1c\x85 ſ İ"]:
        table = counter.tables([text])[0]
        assert table[-1] == n(text)
        for end in range(len(text) + 1):
            assert counter.count(text, table, end) == n(text[:end])
        for budget in (0, 1, 3, 7):
            end = counter.fit(text, table, budget)
            assert n(text[:end]) <= budget
            assert all(n(text[:k]) > budget for k in range(end + 1, len(text) + 1))


@pytest.mark.parametrize("letter", ["a", "日", "aB9_", "é"])
def test_long_spaceless_texts_fit(letter):
    import time

    counter, library, text = prefixcount.PrefixCounter(WORD), Tokenizer.from_file(WORD), letter * 1_000_000
    n = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    table = counter.tables([text])[0]
    began = time.process_time()
    end = counter.fit(text, table, 2048)
    assert time.process_time() - began < 60
    assert n(text[:end]) <= 2048 < n(text[: end + 1])
    assert sum(map(len, counter.memory)) < 10_000


def test_token_counts(odd, empty):
    library = Tokenizer.from_file(WORD)
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, set()).add(len(library.encode(r.text or "", add_special_tokens=False).ids))
    got = prefixcount.token_counts(odd, WORD).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.n_tokens in texts[r.doc_id]
        assert r.over_limit == (r.n_tokens > 2048)
    assert prefixcount.token_counts(empty, WORD).collect() == []
    assert all(r.prefix_tokens[-1] == r.n_tokens for r in prefixcount.prefix_tables(odd, WORD).collect())


def test_prefix_counts_refuse_tokenizers_that_keep_white_space():
    with pytest.raises(ValueError):
        prefixcount.PrefixCounter(BYTE)


def test_blocks_start_no_process_for_checksum_files(spark, tmp_path):
    documents = spark.createDataFrame([(i, "some words") for i in range(20)], "doc_id long, text string")
    got = tokenbin.token_digests(documents, BYTE, str(tmp_path / "ids")).collect()
    assert sorted(r.doc_id for r in got) == list(range(20))
    assert [x.name for x in (tmp_path / "ids").iterdir() if x.name.endswith(".parquet.crc")] == []
