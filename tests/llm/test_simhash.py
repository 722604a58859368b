import random

import numpy as np
import pytest
import xxhash
from orolith.llm import simhash
from pyspark.sql import functions as F


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, radius=3):
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None], len(fps)).min(1)
        if (new == label).all():
            break
        label = new
    return {i: min(ids[j] for j in range(len(ids)) if label[j] == label[k]) for k, i in enumerate(ids)}


def test_fingerprint():
    for text in ["", None, "one", "one two", "One two three FOUR", "a b c " * 3000, "é\xa0b c\x0bd e"]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint("a b c d") == simhash.fingerprint("A\nB  C\tD")


@pytest.mark.parametrize("leaf", [4096, 8])
def test_components_equal_brute_force(spark, leaf):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base[:15]:  # chains and balls of near fingerprints
        x = int(b)
        for _ in range(rng.integers(1, 30)):
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = np.array(fps + fps[:5] + [0, 1, 2**64 - 1], np.uint64)
    ids = list(range(len(fps)))
    groups = spark.createDataFrame(list(zip(ids, fps.view(np.int64).tolist(), strict=True)), "doc_id long, fp long")
    least = groups.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = simhash.hamming_links(least, 3, leaf)
    for r in links.collect():
        assert r.a < r.b
    roots = simhash.components(links)
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    name = {r.root: r.m for r in placed.groupBy("root").agg(F.min("least").alias("m")).collect()}
    of = {r.fp: name[r.root] for r in placed.collect()}
    want = slow_components(ids, fps)
    assert {i: of[int(f)] for i, f in zip(ids, fps.view(np.int64), strict=True)} == want


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    rows = odd.where("doc_id is not null").collect()
    fps = np.array([slow_fingerprint(r.text) for r in rows], np.uint64)
    keys = list(range(len(rows)))
    want = slow_components(keys, fps)
    want = sorted((r.doc_id, f"{int(f):016x}", min(rows[j].doc_id for j in keys if want[j] == want[k])) for k, (r, f) in enumerate(zip(rows, fps, strict=True)))
    got = sorted(tuple(r) for r in simhash.near_duplicates(odd.where("doc_id is not null")).collect())
    assert got == want
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty).collect() == []


def test_deduplicate_keeps_one_of_each_group(odd, empty):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    parts = {r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert {r.doc_id for r in kept.collect()} == parts
    assert kept.count() == len(parts)
    assert simhash.deduplicate(empty).count() == 0


def test_few_links_are_united_in_a_task(spark, monkeypatch):
    """As the rounds do, but with one table in the shared folder."""
    rng = random.Random(9)
    pairs = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(350)] + [(k, k + 1) for k in range(1000, 1100)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    made, stable = [], simhash.stable
    monkeypatch.setattr(simhash, "stable", lambda df: made.append(1) or stable(df))
    got = sorted(simhash.components(links).collect())
    assert len(made) == 1
    monkeypatch.setattr(simhash, "AT_HAND", 0)
    assert got == sorted(simhash.components(links).collect())
    assert len(made) > 2
    assert simhash.components(links.where("a = b")).count() == 0


def test_first_of_each_shuffles_texts_again_only_for_repeated_rows(spark):
    rows = [(1, "a b c", "x"), (2, "a b c", "y"), (3, "d", "z")]
    for more, again in (([], False), ([rows[0], rows[2]], True)):
        documents = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
        out = simhash.deduplicate(documents)
        assert sorted(out.collect()) == [rows[0], rows[2]]
        assert ("Deduplicate" in out._jdf.queryExecution().analyzed().toString()) == again
