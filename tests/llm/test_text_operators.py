import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from orolith.llm import decontam, langid, licenses, merkle, mixing, sharding
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def places(own, phrase):
    phrase = phrase.split()
    return [i for i in range(len(own) - len(phrase) + 1) if own[i : i + len(phrase)] == phrase]


# licenses


def test_base_phrases_equal_brute_force(odd, empty):
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    found = licenses.scan(odd).collect()
    assert len(found) == odd.count()
    by = {}
    for doc_id, text in texts:
        by.setdefault(doc_id, []).append(text)
    for r in found:
        ok = False
        for text in by[r.doc_id]:
            own = words(text)
            starts = [(i, label) for phrase, label in licenses.BASE for i in places(own, phrase)]
            at = [i for i, _ in starts]
            ok |= (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in starts})))
        assert ok, r
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert licenses.scan(empty).collect() == []


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0 (the x)", "apache-2"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("GNU General Public License", "gpl"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3"),
        ("Creative Commons Attribution-ShareAlike 4.0", ""),
        ("released under a Creative Commons Attribution ShareAlike 4.0 licence", "cc-by-sa"),
        ("All rights reserved. MIT license", "mit,proprietary"),
        ("under the terms of the mpl 2.0", "mpl-2"),
        ("we licensed under an unknown thing", "unknown-license"),
        ("the committed limit of the mit", ""),
    ],
)
def test_labels(spark, text, labels):
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels
    assert got == labels or (labels == "" and got in ("", "creative-commons"))


def test_every_rule_is_gated_and_keyed():
    rules = licenses.rules()
    assert len(rules) > 300
    for rule in rules:
        sample = " ".join("4" if s == "#" else s.split("|")[0] for s in rule.pattern.split() if not s.startswith("?"))
        assert rule.keyword() in sample.split(), rule
        assert re.match(rule.regex(), "".join(f"{w}|{i} " for i, w in enumerate(sample.split()))), rule


def test_gate_lets_every_rule_through(spark):
    samples = [" ".join("4" if s == "#" else s.split("|")[0] for s in r.pattern.split() if not s.startswith("?")) for r in licenses.rules()]
    rows = spark.createDataFrame([(s.upper(),) for s in samples], "text string")
    assert rows.where(~licenses.gated(F.col("text"))).collect() == []


def test_gate_lets_every_alternative_through(spark):
    samples = set()
    for rule in licenses.rules():
        slots = [(["4"] if s.lstrip("?") == "#" else s.lstrip("?").split("|")) + [""] * s.startswith("?") for s in rule.pattern.split()]
        for chosen in itertools.product(*slots):
            sample = " ".join(filter(None, chosen))
            assert rule.keyword() in sample.split(), rule
            samples.add(sample)
    rows = spark.createDataFrame([(x,) for s in samples for x in (s, s.upper().replace(" ", ", "))], "text string")
    assert rows.where(~licenses.gated(F.col("text"))).collect() == []


@pytest.mark.parametrize(("text", "labels"), [("Released under MIT", "mit"), ("distributed under the BSD 3-Clause", "bsd-3"), ("available under MPL 2.0", "mpl-2"), ("published under CC0", "cc0"), ("Issued under an ISC", "isc"), ("released under the moon", "unknown-license"), ("went under the bridge", "")])
def test_statements_without_the_word_license(spark, text, labels):
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.labels == labels and (got.score > 0) == bool(labels)


# language


def test_language_of_held_out_documents(spark):
    rng = random.Random(2)
    stock = {"en": "the of and to in that it was for on are with as his they be at one have this".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split(), "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split()}
    rows = [(i, " ".join(rng.choice(stock[lang]) for _ in range(40)), lang) for i in range(600) for lang in [rng.choice(sorted(stock))]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !!", "fr"), (1003, "日本", None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(documents, langid.train(documents)).collect()}
    apart = [r for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(found[i].lang_pred == lang for i, _, lang in apart) >= 0.98 * len(apart)
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert found[1003].lang_pred in stock and found[1003].score == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    flags = {r.doc_id: r.h for r in documents.select("doc_id", langid.held_out().alias("h")).collect()}
    assert flags == {r[0]: zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows}


def test_language_of_odd_rows(odd, empty):
    model = langid.train(odd)
    found = langid.identify(odd, model)
    assert found.count() == odd.count()
    assert set(odd.columns) <= set(found.columns)
    assert langid.accepted(odd, model).columns == odd.columns
    none = langid.train(empty)
    assert none.languages == []
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(empty, model).collect() == []


def test_filters_equal_exact_sets_but_for_their_false_positives(spark):
    rng = random.Random(5)
    langs = [f"l{k:02d}" for k in range(70)]  # more than one word of mask bits
    rows = [(i, " ".join(chr(97 + (k + rng.randint(0, 9)) % 26) * 2 + chr(0x430 + k % 30) + rng.choice("aeiou") for _ in range(30)), langs[k]) for i, k in enumerate(k for _ in range(12) for k in range(70))]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(documents)
    assert model.languages == langs and model.masks.shape[0] == 2
    counts = {x: Counter() for x in langs}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(langid.grams([text])[0].tolist())
    shares = {}
    for lang, own in counts.items():
        twice = {g: n for g, n in own.items() if n > 1}
        shares[lang] = {g: n / sum(twice.values()) for g, n in twice.items()}
    most = Counter()
    for own in shares.values():
        for g, x in own.items():
            most[g] = max(most[g], x)
    exact = {lang: {g for g, x in own.items() if x >= langid.BELONGS * most[g]} for lang, own in shares.items()}
    every = np.array(sorted(most), np.uint64)
    found = np.bitwise_and.reduce([model.masks[:, s] for s in langid._slots(every)])
    wrong = 0
    for k, lang in enumerate(langs):
        has = set(every[langid._bit(found, k) == 1].tolist())
        assert exact[lang] <= has, lang
        wrong += len(has - exact[lang])
    assert wrong <= 3 + 10 * model.rates.max() * len(every) * len(langs)
    for i, text, _ in rows[:210]:
        own = langid.grams([text])[0].tolist()
        hits = [sum(g in exact[x] for g in own) for x in langs]
        assert hits[langs.index(model.predict([text])[0][0])] == max(hits), i


def test_bloom_bits_have_every_trained_gram(spark):
    documents = spark.createDataFrame([(i, "alpha beta gamma delta", "x") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.train(documents)
    names, score, coverage = model.predict(["alpha beta"])
    assert names == ["x"] and score[0] == 1 and coverage[0] > 0.9


def test_grams_of_a_large_batch_are_counted_in_little_memory():
    rng = random.Random(9)
    stock = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(stock, k=600)) for _ in range(300)] + [None, "", "1 2", " ".join(rng.choices(stock, k=30_000)), "zz zz"] + ["ab"] * 300
    langs = [i % 3 for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(langs, pa.int64())], names=["text", "number"])
    langid.held("letters", langid._letters)
    tracemalloc.start()
    got = Counter()
    for out in langid.count_grams([batch]):
        for lang, gram, n in zip(*(out.column(k).to_pylist() for k in range(3)), strict=True):
            got[lang, gram] += n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = Counter()
    for text, lang in zip(texts, langs, strict=True):
        want.update((lang, g) for g in langid.grams([text])[0].view(np.int64).tolist())
    assert got == want
    assert peak < 60e6, peak  # 1.2 million characters, all at once: over 150 MB
    sizes = [(x.num_rows, sum(len(t or "") for t in x.column(0).to_pylist())) for x in langid.pieces([batch], 0)]
    assert [t for x in langid.pieces([batch], 0) for t in x.column(0).to_pylist()] == texts
    assert all(n <= langid.TEXTS and (n == 1 or size <= langid.TEXT_BYTES) for n, size in sizes)


# mixing


def test_targets_fill_by_weight(spark):
    sizes = [("b", 1000), ("a", 10), ("c", 500), (None, 0), ("z", 7)]
    rows = mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, source_size long, n_rows long")).collect()
    got = {r.source: r.target for r in rows}
    left, weight = 1.5 * 1517, {"a": 3, "b": 1, "c": 2, "z": 3, None: 1}
    live, want = dict(weight), {}
    while True:  # share, stop what is above, share the excess again
        level = left / sum(live.values())
        above = [s for s in live if live[s] * level >= 2 * dict(sizes)[s]]
        if not above:
            break
        for s in above:
            want[s] = 2 * dict(sizes)[s]
            left -= want[s]
            del live[s]
    want |= {s: w * level for s, w in live.items()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("block", [1, 3, mixing.BLOCK])
def test_mix_meets_targets(spark, block):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), "src0" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(documents, block=block).collect()
    assert len(found) == 900
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(documents.repartition(7), block=block).collect()))
    per = {}
    of = {i: s for i, _, s in rows}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        taken, target, size = per.get(of[r.doc_id], (0, 0, 0))
        per[of[r.doc_id]] = (taken + r.taken, r.target, r.source_size)
    for taken, target, _ in per.values():
        assert abs(taken - target) <= 8 + 0.01 * target


def test_mix_meets_targets_of_tiny_sources(spark):
    huge = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 20_000).alias("text"), F.lit("huge").alias("source"))
    tiny = [(1000 + 10 * k + i, "w " * (k + 1), f"tiny{k}") for k in range(8) for i in range(6)]
    documents = huge.unionByName(spark.createDataFrame(tiny, huge.schema))
    per = {}
    for r in mixing.mix(documents).join(documents.select("doc_id", "source"), "doc_id").collect():
        assert 0 <= r.taken <= 2 * r.size
        taken, _ = per.get(r.source, (0, 0))
        per[r.source] = (taken + r.taken, r.target)
    assert len(per) == 9
    for source, (taken, target) in per.items():
        assert abs(taken - target) <= (0.5 if source != "huge" else 0.001 * target), source
    copies = {r.source: r.n for r in mixing.mixed_documents(documents).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(copies.get(f"tiny{k}") == 12 for k in range(8))


def test_mix_of_odd_rows(odd, empty):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count()
    assert sorted(r["size"] for r in found) == sorted(len((r.text or "").encode().split()) for r in odd.collect())
    assert mixing.mix(empty).collect() == []
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0


# shards


def test_shards_equal_brute_force(spark, odd):
    rows = sorted(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect(), key=lambda r: r.doc_id)
    sizes = [len((r.text or "").encode()) + 16 for r in rows]
    total, before, shards = sum(sizes), 0, []
    for n in sizes:
        shards.append(min(4, (2 * before + n) * 5 // (2 * total)))
        before += n
    slots = [i - shards.index(s) for i, s in enumerate(shards)]
    want = [(r.doc_id, n, zlib.crc32((r.text or "").encode()), "bytes", s, k, None) for r, n, s, k in zip(rows, sizes, shards, slots, strict=True)]
    got = sorted(tuple(r) for r in sharding.byte_shards(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), 5).collect())
    assert got == want


def test_shards_of_odd_rows(spark, odd, empty):
    found = sharding.byte_shards(odd, 3).collect()
    assert len(found) == odd.count()
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert sharding.byte_shards(empty).collect() == []
    even = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 84).alias("text"))
    sizes = [r.n for r in sharding.byte_shards(even).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 200


# decontamination


def brute_hits(text, items):
    own = words(text)
    hit, found = set(), set()
    for item, phrase in items:
        w = words(phrase)
        for k in range(max(1, len(w) - 9) if w else 0):
            window = w[k : k + 10]
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_equals_brute_force(spark, odd, empty):
    items = [(1, "a b c d e f g h i j k l"), (2, "under the MIT license"), (10, "c d e f g h i j k l m"), (3, ""), (4, None), (5, "quick brown fox jumps the"), (6, "fox jumps. The quick"), (7, "x x x x x x x x x x x")]
    texts = ["A b, c d e f g h i j k l m n!", "a b c d e f g h i", "b c d e f g h i j k l a b c d e f g h i j", "x " * 25, "the mit license under the mit license", None]
    documents = odd.select("doc_id", "text", "n_words", "labels").unionByName(spark.createDataFrame([(100 + i, t, None, None) for i, t in enumerate(texts)], "doc_id long, text string, n_words long, labels string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(documents, bench).collect()
    assert len(found) == documents.count()
    for r in found:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(r.text, items), r
    kept = decontam.clean(documents, bench)
    assert kept.columns == documents.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(r.text) for r in found if not r.contaminated)
    assert decontam.contamination(empty, bench).collect() == []
    assert not any(r.contaminated for r in decontam.contamination(documents, bench.limit(0)).collect())


def test_proximity(spark):
    documents = spark.createDataFrame([(1, "zeta one two alpha three beta four"), (2, "alpha " + "x " * 30 + "beta zeta"), (3, "beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta zeta")], "item_id long, text string")
    got = [(r.doc_id, r.start, r.stop) for r in decontam.proximity_matches(documents, items, 3, 10).collect()]
    assert got == [(1, 0, 6)]


# fingerprints


def leafwise(a, b):
    """Likeness by whole leaves of the texts, without trees: what equal branches cover is made of equal leaves."""
    from collections import Counter

    own = [Counter(leaf for paragraph in x.splitlines(keepends=True) for leaf in merkle._leaves(paragraph)) for x in (a, b)]
    shared = sum(len(x) * n for x, n in (own[0] & own[1]).items())
    return 1.0 if a == b else 2 * shared / (len(a) + len(b))


def test_merkle_likeness_and_edits_equal_leaf_counts():
    rng = random.Random(9)
    for _ in range(300):
        lines = [" ".join(rng.choice(["ab.", "cd", "ef!", "gh. ij", "k" * 500]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 12))]
        a = "\n".join(lines)
        for _ in range(rng.randint(0, 3)):
            lines.insert(rng.randint(0, len(lines)), rng.choice(["new line.", "", "ab."]))
        b = "\n".join(lines)
        trees = [merkle.Tree.unpacked(merkle.Tree(x).packed()) for x in (a, b)]
        assert merkle.likeness(*trees) == pytest.approx(leafwise(a, b))
        apart = {s: sum(stop - start for t, start, stop in merkle.edits(*trees) if t == s) for s in "-+"}
        assert (len(a) - apart["-"], len(b) - apart["+"]) == (len(b) - apart["+"],) * 2 or not (a or b)


def test_merkle_steps_are_a_table_of_few_files(spark):
    """What ranges hand on is read again as a table: many small ranges need no task each, and no checksum files."""
    documents = spark.createDataFrame([(i, f"Words of {i}. More of them.") for i in range(40)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    try:
        found = merkle.compare_with_next(documents, keep_trees=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({r.doc_id for r in found.collect()}) == 40
    assert any("merkle-steps" in x for x in found.inputFiles())


def test_merkle_many_ranges_make_few_files_and_small_batches(spark, monkeypatch):
    """Ranges of a row or none, not coalesced: as few files as ranges need, workers get few texts at a time, same rows."""
    documents = spark.createDataFrame([(i, f"Words of {i}. More of them, {i % 3}.") for i in range(40)], "doc_id long, text string")
    want = sorted(merkle.compare_with_next(documents).collect())
    held, tabled = [], merkle.tabled

    def seen(df, path):
        held.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return tabled(df, path)

    monkeypatch.setattr(merkle, "tabled", seen)
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        found = merkle.compare_with_next(documents)
        assert sorted(found.collect()) == want
        assert found.rdd.getNumPartitions() <= 6 and len(found.inputFiles()) <= 6
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(held) <= merkle.AT_ONCE


def test_merkle_decodes_few_texts_at_a_time(spark, monkeypatch):
    """Vectors of thousands of texts make the JVM's heap grow; smaller sizes of the session are kept, and all come back."""
    key, held, tabled = "spark.sql.parquet.columnarReaderBatchSize", [], merkle.tabled
    documents = spark.createDataFrame([(1, "One."), (2, "Two.")], "doc_id long, text string")

    def seen(df, path):
        held.append(int(spark.conf.get(key)))
        return tabled(df, path)

    monkeypatch.setattr(merkle, "tabled", seen)
    before = spark.conf.get(key)
    assert merkle.compare_with_next(documents).count() == 2
    assert set(held) == {512} and spark.conf.get(key) == before
    spark.conf.set(key, 100)
    try:
        merkle.compare_with_next(documents)
        assert held[-1] == 100 == int(spark.conf.get(key))
    finally:
        spark.conf.set(key, before)


def test_merkle_trees():
    text = "One. Two two!\nThree three three? Four\n\nFive."
    assert merkle.Tree(text).root == merkle.Tree(text).root != merkle.Tree(text + " ").root
    assert merkle.likeness(merkle.Tree(text), merkle.Tree(text)) == 1
    assert merkle.likeness(merkle.Tree(""), merkle.Tree("")) == 1
    assert merkle.likeness(merkle.Tree("abc."), merkle.Tree("xyz.")) == 0
    long = "".join(f"Sentence {i} of many.\n" for i in range(200))
    other = long.replace("Sentence 77 ", "Changed 77 ")
    assert 0.98 < merkle.likeness(merkle.Tree(long), merkle.Tree(other)) < 1
    (sign, a, b), (_, c, d) = merkle.edits(merkle.Tree(long), merkle.Tree(other))
    assert sign == "-" and "Sentence 77" in long[a:b] and "Changed 77" in other[c:d] and b - a < 40
    assert merkle.edits(merkle.Tree(long), merkle.Tree(long)) == []
    for x in (text, "word " * 5000, "x" * 10_000, "", "no end"):
        tree = merkle.Tree(x)
        again = merkle.Tree.unpacked(tree.packed())
        assert (again.root, again.sections, again.size()) == (tree.root, tree.sections, len(x))


def test_neighbours_equal_brute_force(spark, odd, empty):
    rows = sorted(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect(), key=lambda r: -r.doc_id)
    texts = [r.text or "" for r in rows]
    want = {}
    for i, r in enumerate(rows):
        own, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(own) // 2
        changed = own[: len(own) - half] + after[:half]
        trees = merkle.Tree(own), merkle.Tree(changed), merkle.Tree(after)
        want[r.doc_id] = (r.doc_id, len(own), hashlib.sha256(changed.encode()).hexdigest(), trees[0].root, trees[1].root, merkle.likeness(trees[0], trees[1]), merkle.likeness(trees[0], trees[2]), trees[0].packed())
    got = {r.doc_id: tuple(r) for r in merkle.compare_with_next(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert got == want
    bare = merkle.compare_with_next(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), keep_trees=False).collect()
    assert {r.doc_id: tuple(r) for r in bare} == {k: (*x[:-1], None) for k, x in want.items()}
    assert merkle.compare_with_next(odd).count() == odd.count()
    assert merkle.compare_with_next(empty).collect() == []
    one = merkle.compare_with_next(spark.createDataFrame([(5, "ab cd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_license_notices_with_names_in_them(spark):
    texts = ["Neither the name of the copyright holder nor the names of its contributors may be used", "Neither the name of Foo Bar Inc. nor the names of its contributors", "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["bsd-3", "bsd-3", "cc0"]
