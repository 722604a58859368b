import random

import corpus_pipeline
from orolith.llm import shingles, simhash


def slow_components(texts):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                a, b = sorted((label[i], label[j]))
                label = [a if k == b else k for k in label]
    return label


def made():
    """Unrelated texts, copies with one to nine of 150 words changed, and a large group."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = ["", None, "a b", "A  b", "a b c"]
    for _ in range(40):
        base = [word() for _ in range(150)]
        texts.append(" ".join(base))
        for n in (1, 2, 3, 4, 9):
            copy = list(base)
            for k in rng.sample(range(150), n):
                copy[k] = word()
            texts.append(" ".join(copy))
    base = [word() for _ in range(150)]
    for _ in range(120):
        copy = list(base)
        copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    return texts


def test_near_copies_equal_brute_force(spark):
    texts = made()
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in shingles.near_copies(documents).collect()}
    assert got == dict(enumerate(slow_components(texts)))


def test_stage_drops_near_copies(spark):
    """Most of these pairs differ in more than 3 bits of their SimHash."""
    texts = made()
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, documents, "").collect()) == sorted(set(slow_components(texts)))


def test_simhash_links_the_stage(spark, monkeypatch):
    """Without the bands the stage drops just the similar copies within SimHash's radius."""
    rng = random.Random(6)
    none = lambda ddl: spark.createDataFrame([], ddl)
    monkeypatch.setattr(shingles, "band_pairs", lambda *_: (none("a long, b long, round int"), none("key long, fp long")), raising=False)
    texts, dropped, similar = [], 0, 0
    for k in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        copy = list(base)
        for at in rng.sample(range(150), 1 + k % 3):
            copy[at] = f"w{rng.randrange(5000)}"
        texts += [" ".join(base), " ".join(copy)]
        x, y = (shingles.shingle_set(t) for t in texts[-2:])
        both = len(set(x.tolist()) & set(y.tolist()))
        alike = both >= 0.8 * (len(x) + len(y) - both)
        similar += alike
        dropped += alike and (simhash.of_hashes(x) ^ simhash.of_hashes(y)).bit_count() <= shingles.RADIUS
    assert 0 < dropped < similar
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert corpus_pipeline.near_dedup(spark, documents, "").count() == len(texts) - dropped


def test_crowded_pairs_lose_no_similar_pair(spark, monkeypatch):
    """One bucket of families whose members are 0.6 to 1 alike, shingles that all texts share, and lists over many blocks."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(50000)}"
    common, texts = [word() for _ in range(30)], []
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(25):
            copy = list(base)
            for k in rng.sample(range(120), rng.randrange(1, 9)):
                copy[k] = word()
            texts.append(" ".join(common + copy[: rng.randrange(90, 120)]))
    sets = {int(i): shingles.shingle_set(x) for i, x in enumerate(texts)}
    roots = {i: i - i % 3 for i in sets}  # some are one component already
    wanted = set()
    for i, x in sets.items():
        for j in range(i):
            both = len(set(x.tolist()) & set(sets[j].tolist()))
            if roots[i] != roots[j] and both >= 0.8 * (len(x) + len(sets[j]) - both):
                wanted.add((j, i))
    assert 50 < len(wanted) < len(texts) ** 2 / 8
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "fp long, hashes binary").repartition(3)
    crowds = spark.createDataFrame([(7, i) for i in sets], "key long, fp long")
    placed = spark.createDataFrame(list(roots.items()), "node long, root long")
    for block in (512, 16):
        monkeypatch.setattr(shingles, "BLOCK", block)
        pairs = shingles.crowded_pairs(crowds, placed, table)
        assert {(r.a, r.b) for r in shingles.verified(pairs, table).collect()} == wanted
        assert pairs.count() < 4 * len(wanted)
    settled = spark.createDataFrame([(i, 0) for i in sets], "node long, root long")
    assert shingles.crowded_pairs(crowds, settled, table) is None


def test_pairs_are_dealt_to_cells_once(spark, monkeypatch):
    """The pairs are joined to their nodes' counts in one place, not once more for the sets that they need; none is lost."""
    monkeypatch.setattr(shingles, "CELL", 4)
    base = [f"w{k}" for k in range(100)]
    sets = {i: shingles.shingle_set(" ".join(base + [f"x{i}"] * (i % 3))) for i in range(12)}
    pairs = [(i, j) for i in sets for j in sets if i < j]
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "fp long, packed binary")
    found = shingles.verified(spark.createDataFrame(pairs, "a long, b long"), table)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((r.a, r.b) for r in found.collect()) == pairs


def test_near_copies_of_odd_rows(odd, empty):
    assert shingles.near_copies(odd).count() == odd.count()
    assert shingles.near_copies(empty).collect() == []
