"""Shortcut smoothing against the sequential rule, with prices that depend on the pair alone."""

import pytest
from orolith.operators import graph
from pyspark.sql import functions as F

STUBS = {"constant": (lambda i, j: F.lit(1.0), lambda i, j: 1.0), "concave": (lambda i, j: F.sqrt(j - i), lambda i, j: (j - i) ** 0.5), "mixed": (lambda i, j: (j - i) + ((7 * i + 13 * j) % 11) / 4.0, lambda i, j: (j - i) + ((7 * i + 13 * j) % 11) / 4.0)}


def sequential(n, cost, most, least=2):
    kept, at = list(range(n)), 0
    while at < len(kept) - least:
        for width in range(most, least - 1, -1):
            if at + width < len(kept) and cost(kept[at], kept[at + width]) < sum(cost(a, b) for a, b in zip(kept[at : at + width], kept[at + 1 : at + width + 1], strict=True)):
                del kept[at + 1 : at + width]
                break
        else:
            at += 1
    return kept


@pytest.mark.parametrize("name", STUBS)
def test_smooth_equals_the_sequential_rule(spark, monkeypatch, name):
    column, cost = STUBS[name]
    monkeypatch.setattr(graph, "price", lambda segments, cells, keys, model, stepped: segments.select(*keys, column(F.col("i"), F.col("j")).alias("weight")))
    sizes = {1: 60, 2: 3, 3: 1, 4: 45}
    points = spark.createDataFrame([(q, k, float(k), 0.0) for q, n in sizes.items() for k in range(n)], "query_id long, seq int, x double, y double")
    got: dict[int, list[int]] = {}
    for r in sorted(graph.smooth(points, None).collect(), key=lambda r: (r.query_id, r.seq)):
        got.setdefault(r.query_id, []).append(int(r.x))
    assert got == {q: sequential(n, cost, 4) for q, n in sizes.items()}
