"""Region graphs: edges priced along raster lines, shortest, diverse and smoothed paths, neighbourhoods."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import costs
from ..functions.lines import line_pixels, sight_pixels
from ..functions.store import stable

#: An edge list is held by each task for Dijkstra up to so many edges (24 bytes each); beyond, paths are relaxed in rounds.
MOST_EDGES = 2_000_000


def steps(segments: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys with step, x1, y1, z1, lc1, x2, y2, z2 for each pair of consecutive pixels on the line of each segment (keys,
    x0, y0, x1, y1). One join with the cells, by sort: a segment
    is few bytes, its pixels are many. The next pixel comes by a frame over the segment."""
    pixels = segments.select(*keys, F.explode(line_pixels(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("p")).select(*keys, F.col("p.seq").alias("step"), "p.x", "p.y")
    valued = pixels.hint("merge").join(cells.select("x", "y", F.col("elevation").alias("z"), F.col("landcover").alias("lc")), ["x", "y"])
    ahead = W.partitionBy(*keys).orderBy("step")
    paired = valued.select(*keys, "step", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("z1"), F.col("lc").alias("lc1"), *[F.lead(c).over(ahead).alias(f"{c}2") for c in ("x", "y", "z")])
    return paired.where("x2 IS NOT NULL")


def price(segments: DataFrame, cells: DataFrame, keys: list[str], model: str = "vehicle", stepped: bool = True) -> DataFrame:
    """(keys, weight): the cost of each segment, summed over the steps of its line, or from end to end. Segments of one
    pixel cost 0."""
    if not stepped:
        segments = segments.select(*keys, "x0", "y0", "x1", "y1")
        a = cells.select(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("elevation").alias("z1"), F.col("landcover").alias("lc1"))
        b = cells.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("elevation").alias("z2"))
        ends = segments.join(a, ["x0", "y0"]).join(b, ["x1", "y1"]).select(*keys, "z1", "lc1", "z2", F.col("x0").alias("a"), F.col("y0").alias("b"), F.col("x1").alias("x2"), F.col("y1").alias("y2")).withColumnsRenamed({"a": "x1", "b": "y1"})
        return ends.select(*keys, costs.MODELS[model].step().alias("weight"))
    summed = steps(segments, cells, keys).select(*keys, costs.MODELS[model].step().alias("cost")).groupBy(*keys).agg(F.sum("cost").alias("weight"))
    still = segments.where("x0 = x1 AND y0 = y1").select(*keys, F.lit(0.0).alias("weight"))
    return summed.unionByName(still)


def in_sight(segments: DataFrame, cells: DataFrame, keys: list[str], threshold: float = 400) -> DataFrame:
    """(keys, blocked): whether a point of the line of sight lies above the threshold."""
    points = segments.select(*keys, F.explode(sight_pixels(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("p")).select(*keys, "p.x", "p.y")
    return points.join(cells.select("x", "y", "elevation"), ["x", "y"], "left").groupBy(*keys).agg(F.coalesce(F.max(F.col("elevation") > threshold), F.lit(False)).alias("blocked"))


def edges(adjacency: DataFrame, seeds: DataFrame, cells: DataFrame, model: str = "vehicle", stepped: bool = True) -> DataFrame:
    """(src, dst, weight) of (src, dst): both directions priced on their own; lines may differ by direction."""
    a = seeds.select(F.col("seed_id").alias("src"), F.floor("x").cast("int").alias("x0"), F.floor("y").cast("int").alias("y0"))
    b = seeds.select(F.col("seed_id").alias("dst"), F.floor("x").cast("int").alias("x1"), F.floor("y").cast("int").alias("y1"))
    return price(adjacency.hint("merge").join(a, "src").hint("merge").join(b, "dst"), cells, ["src", "dst"], model, stepped)


class Network:
    """A directed graph in memory: neighbour lists sorted by node."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        order = np.lexsort((dst, src))
        self.dst, self.weight = dst[order].tolist(), weight[order].tolist()
        nodes, starts, counts = np.unique(src[order], return_index=True, return_counts=True)
        self.out = {n: (s, s + c) for n, s, c in zip(nodes.tolist(), starts.tolist(), counts.tolist(), strict=True)}
        self.price = dict(zip(zip(src[order].tolist(), self.dst, strict=True), self.weight, strict=True))

    def path(self, source: int, target: int, banned: frozenset = frozenset(), without: frozenset = frozenset()) -> tuple[float, list[int]] | None:
        """Cost and nodes of a cheapest path that uses no banned edge and no node of without; ties by lower node."""
        best, before, heap, done = {source: 0.0}, {}, [(0.0, source)], set()
        while heap:
            cost, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            if node == target:
                nodes = [node]
                while nodes[-1] != source:
                    nodes.append(before[nodes[-1]])
                return cost, nodes[::-1]
            first, last = self.out.get(node, (0, 0))
            for i in range(first, last):
                other = self.dst[i]
                if other in without or (node, other) in banned:
                    continue
                total = cost + self.weight[i]
                if total < best.get(other, np.inf):
                    best[other], before[other] = total, node
                    heapq.heappush(heap, (total, other))
        return None

    def cost(self, nodes: list[int]) -> float:
        return sum(self.price[e] for e in itertools.pairwise(nodes))

    def paths(self, source: int, target: int, k: int, every: int = 10, rise: float | None = None) -> list[tuple[float, list[int]]]:
        """Up to k paths in order of cost: the best, then deviations from the last at each `every`-th node that avoid up to
        `every` edges earlier paths take there. With rise, each costs over rise per cent more than the last."""
        if source == target:
            return [(0.0, [source])]
        first = self.path(source, target)
        if first is None:
            return []
        found, waiting, seen = [first], [], {tuple(first[1])}
        floor = lambda: -np.inf if rise is None else found[-1][0] * (1 + rise / 100)
        while len(found) < k:
            last = found[-1][1]
            for j in range(0, len(last) - 1, every):
                root = last[: j + 1]
                taken = sorted({(p[j], p[j + 1]) for _, p in found if len(p) > j + 1 and p[: j + 1] == root})[:every]
                spur = self.path(last[j], target, frozenset(taken), frozenset(root[:-1]))
                if spur is None:
                    continue
                whole = root[:-1] + spur[1]
                total = self.cost(whole)
                if tuple(whole) in seen or total <= floor():
                    continue
                seen.add(tuple(whole))
                heapq.heappush(waiting, (total, whole))
            while waiting:
                total, whole = heapq.heappop(waiting)
                if total > floor():
                    found.append((total, whole))
                    break
            else:
                break
        return found


def _network(edges_of: DataFrame) -> Callable[[], Network]:
    """The graph, held once by each Python worker; its size is checked."""
    n = edges_of.count()
    if n > MOST_EDGES:
        raise ValueError(f"{n} edges are more than {MOST_EDGES}: use relax")
    frame = edges_of.where("weight < double('infinity')").toPandas()
    held = edges_of.sparkSession.sparkContext.broadcast(tuple(frame[c].to_numpy() for c in ("src", "dst", "weight")))
    cache: list[Network] = []

    def network() -> Network:
        if not cache:
            cache.append(Network(*held.value))
        return cache[0]

    return network


ROUTES = "query_id long, rank int, cost double, nodes array<long>, solved boolean"


def routes(edges_of: DataFrame, located: DataFrame, k: int = 1, every: int = 10, rise: float | None = None) -> DataFrame:
    """(query_id, rank, cost, nodes, solved) of located queries (query_id, src, dst): the k cheapest (diverse) paths.
    A query without a path has one row, unsolved. Queries are dealt over the executors; each task holds the edges."""
    network = _network(edges_of)

    def run(frames):
        for frame in frames:
            rows = []
            for q, s, d in zip(frame["query_id"], frame["src"], frame["dst"], strict=True):
                found = network().paths(int(s), int(d), k, every, rise)
                rows += [(q, i, c, p, True) for i, (c, p) in enumerate(found)] or [(q, 0, None, [], False)]
            yield pd.DataFrame(rows, columns=["query_id", "rank", "cost", "nodes", "solved"])

    return located.select("query_id", "src", "dst").repartition("query_id").mapInPandas(run, ROUTES)


def relax(edges_of: DataFrame, sources: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(query_id, node, cost, before): cheapest costs from each source (query_id, src), by rounds that relax only the
    edges of nodes improved in the last round. For graphs too large for one task."""
    edges_of = stable(edges_of.where("weight < double('infinity')"))
    best = stable(sources.select("query_id", F.col("src").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("before")))
    front = best
    for _ in range(most_rounds):
        reached = front.join(edges_of, front["node"] == edges_of["src"]).groupBy("query_id", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("cost") + F.col("weight")).alias("cost"), F.col("node").alias("before"))).alias("v"))
        reached = reached.select("query_id", "node", "v.cost", "v.before")
        known = best.select("query_id", "node", F.col("cost").alias("old"))
        front = stable(reached.join(known, ["query_id", "node"], "left").where("old IS NULL OR cost < old").drop("old"))
        if not front.take(1):
            return best
        best = stable(best.join(front.select("query_id", "node"), ["query_id", "node"], "left_anti").unionByName(front))
    raise RuntimeError("paths did not settle")


def path_points(found: DataFrame, queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, seq, x, y): start, the seeds of the path's regions, goal; nothing for unsolved queries."""
    nodes = found.where("solved AND rank = 0").select("query_id", F.posexplode("nodes").alias("seq", "seed_id")).join(seeds.select("seed_id", "x", "y"), "seed_id").select("query_id", (F.col("seq") + 1).alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = queries.join(found.where("solved AND rank = 0").select("query_id", F.size("nodes").alias("n")), "query_id")
    start = ends.select("query_id", F.lit(0).alias("seq"), F.col("sx").cast("double").alias("x"), F.col("sy").cast("double").alias("y"))
    goal = ends.select("query_id", (F.col("n") + 1).alias("seq"), F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"))
    return start.unionByName(nodes).unionByName(goal)


def path_lengths(points: DataFrame, scale: float = costs.SCALE) -> DataFrame:
    """(query_id, path_nodes, path_length_m): infinite for fewer than two points."""
    order = W.partitionBy("query_id").orderBy("seq")
    leg = F.sqrt((F.col("x") - F.lag("x").over(order)) ** 2 + (F.col("y") - F.lag("y").over(order)) ** 2)
    return points.withColumn("leg", leg).groupBy("query_id").agg(F.count("*").alias("path_nodes"), (scale * F.coalesce(F.sum("leg"), F.lit(float("inf")))).alias("path_length_m"))


def path_costs(points: DataFrame, cells: DataFrame, model: str = "vehicle", stepped: bool = True) -> DataFrame:
    """(query_id, cost): the summed cost of the legs between points, rounded half to even."""
    order = W.partitionBy("query_id").orderBy("seq")
    rounded = points.select("query_id", "seq", F.rint("x").cast("int").alias("x0"), F.rint("y").cast("int").alias("y0"))
    legs = rounded.withColumn("x1", F.lead("x0").over(order)).withColumn("y1", F.lead("y0").over(order)).where("x1 IS NOT NULL")
    return price(legs, cells, ["query_id", "seq"], model, stepped).groupBy("query_id").agg(F.sum("weight").alias("cost"))


def report(found: DataFrame, points: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, solved, path_nodes, region_nodes, cost, cost_scaled_x1e4, path_length_m), a row for each query."""
    own = found.where("rank = 0").select("query_id", "solved", F.size("nodes").alias("region_nodes"), "cost")
    joined = queries.select("query_id").join(own, "query_id", "left").join(path_lengths(points), "query_id", "left")
    return joined.select("query_id", F.coalesce("solved", F.lit(False)).alias("solved"), F.coalesce("path_nodes", F.lit(0)).alias("path_nodes"), F.coalesce("region_nodes", F.lit(0)).alias("region_nodes"), "cost", (F.col("cost") / 1e4).alias("cost_scaled_x1e4"), "path_length_m")


def summary(reported: DataFrame) -> DataFrame:
    """One row: mean and sample deviation of scaled cost and length over the solved queries."""
    return reported.where("solved").agg(F.count("*").alias("n"), F.avg("cost_scaled_x1e4").alias("mean_cost"), F.stddev_samp("cost_scaled_x1e4").alias("std_cost"), F.avg("path_length_m").alias("mean_length"), F.stddev_samp("path_length_m").alias("std_length"))


def hops(adjacency: DataFrame, path: DataFrame, n: int, include_path: bool = False) -> DataFrame:
    """(node): nodes exactly n hops from some node of path (node), without the path's own unless asked."""
    reached = stable(path.select(F.col("node").alias("origin"), "node").distinct())
    front = reached
    for _ in range(n):
        after = front.join(adjacency, front["node"] == adjacency["src"]).select("origin", F.col("dst").alias("node")).distinct()
        front = stable(after.join(reached, ["origin", "node"], "left_anti"))
        reached = stable(reached.unionByName(front))
    found = front.select("node").distinct()
    return found if include_path else found.join(path.select("node"), "node", "left_anti")


def smooth(points: DataFrame, cells: DataFrame, model: str = "vehicle", most: int = 4, least: int = 2) -> DataFrame:
    """points with shortcuts: from each point the widest stretch of at most `most` legs that is cheaper straight is cut,
    again and again, so that one may grow over any number of original legs.

    Legs and shortcuts over most * most legs are priced at once. A path that needs a longer one asks for those from that
    point, over twice as many legs each time; only paths that ask take part in further rounds. Only the choice is
    sequential, per path."""
    order = W.partitionBy("query_id").orderBy("seq")
    placed = points.select("query_id", (F.row_number().over(order) - 1).alias("i"), F.col("x"), F.col("y"))
    whole = stable(placed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("ps")))
    first = most * most

    def priced(spans: DataFrame) -> DataFrame:
        """(query_id, i, j, weight) of the pairs from i to j, `after` < j - i <= `reach`, of (query_id, ps, i, after, reach)."""
        last = F.least(F.size("ps") - 1, F.col("i") + F.col("reach"))
        pairs = spans.where(F.col("i") + F.col("after") < last).select("query_id", "ps", "i", F.explode(F.sequence(F.col("i") + F.col("after") + 1, last)).alias("j"))
        p, q = F.get("ps", F.col("i")), F.get("ps", F.col("j"))
        segments = pairs.select("query_id", "i", "j", F.rint(p["x"]).cast("int").alias("x0"), F.rint(p["y"]).cast("int").alias("y0"), F.rint(q["x"]).cast("int").alias("x1"), F.rint(q["y"]).cast("int").alias("y1"))
        return price(segments, cells, ["query_id", "i", "j"], model, stepped=False).select("query_id", "i", "j", "weight")

    def choose(frames):
        for frame in frames:
            rows = []
            for query, ws, rs, ps in zip(frame["query_id"], frame["ws"], frame["rs"], frame["ps"], strict=True):
                weight = {(w["i"], w["j"]): w["weight"] for w in (ws if ws is not None else [])}
                reach = {}
                for r in rs if rs is not None else []:
                    reach[r["i"]] = max(r["reach"], reach.get(r["i"], first))
                kept, at, asked = [q["i"] for q in ps], 0, None
                while at < len(kept) - least and asked is None:
                    for width in range(most, least - 1, -1):
                        if at + width >= len(kept):
                            continue
                        here = reach.get(kept[at], first)
                        if kept[at + width] - kept[at] > here:
                            asked = (query, -1, float(kept[at]), float(2 * here))
                            break
                        legs = [weight.get(e) for e in itertools.pairwise(kept[at : at + width + 1])]
                        straight = weight.get((kept[at], kept[at + width]))
                        if straight is not None and None not in legs and straight < sum(legs):
                            del kept[at + 1 : at + width]
                            break
                    else:
                        at += 1
                by = {q["i"]: q for q in ps}
                rows += [asked] if asked is not None else [(query, n, by[i]["x"], by[i]["y"]) for n, i in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["query_id", "seq", "x", "y"])

    spans = whole.select("query_id", "ps", F.explode(F.sequence(F.lit(0), F.size("ps") - 1)).alias("i"), F.lit(0).alias("after"), F.lit(first).alias("reach"))
    known, asked, live, done = stable(priced(spans)), None, whole, None
    while True:
        weights = known.groupBy("query_id").agg(F.collect_list(F.struct("i", "j", "weight")).alias("ws"))
        reaches = live.select("query_id", F.lit(None).cast("array<struct<i:int,reach:int>>").alias("rs")) if asked is None else asked.groupBy("query_id").agg(F.collect_list(F.struct("i", "reach")).alias("rs"))
        out = stable(live.join(weights, "query_id", "left").join(reaches, "query_id", "left").select("query_id", "ws", "rs", "ps").mapInPandas(choose, "query_id long, seq int, x double, y double"))
        whole_paths = out.where("seq >= 0")
        done = whole_paths if done is None else done.unionByName(whole_paths)
        wanted = out.where("seq < 0").select("query_id", F.col("x").cast("int").alias("i"), F.col("y").cast("int").alias("reach"))
        if not wanted.take(1):
            return done
        live = live.join(wanted.select("query_id"), "query_id", "left_semi")
        fresh = live.join(wanted, "query_id").select("query_id", "ps", "i", (F.col("reach") / 2).cast("int").alias("after"), "reach")
        known = stable(known.join(wanted.select("query_id"), "query_id", "left_semi").unionByName(priced(fresh)))
        asked = wanted if asked is None else stable(asked.join(wanted.select("query_id"), "query_id", "left_semi").unionByName(wanted))


def refine(points: DataFrame, cells: DataFrame, samples: int = 20, reach: float = 3.0, seed: int = 0, model: str = "vehicle") -> DataFrame:
    """points moved once, each inner point to the cheapest of `samples` fixed pseudo-random places within reach (its own
    included) by the cost of the two legs it joins."""
    order = W.partitionBy("query_id").orderBy("seq")
    near = points.withColumn("px", F.lag("x").over(order)).withColumn("py", F.lag("y").over(order)).withColumn("qx", F.lead("x").over(order)).withColumn("qy", F.lead("y").over(order))
    inner = near.where("px IS NOT NULL AND qx IS NOT NULL").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples))))
    draw = lambda salt: (F.pmod(F.xxhash64("query_id", "seq", "k", F.lit(seed), F.lit(salt)), F.lit(2001)) / 1000.0 - 1) * reach
    tried = inner.withColumn("tx", F.rint(F.col("x") + F.when(F.col("k") == 0, 0.0).otherwise(draw(1)))).withColumn("ty", F.rint(F.col("y") + F.when(F.col("k") == 0, 0.0).otherwise(draw(2))))
    leg = lambda a, b, c, d, n: tried.select("query_id", "seq", "k", F.lit(n).alias("leg"), *[F.rint(v).cast("int").alias(m) for v, m in zip((a, b, c, d), ("x0", "y0", "x1", "y1"), strict=True)])
    legs = leg("px", "py", "tx", "ty", 0).unionByName(leg("tx", "ty", "qx", "qy", 1))
    total = price(legs, cells, ["query_id", "seq", "k", "leg"], model, stepped=False).groupBy("query_id", "seq", "k").agg(F.sum("weight").alias("cost"), F.count("*").alias("n")).where("n = 2")
    best = total.groupBy("query_id", "seq").agg(F.min(F.struct("cost", "k")).alias("m")).select("query_id", "seq", F.col("m.k").alias("k"))
    moved = tried.join(best, ["query_id", "seq", "k"]).select("query_id", "seq", F.col("tx").alias("nx"), F.col("ty").alias("ny"))
    return points.join(moved, ["query_id", "seq"], "left").select("query_id", "seq", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"))
