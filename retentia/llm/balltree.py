"""Exact top-k inner-product search with ball trees per shard.

Vectors are routed into regions by a top tree of hyperplanes, fitted on a sample
of ``SAMPLE`` vectors per region; every row is routed.  A region keeps its centre
and radius and is cut into shards of about ``SHARD`` rows; each shard's ball tree
is built once and stored.  A query visits regions in the order of their largest
possible inner product (query . centre + |query| * radius): first the best one,
then the next ``NEXT``, then the rest, and after each round its k-th score so far
becomes the bound, so a region that cannot reach it is never joined with the query.
Inside a shard, nodes are visited in the order of the same bound, against the
larger of the shared k-th score and the query's own.

A task holds one shard's tree and a block of at most about ``BLOCK`` queries.  The
driver holds the top tree and one ball per region, at most ``REGIONS`` of them
whatever the data; regions with more rows have more shards.

Scores are exact integers: components are floor(1024 * x).  Bounds are computed
in double precision with a margin above their rounding error.

Defined results: vectors that are null, or hold a null or non-finite component,
and rows without id take no part; vectors of different length are compared over
their common components; rows that share an id are all candidates, but never of
a query with that id, and the vector of a repeated query id is the largest in
array order; ties go to the smaller id.  Components must stay below 2**25 after
scaling (x below 32768), so that sums are exact; larger ones raise an error.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import hold, release

SCALE = 1024
SHARD, BLOCK, LEAF = 16_384, 4_096, 64
#: Regions at most, sampled vectors per region, regions of the second round.
REGIONS, SAMPLE, NEXT = 1_024, 16, 8


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, q): usable rows with integer components."""
    x = F.col("v")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    q = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select("vec_id", q.alias("q"))
    big = F.exists("q", lambda c: F.abs(c) >= 2**25)
    return rows.withColumn("q", F.when(big, F.raise_error(F.lit("a component is too large for exact scores"))).otherwise(F.col("q")))


class Tree:
    """A ball tree over integer vectors: median splits along the widest direction."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # centre, radius, smallest id, first, end, left, right
        self.order, self.ids, self.x = order, ids, x
        self._build(0, len(ids))
        self.ids, self.x = ids[order], x[order]
        self.centres = np.array([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])

    def _build(self, first: int, end: int) -> int:
        rows = self.order[first:end]
        x = self.x[rows]
        centre = x.mean(0)
        away = np.sqrt(((x - centre) ** 2).sum(1))
        me = len(self.nodes)
        self.nodes.append(())
        left = right = -1
        radius = float(away.max())
        if end - first > LEAF and radius > 0:
            far = x[away.argmax()]
            split = np.argpartition(((x - far) ** 2).sum(1), (end - first) // 2)
            self.order[first:end] = rows[split]
            middle = first + (end - first) // 2
            left, right = self._build(first, middle), self._build(middle, end)
        self.nodes[me] = (centre, radius, int(self.ids[rows].min()), first, end, left, right)
        return me

    def search(self, query: np.ndarray, query_id: int, k: int, known: int | None) -> list[tuple[int, int]]:
        """The k best (score, -id), best first; scores below ``known`` are not needed."""
        norm = float(np.sqrt(query @ query))
        bounds = self.centres @ query + norm * self.radii
        bounds += 1e-9 * (np.abs(bounds) + norm * np.abs(self.radii) + 1) + 0.5  # above rounding, below the next integer
        best: list[tuple[int, int]] = []  # a heap: the worst kept result first
        waiting = [(-bounds[0], 0)]
        while waiting:
            bound, at = heapq.heappop(waiting)
            least = best[0][0] if len(best) == k else None
            if known is not None and (least is None or known > least):
                least = known
            if least is not None and -bound < least:
                break  # every other ball is bounded by this one
            _, _, smallest, first, end, left, right = self.nodes[at]
            if len(best) == k and int(-bound) <= best[0][0] and -smallest < best[0][1]:
                continue  # ties at best, and all with larger ids
            if left >= 0:
                heapq.heappush(waiting, (-bounds[left], left))
                heapq.heappush(waiting, (-bounds[right], right))
                continue
            scores = (self.x[first:end] @ query).astype(np.int64)
            floor = least if least is not None else scores.min()
            for i in np.flatnonzero(scores >= floor).tolist():
                found = (int(scores[i]), -int(self.ids[first + i]))
                if -found[1] == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return sorted(best, reverse=True)


def _matrix(column, width: int) -> np.ndarray:
    """Rows padded with zeros: missing components add nothing to a product."""
    out = np.zeros((len(column), width))
    for i, row in enumerate(column):
        v = row.values.to_numpy(zero_copy_only=False)
        out[i, : len(v)] = v
    return out


class TopTree:
    """Halvings of a sample along the direction to its farthest vector; leaves are regions."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.planes: list[tuple] = []  # direction, threshold, child below or at it, child above it; children < 0 are regions
        self.centres: list[np.ndarray] = []
        self._split(sample, regions)

    def _leaf(self, x: np.ndarray) -> int:
        self.centres.append(x.mean(0) if len(x) else np.zeros(x.shape[1]))
        return -len(self.centres)

    def _split(self, x: np.ndarray, regions: int) -> int:
        if regions < 2 or len(x) < 2:
            return self._leaf(x)
        centre = x.mean(0)
        along = x[((x - centre) ** 2).sum(1).argmax()] - centre
        at = x @ along
        threshold = float(np.sort(at)[(len(at) - 1) // 2])
        low = at <= threshold
        if low.all():  # half of the sample or more lies on the far side: cut below it
            below = at[at < threshold]
            if not len(below):
                return self._leaf(x)
            threshold = float(below.max())
            low = at <= threshold
        me = len(self.planes)
        self.planes.append(())
        left = self._split(x[low], regions // 2)
        right = self._split(x[~low], regions - regions // 2)
        self.planes[me] = (along, threshold, left, right)
        return me

    def region(self, x: np.ndarray) -> np.ndarray:
        """The region of every row."""
        out = np.zeros(len(x), np.int64)
        waiting = [(0 if self.planes else -1, np.arange(len(x)))]
        while waiting:
            at, rows = waiting.pop()
            if at < 0:
                out[rows] = -at - 1
                continue
            along, threshold, left, right = self.planes[at]
            low = x[rows] @ along <= threshold
            waiting += [(left, rows[low]), (right, rows[~low])]
        return out


def _route(top: TopTree, width: int):
    centres = np.array(top.centres)

    def run(batches):
        for batch in batches:
            x = _matrix(batch["q"], width)
            region = top.region(x)
            away = np.sqrt(((x - centres[region]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["q"], pa.array(region.astype(np.int32)), pa.array(away)],
                names=["vec_id", "q", "region", "away"])

    return run


def _pairs(balls: dict[int, tuple[np.ndarray, float]], width: int, first: int, end: int | None):
    """(query_id, q, known, region): the regions at places first to end - 1 of a query's order that can reach ``known``."""
    numbers = np.array(sorted(balls), np.int32)
    centres = np.array([balls[r][0] for r in numbers.tolist()])
    radii = np.array([balls[r][1] for r in numbers.tolist()])

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                q = _matrix(batch["q"], width)
                norm = np.sqrt((q * q).sum(1))[:, None]
                bounds = q @ centres.T + norm * radii
                bounds += 1e-9 * (np.abs(bounds) + norm * radii + 1) + 0.5  # above rounding, below the next integer
                order = np.argsort(-bounds, axis=1, kind="stable")[:, first:end]
                known = np.array([-np.inf if v is None else v for v in batch["known"].to_pylist()])
                rows, places = np.nonzero(np.take_along_axis(bounds, order, 1) >= known[:, None])
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [taken["query_id"], taken["q"], taken["known"], pa.array(numbers[order[rows, places]])],
                    names=["query_id", "q", "known", "region"])

    return run


def _build(width: int):
    def run(shard: pa.Table) -> pa.Table:
        tree = Tree(shard["vec_id"].to_numpy(), _matrix(shard["q"].combine_chunks(), width))
        return pa.table({"region": shard["region"][:1], "shard": shard["shard"][:1], "tree": pa.array([pickle.dumps(tree, 5)])})

    return run


_FOUND = "query_id long, vec_id long, score long"


def _search(k: int, width: int):
    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if shard.num_rows and block.num_rows:
            tree = pickle.loads(shard["tree"][0].as_py())
            queries = _matrix(block["q"].combine_chunks(), width)
            for i, (query_id, known) in enumerate(zip(block["query_id"].to_pylist(), block["known"].to_pylist())):
                rows += [(query_id, -v, s) for s, v in tree.search(queries[i], query_id, k, known)]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _lookup(numbers: dict[int, int]):
    """A number per region, at most ``REGIONS`` of them."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.col("region"))


def top_k(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = hold(quantised(vectors, key, vector))
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    regions = max(1, min(REGIONS, -(-n // SHARD)))
    want = regions * SAMPLE
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "q"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * want / max(n, 1))))
    top = TopTree(_matrix(sample.select("q").limit(want).toArrow()["q"].combine_chunks(), width), regions)
    routed = hold(rows.mapInArrow(_route(top, width), "vec_id long, q array<long>, region int, away double"))
    sizes = routed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()
    if not sizes:
        release(rows, routed)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    balls = {r["region"]: (top.centres[r["region"]], r["away"] * (1 + 1e-9)) for r in sizes}
    shards = {r["region"]: -(-r["n"] // SHARD) for r in sizes}
    place = F.pmod(F.xxhash64("vec_id", "q", F.monotonically_increasing_id()), _lookup(shards)).cast("int")  # copies spread too
    trees = hold(routed.withColumn("shard", place).groupBy("region", "shard").applyInArrow(
        _build(width), "region int, shard int, tree binary"))
    asked = hold(rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.max("q").alias("q")))
    release(rows, routed)
    best = None
    for first, end in ((0, 1), (1, 1 + NEXT), (1 + NEXT, None)):
        if first >= len(balls):
            break
        if best is None:
            bounded = asked.withColumn("known", F.lit(None).cast("long"))
        else:
            bounded = asked.join(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("known")), "query_id", "left")
        pairs = hold(bounded.mapInArrow(_pairs(balls, width, first, end), "query_id long, q array<long>, known long, region int"))
        asking = {r["region"]: r["count"] for r in pairs.groupBy("region").count().collect()}
        if not asking:
            release(pairs)
            break
        blocks = {r: -(-m // BLOCK) for r, m in asking.items()}
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64("query_id"), _lookup(blocks)).cast("int")).withColumn(
            "shard", F.explode(F.sequence(F.lit(0), _lookup({r: shards[r] - 1 for r in asking}))))
        opened = trees.where(F.col("region").isin(list(asking))).withColumn(
            "block", F.explode(F.sequence(F.lit(0), _lookup(blocks) - 1)))
        keys = ("region", "shard", "block")
        found = opened.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_search(k, width), _FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        newer = hold(_best(found, k))
        release(pairs, *([best] if best is not None else []))
        best = newer
    release(trees, asked)
    if best is None:  # nothing is asked
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", "rank", "vec_id", "score")
