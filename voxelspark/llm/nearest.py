"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Method: inner products become distances by one extra coordinate (``sqrt(M**2 - |x|**2)``, M the largest
norm). ``tables`` hash tables, each of ``projections`` Gaussian projections cut into slots of ``width``
neighbour distances, index every vector. A query visits, in each table, perturbed buckets in order of the
estimated chance that a neighbour at the typical distance lies there (the product over projections of the
Gaussian mass of the slot, seen from where the query stands in its own), until the chances sum to
``success``. The candidates of all tables are merged and ranked by the exact inner product of the original
vectors in double precision.

Equal vectors are one point that carries its smallest ids (one more than asked for is all that can be
needed), so a vector held by a third of all rows is one entry. Buckets are cut into units of bounded size,
on both sides. A query that meets fewer candidates than asked for is completed by an exact pass in blocks.

Only the typical neighbour distance is taken from a bounded sample (``SAMPLE`` vectors); every vector is
indexed. The number of projections grows with the logarithm of the number of vectors, so that buckets don't
grow with it. Defined results: vectors that are null, empty, zero or hold null or non-finite components and
rows without id take no part; vectors of different lengths have no inner product, so a query's candidates are
those of its own length; ties go to the smaller id, however many there are; rows that share an id are one
candidate each for others and none for themselves; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.llm.hot import join_hot
from voxelspark.llm.storage import cut, table
from voxelspark.llm.vectors import by_length, matrix, rows_of
from voxelspark.llm.workers import tidy

SAMPLE, SEED = 2000, 20_240_501
#: Vectors and queries of a unit, at most (on average of a bucket's units).
POINTS, QUERIES = 1024, 512
#: Vectors up to which three projections a table are enough; each further one divides a bucket by about SPLIT.
FEW, SPLIT = 100_000, 3.0
_UNIT = "q long, p long, score double"


@dataclass
class Index:
    """Projections, offsets and slot width of every table, and the distance neighbours are expected at."""

    planes: np.ndarray
    offsets: np.ndarray
    width: float
    largest: float
    distance: float
    success: float

    @classmethod
    def of(cls, dimensions: int, largest: float, distance: float, tables: int, projections: int, width: float, success: float) -> Index:
        r = np.random.default_rng(SEED)
        planes = r.normal(size=(tables, projections, dimensions + 1))
        return cls(planes, r.uniform(size=(tables, projections)), width * distance, largest, distance, success)

    def _slots(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return (np.einsum("nd,tpd->ntp", x, self.planes[:, :, :-1]) + extra[:, None, None] * self.planes[None, :, :, -1]) / self.width + self.offsets

    def points(self, x: np.ndarray) -> np.ndarray:
        """Slot of each vector in each projection of each table."""
        return np.floor(self._slots(x, np.sqrt(np.maximum(0.0, self.largest**2 - (x * x).sum(axis=1))))).astype(np.int64)

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Place of each query, scaled to the largest norm, in slot units."""
        return self._slots(x * (self.largest / np.sqrt((x * x).sum(axis=1)))[:, None], np.zeros(len(x)))

    def probes(self, place: np.ndarray) -> list[tuple[int, ...]]:
        """Buckets of one table for a query that stands at ``place``, most promising first, up to ``success``."""
        spread = self.distance / self.width
        choices = []
        for at in place:
            home = math.floor(at)
            reach = math.ceil(4 * spread) + 1
            mass = [(_normal((home + k + 1 - at) / spread) - _normal((home + k - at) / spread), home + k) for k in range(-reach, reach + 1)]
            choices.append(sorted(((m, s) for m, s in mass if m > 1e-6), reverse=True))
        out, total = [], 0.0
        first = (0,) * len(place)
        chance = lambda c: math.prod(choices[d][i][0] for d, i in enumerate(c))
        heap, seen = [(-chance(first), first)], {first}
        while heap and total < self.success:
            least, at = heapq.heappop(heap)
            total -= least
            out.append(tuple(choices[d][i][1] for d, i in enumerate(at)))
            for d in range(len(at)):
                after = (*at[:d], at[d] + 1, *at[d + 1 :])
                if after[d] < len(choices[d]) and after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (-chance(after), after))
        return out


def _normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _bucket(slots: np.ndarray) -> np.ndarray:
    """A number for each row of slots (a few small integers)."""
    out = np.zeros(len(slots), np.int64)
    for k in range(slots.shape[1]):
        out = out * np.int64(1_000_003) + slots[:, k]
    return out


def _hashed(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                slots = index.points(matrix(batch.column(1)))
                for t in range(slots.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), t, np.int32)), pa.array(_bucket(slots[:, t])), batch.column(0), batch.column(1)], names=["t", "bucket", "p", "vector"])

    return run


def _probed(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                places = index.queries(matrix(batch.column(1)))
                for i in range(0, len(batch), 256):
                    t, bucket, row = [], [], []
                    for k in range(i, min(i + 256, len(batch))):
                        for table_ in range(places.shape[1]):
                            found = index.probes(places[k, table_])
                            bucket.append(_bucket(np.array(found, np.int64).reshape(len(found), -1)))
                            t.append(np.full(len(found), table_, np.int32))
                            row.append(np.full(len(found), k))
                    row = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(t)), pa.array(np.concatenate(bucket)), batch.column(0).take(row), batch.column(1).take(row)], names=["t", "bucket", "q", "vector"])

    return run


def exact(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products, each summed alike wherever it stands."""
    return (points * queries).sum(axis=1)


def _best(k: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(points) or not len(queries):
            return pa.table({"q": pa.array([], pa.int64()), "p": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, y = matrix(points["vector"]), matrix(queries["vector"])
        p, q = points["p"].to_numpy(), queries["q"].to_numpy()
        order = np.argsort(p, kind="stable")
        x, p = x[order], p[order]
        longest, out = float(np.sqrt((x * x).sum(axis=1)).max()), []
        for i in range(0, len(q), 256):
            rough = y[i : i + 256] @ x.T
            # all that rounding of the product table may hide among the best, however many: the exact score decides
            least = np.partition(rough, len(p) - min(len(p), k), axis=1)[:, len(p) - min(len(p), k)]
            slack = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((y[i : i + 256] ** 2).sum(axis=1)) * longest
            for r in range(len(rough)):
                at = np.flatnonzero(rough[r] >= least[r] - slack[r])
                score = exact(y[i + r], x[at])
                best = np.lexsort((p[at], -score))[:k]
                out.append((np.full(len(best), q[i + r]), p[at][best], score[best]))
        return pa.table({"q": np.concatenate([o[0] for o in out]), "p": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    return run


def _meet(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best points of each query within each (t, bucket), in units of bounded size on both sides."""
    held = points.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / POINTS).cast("int").alias("pp"))
    asked = queries.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qp"))
    shape = held.join(asked, ["t", "bucket"])
    # each point in one part of its bucket, once for each part of the queries; and the other way round
    left = points.join(shape, ["t", "bucket"]).withColumn("a", F.pmod(F.xxhash64("p"), F.col("pp")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("qp") - 1)))
    right = queries.join(shape, ["t", "bucket"]).withColumn("b", F.pmod(F.xxhash64("q"), F.col("qp")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("pp") - 1)))
    by = ["t", "bucket", "a", "b"]
    return left.select(*by, "p", "vector").groupBy(*by).cogroup(right.select(*by, "q", "vector").groupBy(*by)).applyInArrow(_best(k), _UNIT)


def _top(found: DataFrame, k: int) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "p"))
    return found.dropDuplicates(["q", "p"]).withColumn("place", first).where(F.col("place") <= k).drop("place")


def _calibrated(points: DataFrame, n: int, k: int) -> tuple[int, float, float]:
    """(dimensions, largest norm, typical distance of a neighbour) from all norms and a bounded sample."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    largest = points.agg(F.max(norm)).first()[0]
    x = matrix(points.orderBy(F.xxhash64("p", F.lit(SEED)), "p").limit(SAMPLE).select("vector").toArrow()["vector"])
    some = x[:: max(1, len(x) // 200)]
    scaled = some * (largest / np.sqrt((some * some).sum(axis=1)))[:, None]
    products = np.sort(scaled @ x.T, axis=1)[:, ::-1]
    # the place among the sample that the k-th of all points takes; the first place is the query itself
    place = min(len(x) - 1, max(1, round(k * len(x) / max(1, n))))
    product = float(np.median(products[:, place])) if len(x) > 1 else 0.0
    return x.shape[1], largest, math.sqrt(max(1e-12, 2 * largest * largest - 2 * product))


def projections_for(n: int) -> int:
    """Projections a table for ``n`` vectors."""
    return 3 + max(0, math.ceil(math.log(max(n, 1) / FEW, SPLIT)))


def search(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, tables: int = 4, projections: int | None = None, width: float = 1.2, success: float = 0.62
) -> DataFrame:
    """``query_id, rank, id_col, score`` for each row whose id is divisible by ``every``, against all other rows."""
    rows = table(rows_of(df, id_col, vector_col), "vectors")
    found = [_search(part, every, k, tables, projections, width, success) for part in by_length(rows)]
    empty = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.unionByName, found or [empty]).withColumnRenamed("id", id_col)


def _search(rows: DataFrame, every: int, k: int, tables: int, projections: int | None, width: float, success: float) -> DataFrame:
    """``query_id, rank, id, score`` among vectors of one length."""
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    # a point: its smallest ids (at most k + 1, so the list is bounded)
    points = few.groupBy("vector").agg(F.min("id").alias("p"), F.array_sort(F.collect_list("id")).alias("ids"))
    points = table(points, "vector-points")
    asking = rows.where(F.col("id") % every == 0).distinct()
    # one vector may be asked for by a third of all queries
    asked_for = asking.groupBy("vector").agg(F.count(F.lit(1)).alias("weight"))
    known = asked_for.join(points.select("vector", "p"), "vector")
    queries = table(join_hot(asking, known, ["vector"], "weight", asking.count()).select(F.col("id").alias("query"), "p"), "vector-queries")
    n = points.count()
    flat = points.select("p", "vector")
    kind = points.schema["vector"].dataType.simpleString()
    asked = flat.join(queries.select("p").distinct(), "p").select(F.col("p").alias("q"), "vector")
    index = Index.of(*_calibrated(flat, n, k), tables, projections or projections_for(n), width, success)
    found = _meet(flat.mapInArrow(tidy(_hashed(index)), f"t int, bucket long, p long, vector {kind}"), asked.mapInArrow(tidy(_probed(index)), f"t int, bucket long, q long, vector {kind}"), k + 1)
    found = table(_top(found, k + 1), "vector-found")
    short = cut(asked.join(found.groupBy("q").count(), "q", "left").where(F.coalesce("count", F.lit(0)) < min(n, k + 1)).select("q", "vector"))
    if not short.isEmpty():
        block = lambda d: d.withColumn("t", F.lit(0)).withColumn("bucket", F.lit(0).cast("long"))
        found = found.join(short.select("q"), "q", "left_anti").unionByName(_top(_meet(block(flat), block(short), k + 1), k + 1))
    members = found.join(points.select("p", "ids"), "p").select("q", "score", F.explode("ids").alias("id"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    # the k + 1 best of each distinct query vector; one of them may be the query's own row
    members = members.withColumn("place", best).where(F.col("place") <= k + 1).drop("place")
    # a row a query vector, so that the queries of one vector stay where they are if they are many
    listed = members.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "score"))).alias("best"))
    askers = queries.groupBy("p").agg(F.count(F.lit(1)).alias("weight"))
    each = join_hot(queries, listed.join(askers, listed["q"] == askers["p"]).select("p", "weight", "best"), ["p"], "weight", queries.count())
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query")), 1, k)
    return each.select(F.col("query").alias("query_id"), F.posexplode(others).alias("place", "b")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("b.id").alias("id"), F.col("b.score").alias("score"))
