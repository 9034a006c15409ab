"""Whitening of embeddings by the singular values of the centred rows.

Vectors become whole numbers ``x = floor(SCALE c) + OFFSET``, whose sums are exact. Spark MLlib's ``computeSVD`` on the
centred rows, distributed, gives singular values s and right vectors; with ``n`` rows the covariance has eigenvalues
``s^2 / n`` (divisor n) and those vectors. The total variance is not summed from the singular values: it comes from the
exact deviations ``sum (n x - S)^2`` of all rows, divided by ``n^3``. A row is projected on each component and divided by
the root of its eigenvalue; how far the covariance of all whitened rows is from the identity is measured, by
``computeCovariance`` on them, not assumed.

What reaches the driver has the size of the dimension: sums, components and one covariance of ``components`` squared.

Defined results: rows without a vector, or with a null or non-finite entry, are dropped; zero vectors, repeated rows
and null ids take part. Vectors of different lengths have no common covariance: each length is fitted for itself, an
empty vector gives no row. Entries whose multiple doesn't fit a whole number of 62 bits count as the nearest that does,
and a deviation beyond 38 digits is null. Components beyond the rank (singular value below ``RANK`` of the largest) don't
exist and give no row, so equal rows or a single one give none. Extra columns are ignored. An empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.storage import table
from voxelspark.llm.workers import tidy

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
#: Singular values below this part of the largest are rounding: they are roots of eigenvalues, which are known to some 1e-14 of the largest.
RANK = 1e-6
#: Up to this dimension all components are computed, by a dense solver that is exact to double precision.
DENSE = 4096
_LARGEST, LARGEST_DECIMAL = float(1 << 62), 10**38


@dataclass
class Whitening:
    """One fit: ``n`` rows with sums ``sums``; ``basis`` is dimension x components, ``variances`` their eigenvalues."""

    n: int
    sums: list[int]
    basis: np.ndarray
    variances: np.ndarray


def whole(vector: str | Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """The vector's entries as whole numbers."""
    near = lambda c: F.least(F.greatest(c.cast("double") * scale, F.lit(-_LARGEST)), F.lit(_LARGEST))
    return F.transform(vector, lambda c: F.floor(near(c)) + F.lit(offset).cast("long"))


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def _centred(sums: list[int], n: int) -> Column:
    """``x - S / n``: the whole part of the mean is taken off exactly."""
    mean = F.lit([s // n for s in sums])
    rest = F.lit([(s % n) / n for s in sums])
    return F.zip_with(F.zip_with("x", mean, lambda a, m: (a - m).cast("double")), rest, lambda a, r: a - r)


def _matrix(rows: DataFrame, column: Column) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows(x array<long>)``, all of one length; None where no component has a variance."""
    entries = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    found = sorted(entries.collect())
    if not found:
        return None
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    d = len(sums)
    solved = _matrix(rows, _centred(sums, n)).computeSVD(d if d <= DENSE else min(components, d), computeU=False, rCond=RANK) if n > 1 else None
    # equal rows leave no singular value
    if solved is None or not len(solved.s) or not solved.s[0]:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0))
    variances = np.asarray(solved.s.toArray())[:components] ** 2 / n
    return Whitening(n, sums, np.asarray(solved.V.toArray())[:, : len(variances)], variances)


def apply(rows: DataFrame, w: Whitening) -> DataFrame:
    """``id, deviation, spread, whitened`` of ``rows(id, x)``: ``sum (n x - S)^2`` as a decimal(38, 0), exact, and as a double, and the row's components."""
    axes, kind = w.basis / np.sqrt(w.variances), rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(w.sums, object)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(object)
            # whole numbers of any size
            off = w.n * x - sums
            deviation = (off * off).sum(axis=1).tolist() if batch.num_rows else []
            whitened = (off.astype(float) / w.n) @ axes
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([Decimal(v) if v < LARGEST_DECIMAL else None for v in deviation], pa.decimal128(38, 0)),
                    pa.array([float(v) for v in deviation], pa.float64()),
                    pa.ListArray.from_arrays(np.arange(0, whitened.size + 1, axes.shape[1], dtype=np.int32), pa.array(whitened.reshape(-1))),
                ],
                names=["id", "deviation", "spread", "whitened"],
            )

    return rows.select("id", "x").mapInArrow(tidy(run), f"id {kind}, deviation decimal(38,0), spread double, whitened array<double>")


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance (divisor n, centred) of ``whitened``, minus the identity."""
    covariance = np.asarray(_matrix(rows, F.col("whitened")).computeCovariance().toArray()) * (n - 1) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is a decimal(38, 0) here.
    """
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(usable("vector"))
    numbers = table(named.select("id", whole("vector").alias("x")), "whitening-numbers")
    lengths = sorted(r[0] for r in numbers.select(F.size("x").alias("d")).distinct().collect())
    out = []
    for d in lengths:
        rows = numbers.where(F.size("x") == d) if len(lengths) > 1 else numbers
        w = fit(rows, components)
        if not len(w.variances):
            continue
        done = table(apply(rows, w), "whitened")
        trace = done.agg(F.sum("spread")).first()[0] / float(w.n) ** 3
        wrong = identity_error(done, w.n, len(w.variances))
        each = done.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        explained = F.get(F.lit((w.variances / trace).tolist()), F.col("at"))
        out.append(each.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(wrong).alias("identity_error")))
    if not out:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return reduce(DataFrame.unionByName, out)
