"""Embedding whitening by polarisation (operator 11).

Entries become integers, so all sums are exact whatever the order of tasks. Centred values are squared for every dimension and for the sum of every pair
of dimensions; as var(a + b) - var(a) - var(b) = 2 cov(a, b), differences of those variances give the whole covariance, which eigh takes apart.

Values are centred at the floor of their mean, which keeps them small integers; the rest of the mean, below one, is taken off the sums as an exact
fraction. Tasks add up their own rows and send one number a pair of dimensions; those d * (d + 1) / 2 totals are what the driver sees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, packed

SCALE, SHIFT = 64, 1_000_000  # an entry c becomes floor(SCALE * c) + SHIFT
MOST = 2**63 - 1
COMPONENTS = 16
FLAT = 1e-10  # a component with no more than this share of the largest eigenvalue has no variance to speak of
ROWS = 2_048  # rows that are squared at once
LIMB = 60  # bits of an exact total's lower part


def sound(vector: Column) -> Column:
    """Neither null nor with null or non-finite entries."""
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))


def quantised(vector: Column) -> Column:
    """The vector's entries as integers; those beyond a long's range stop at its ends."""
    return F.transform(vector, lambda c: F.least(F.floor(c.cast("double") * SCALE), F.lit(MOST - SHIFT)) + SHIFT)


def matrix(column: pa.Array, less: list[int]) -> np.ndarray:
    """The vectors less a vector of integers, as int64 or, where that could overflow, as Python integers."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(less))
    if len(x) and max(int(x.max()), max(less)) - min(int(x.min()), min(less)) >= 2**62:
        return x.astype(object) - np.array(less, dtype=object)
    return x - np.array(less, dtype=np.int64)


def bound(z: np.ndarray) -> int:
    return max(int(z.max()), -int(z.min())) if z.size else 0


def plain_sums(z: np.ndarray) -> list[int]:
    return [int(v) for v in (z if bound(z) * len(z) < 2**62 else z.astype(object)).sum(axis=0)]


def square_sums(z: np.ndarray) -> list[int]:
    """Sums of squares of every dimension, then of the sum of every pair (first by first)."""
    if (2 * bound(z)) ** 2 * len(z) >= 2**62:
        z = z.astype(object)
    out = list((z * z).sum(axis=0))
    for i in range(z.shape[1] - 1):
        pair = z[:, i + 1 :] + z[:, i : i + 1]
        out.extend((pair * pair).sum(axis=0))
    return [int(v) for v in out]


def totals(fit: DataFrame, less: list[int], sums: Callable[[np.ndarray], list[int]]) -> list[int]:
    """The sums over all vectors of fit less a vector. Exact: a total travels as two decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                found = sums(matrix(batch.column(0).slice(at, ROWS), less))
                total = [a + b for a, b in zip(total, found, strict=True)] if total else found
        if total:
            high, low = ([Decimal(v) for v in part] for part in ([t >> LIMB for t in total], [t & ((1 << LIMB) - 1) for t in total]))
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(high, kind), pa.array(low, kind)], ["cell", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "cell int, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("cell").collect()
    return [(int(r["high"]) << LIMB) + int(r["low"]) for r in rows]


def covariance(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """The covariance, every entry correctly rounded, from sums of squares of values centred but for rest / n."""
    d = len(rest)
    spread = [n * squares[i] - rest[i] ** 2 for i in range(d)]  # n^2 * variance
    out, at = np.zeros((d, d)), d
    for i in range(d):
        out[i, i] = spread[i] / n**2
        for j in range(i + 1, d):
            both = n * squares[at] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - spread[i] - spread[j]) / (2 * n**2)
            at += 1
    return out


def eigen(spark: SparkSession, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns), by eigh in a task: the threads of a linear-algebra library can hang in a driver that has started a JVM."""
    n = len(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                values, vectors = np.linalg.eigh(np.frombuffer(raw).reshape(n, n))
                yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()]), pa.array([np.ascontiguousarray(vectors).tobytes()])], ["values", "vectors"])

    row = spark.createDataFrame([(v.tobytes(),)], "v binary").coalesce(1).mapInArrow(run, "values binary, vectors binary").first()
    return np.frombuffer(row["values"]), np.frombuffer(row["vectors"]).reshape(n, n)


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors of d dimensions; their mean is floor + rest / n. components has one column for each eigenvalue."""

    n: int
    floor: list[int]
    rest: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened rows, of vectors less floor."""
        return (z.astype(np.float64) - np.array([r / self.n for r in self.rest])) @ self.components / np.sqrt(self.eigenvalues)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over all of fit."""
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.project(matrix(batch.column(0), model.floor))
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    rows = fit.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    mean, *products = np.array([r["v"] for r in rows]).reshape(k + 1, k) / model.n
    return float(np.abs(np.array(products) - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct quantised vectors of df, with so many components of most variance.

    Vectors that are null or hold null or non-finite entries are left out, and so are those that have not as many entries as most have (of equally
    frequent lengths the longest counts). Without a sound vector n is 0. Components whose variance is FLAT of the largest or less are left out, so
    equal vectors, a single one or fewer than the dimensions give fewer components or none. Repeated vectors count once.
    """
    vector = F.col(f"`{vector_col}`")
    fit = cut(df.filter(sound(vector)).select(quantised(vector).alias("x")).distinct(), "vectors")
    lengths = fit.filter(F.size("x") > 0).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not lengths:
        return Whitening(0, [], [], np.zeros(0), np.zeros((0, 0)), 0.0)
    d, n = lengths["d"], lengths["n"]
    fit = fit.filter(F.size("x") == d)
    sums = [s + n * SHIFT for s in totals(fit, [SHIFT] * d, plain_sums)]
    floor, rest = [s // n for s in sums], [s % n for s in sums]
    v = covariance(n, rest, totals(fit, floor, square_sums))
    values, vectors = eigen(df.sparkSession, v)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > FLAT * max(values.max(), 0.0)]
    model = Whitening(n, floor, rest, values[order], vectors[:, order], float(np.trace(v)))
    return Whitening(**(vars(model) | {"identity_error": identity_error(fit, model)})) if len(order) else model


def deviations(z: np.ndarray, model: Whitening) -> list[int | None]:
    """The sum over the dimensions of (n * x - S)^2; null where it is beyond a long."""
    n, rest = model.n, model.rest
    if ((bound(z) + 1) * n) ** 2 * max(len(rest), 1) < 2**62:
        return ((z * n - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((z.astype(object) * n - np.array(rest, dtype=object)) ** 2).sum(axis=1)
    return [v if v <= MOST else None for v in map(int, exact)]


def whiten(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> DataFrame:
    """df's rows with deviation (long, exact) and whitened (array<double>); the vector stays. Repeated rows are repeated.

    Rows whose vector fit_whitening leaves out go, and all rows where the model has no component. Columns named like the new ones are replaced.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("deviation", "whitened")])
    vector = F.col(f"`{vector_col}`")
    usable = sound(vector) & (F.size(vector) == len(model.floor)) if len(model.eigenvalues) else F.lit(False)
    rows = packed(df.filter(usable), quantised(vector).alias("x"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            z = matrix(batch.column(1), model.floor)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(z, model), pa.int64()), pa.array(list(model.project(z)), pa.list_(pa.float64()))], ["_row", "deviation", "whitened"])

    return rows.mapInArrow(run, StructType([rows.schema["_row"], *StructType.fromDDL("deviation long, whitened array<double>")])).select("_row.*", "deviation", "whitened")


def whitening_digest(embeddings: DataFrame) -> DataFrame:
    """One row for each sound vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    model = fit_whitening(embeddings)
    each = whiten(embeddings.select("vec_id", "embedding"), model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]) if len(model.eigenvalues) else F.array(F.lit(0.0))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
