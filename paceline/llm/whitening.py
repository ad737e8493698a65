"""Whitening of embeddings with components from spectral divide and conquer.

Spark reads the vectors three times: for counts and exact sums, for the centred second moments, and for the whitened
coordinates. What a pass sends on is one partial result per task with as many cells as there are pairs of dimensions;
these are summed by cell before the driver sees the one matrix of the fit.

The eigenvectors come from polar decompositions. The polar factor U of the shifted covariance A - sI has eigenvalue 1
where those of A lie above s and -1 where they lie below, so (U + I) / 2 projects on the space of the larger ones and
I minus it on the rest. Orthonormal bases of both spaces split A into two smaller blocks, which are split in turn until
each holds a single direction. The polar factor is computed by the dynamically weighted Halley iteration in its
inverse-free form, one QR factorisation a step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.rows import landed, shared, table

# Fixed values of the contract: an entry becomes floor(64 c) + 1000000, and components per row
SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix without a zero eigenvalue."""
    m = len(a)
    norm = np.linalg.norm(a)
    x, eye = a / norm, np.eye(m)
    # a lower bound of the least singular value; too small a bound costs a step, never the result
    low = max(np.linalg.norm(np.linalg.solve(x, eye), 1) ** -1 / math.sqrt(m), EPS) if np.linalg.matrix_rank(x) == m else EPS
    for _ in range(40):
        d = (4 * (1 - low * low) / low**4) ** (1 / 3)
        weight = math.sqrt(1 + d) + math.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * math.sqrt(1 + d)), 0)) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(c) * x, eye]))
        before, x = x, b / c * x + (weight - b / c) / math.sqrt(c) * q[:m] @ q[m:].T
        x = (x + x.T) / 2
        low = min(low * (weight + b * low * low) / (1 + c * low * low), 1.0)
        if np.linalg.norm(x - before) <= 10 * m * EPS ** (2 / 3) and 1 - low < 10 * EPS:
            break
    # one Newton-Schulz step takes off what rounding left
    return 1.5 * x - 0.5 * x @ x.T @ x


def _range(projector: np.ndarray, rank: int, draw: np.random.Generator) -> np.ndarray:
    """Orthonormal basis of the space that ``projector`` keeps."""
    basis = draw.standard_normal((len(projector), rank))
    for _ in range(3):
        basis, _ = np.linalg.qr(projector @ basis)
    return basis


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Shifts to try, all strictly inside the bounds of the eigenvalues."""
    diagonal = np.sort(np.diag(a))
    middle = len(diagonal) // 2
    yield (diagonal[middle - 1] + diagonal[middle]) / 2
    yield float(diagonal.mean())
    mean, spread = float(diagonal.mean()), float(np.linalg.norm(a - diagonal.mean() * np.eye(len(a))))
    # the mean splits the spectrum unless an eigenvalue meets it, so places next to it come last
    for step in range(1, 200):
        yield mean + (-1) ** step * spread * step / 401 / math.sqrt(len(a))


def eigen(a: np.ndarray, draw: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): all eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    draw = draw or np.random.default_rng(12)
    values, vectors = _divide((a + a.T) / 2, float(np.linalg.norm(a)), draw)
    # values as Rayleigh quotients of the whole matrix
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _divide(a: np.ndarray, norm: float, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    m = len(a)
    if m == 1:
        return np.diag(a).copy(), np.eye(1)
    # equal values, or nothing but rounding between them: any basis will do
    if np.linalg.norm(a - np.diag(a).mean() * np.eye(m)) <= m * EPS * norm:
        return np.diag(a).copy(), np.eye(m)
    best = None
    for shift in _shifts(a):
        u = polar(a - shift * np.eye(m))
        above = (u + np.eye(m)) / 2
        rank = round(float(np.trace(above)))
        if not 0 < rank < m:
            continue
        first = _range(above, rank, draw)
        rest = _range(np.eye(m) - first @ first.T, m - rank, draw)
        coupled = float(np.linalg.norm(rest.T @ a @ first))
        if best is None or coupled < best[0]:
            best = (coupled, first, rest)
        if coupled <= 10 * m * EPS * norm:
            break
    if best is None:
        return np.diag(a).copy(), np.eye(m)
    _, first, rest = best
    out = []
    for basis in (first, rest):
        block = basis.T @ a @ basis
        values, vectors = _divide((block + block.T) / 2, norm, draw)
        out.append((values, basis @ vectors))
    return np.concatenate([v for v, _ in out]), np.hstack([q for _, q in out])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their last column, lists of one length, as whole numbers of the contract."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(batch.num_columns - 1)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        whole = np.floor(SCALE * flat)
        if (np.abs(whole) > 2.0**52).any():
            raise OverflowError("an entry is too large for exact whole numbers")
        yield batch, whole.astype(np.int64).reshape(batch.num_rows, -1) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, total) sums of each batch, exact."""
    for _, x in _matrices(batches):
        # high and low halves, so that sums of many large entries keep in 64 bits
        high, low = x >> 26, x & ((1 << 26) - 1)
        yield pa.record_batch({"dim": np.arange(x.shape[1], dtype=np.int32), "high": high.sum(axis=0), "low": low.sum(axis=0)})


def _centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S / n from the whole part and the rest of the mean: no digits are lost."""
    return (x - base).astype(np.float64) - rest


def _moments(batches: Iterator[pa.RecordBatch], mean) -> Iterator[pa.RecordBatch]:
    """(i, j, v): the centred second moments of all rows of a task."""
    base, rest = mean()
    held = np.zeros((len(base), len(base)))
    for _, x in _matrices(batches):
        centred = _centred(x, base, rest)
        held += centred.T @ centred
    i, j = np.triu_indices(len(base))
    yield pa.record_batch({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": held[i, j]})


def _project(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(vec_id, deviation, whitened): exact squared deviation as text, and all whitened coordinates of every row."""
    base, rest, n, sums, axes = model()
    for batch, x in _matrices(batches):
        out = _centred(x, base, rest) @ axes
        apart = n * (x - base) - (sums - n * base)
        if float(np.abs(apart).max()) ** 2 * x.shape[1] < 2.0**62:
            squares = [str(v) for v in (apart * apart).sum(axis=1).tolist()]
        else:
            squares = [str(sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist(), strict=True))) for row in x.tolist()]
        flat = pa.array(out.ravel())
        place = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares), pa.ListArray.from_arrays(place, flat)], ["vec_id", "deviation", "whitened"])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, v): sums of the whitened coordinates (j = -1) and of their products."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        rows = np.hstack([rows, np.ones((len(rows), 1))])
        held = rows.T @ rows if held is None else held + rows.T @ rows
    if held is not None:
        i, j = np.triu_indices(len(held))
        yield pa.record_batch({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": held[i, j]})


def _matrix(cells: DataFrame, size: int) -> np.ndarray:
    """The symmetric matrix whose upper half is summed from ``cells``."""
    found = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    i, j, v = (found[c].to_numpy() for c in ("i", "j", "v"))
    out[i, j] = v
    out[j, i] = v
    return out


class Whitening:
    """A fitted whitening: count, exact sums, eigenvalues and unit eigenvectors of the covariance."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors

    @property
    def rank(self) -> int:
        """Components with any variance beyond rounding."""
        return int((self.values > len(self.values) * EPS * max(self.values[0], 0)).sum()) if len(self.values) else 0

    @property
    def explained(self) -> np.ndarray:
        """Share of the whole variance by component."""
        total = float(self.values.sum())
        return self.values / total if total > 0 else np.zeros(len(self.values))


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has entries and only finite ones."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return rows.where((F.size(vector) > 0) & F.forall(vector, fine))


def fit(rows: DataFrame, vector: str = "embedding") -> Whitening | None:
    """Fit on all usable vectors; None where there are none. Vectors of unlike lengths raise ValueError."""
    spark, vectors = rows.sparkSession, usable(rows, vector).select(F.col(vector).alias("vector"))
    lengths = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if not lengths["n"]:
        return None
    if lengths["least"] != lengths["most"]:
        raise ValueError(f"vectors of {lengths['least']} to {lengths['most']} entries")
    wide = T.DecimalType(38, 0)
    total = (F.sum(F.col("high").cast(wide)) * F.lit(1 << 26) + F.sum(F.col("low").cast(wide))).cast(wide)
    found = vectors.mapInArrow(_sums, "dim int, high long, low long").groupBy("dim").agg(total.alias("total"))
    sums = [int(row["total"]) for row in sorted(found.collect())]
    n = lengths["n"]
    mean = shared(spark, _mean(n, sums))
    covariance = _matrix(vectors.mapInArrow(partial(_moments, mean=mean), "i int, j int, v double"), len(sums)) / n
    return Whitening(n, sums, *eigen(covariance))


def whiten(rows: DataFrame, model: Whitening, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, deviation, whitened) of every usable row: exact squared distance from the mean, times n twice, and coordinates.

    Only the mean and ``components`` axes are sent to executors: their size is that of the vectors, not of the table.
    """
    held = min(components, model.rank)
    axes = model.vectors[:, :held] / np.sqrt(model.values[:held])
    sent = shared(rows.sparkSession, (*_mean(model.n, model.sums), model.n, np.array(model.sums, object if max(map(abs, model.sums)) > 2**62 else np.int64), axes))
    source = usable(rows, vector).select(F.col(f"`{key}`").alias("vec_id"), F.col(vector).alias("vector"))
    kind = source.schema["vec_id"].dataType.simpleString()
    out = source.mapInArrow(partial(_project, model=sent), f"vec_id {kind}, deviation string, whitened array<double>")
    return landed(out.select("vec_id", F.col("deviation").cast(T.DecimalType(38, 0)).alias("deviation"), "whitened"), "whitened")


def identity_error(whitened: DataFrame, components: int, n: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    cells = _matrix(whitened.select("whitened").mapInArrow(_products, "i int, j int, v double"), components + 1)
    mean = cells[:components, components] / n
    return float(np.abs(cells[:components, :components] / n - np.outer(mean, mean) - np.eye(components)).max())


def components_of(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per usable row and component.

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out; repeated rows count as often as
    they occur; a null ``key`` stays null; equal eigenvalues get any orthonormal axes of their space, the same for all
    rows; an empty table gives no rows; further columns are never read. Components without variance (fewer vectors than
    entries, constant or dependent entries) have no direction to scale: their ``whitened`` is null and the identity is
    checked on the others (null where there are none). A vector that is very long makes the fit as large as its square.
    """
    spark = rows.sparkSession
    model = fit(rows, vector)
    kind = rows.schema[key].dataType
    if model is None:
        rest = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return spark.createDataFrame([], f"vec_id {kind.simpleString()}, {rest}")
    whole, held = min(components, len(model.values)), min(components, model.rank)
    out = whiten(rows, model, components, vector, key)
    error = F.lit(identity_error(out, held, model.n) if held else None).cast("double")
    share = F.array(*[F.lit(float(v)) for v in model.explained[:whole]])
    axis = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(whole)), lambda i: F.try_element_at("whitened", i)))
    out = out.select("vec_id", "deviation", axis.alias("pos", "whitened"))
    return out.select(
        "vec_id",
        (F.col("pos") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(share, F.col("pos") + 1).alias("explained"),
        error.alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components_of(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


# Polar decompositions have no SQL form
QUERIES = {"op12_whitening": op12_whitening}
SQL: dict[str, str] = {}
