"""Embedding whitening by an incremental eigendecomposition.

Every partition carries the count, mean and spectrum (eigenvalues, eigenvectors) of the scatter of the vectors it has
seen; a new vector is a centred rank-one update, whose new eigenvalues are the roots of a secular equation after the
components that do not take part were deflated. Spectra of partitions are combined in a tree: the eigenpairs of one and
the distance of the means update the other, one rank at a time. The basis so found is orthonormal only to rounding
that adds up over updates; a last distributed pass projects the exactly centred vectors on it and solves the small
Rayleigh-Ritz problem, which gives eigenvectors to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

#: An entry c counts as floor(SCALE * c) + SHIFT; rows with an entry beyond LIMIT either way take no part.
SCALE, SHIFT, LIMIT = 1024, 100_000, 2.0**40
EPS = np.finfo(float).eps


def roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_i^2 / (d_i - x) = 0 for rising d and no zero z: (roots, d_i - root_j as a matrix).

    Each root lies between its d and the next, the last at most |z|^2 beyond. It is sought as a distance from the
    nearer of the two, so that differences keep their precision. Both sides of the sum are replaced by a pole at
    the neighbouring d with the same value and slope, which gives a quadratic equation a step; a step that leaves
    the bracket is replaced by halving it.
    """
    k, squares = len(d), z * z
    last = squares.sum()
    upper = np.append(d[1:], d[-1] + last)
    width = upper - d
    middle = 1 + squares @ (1 / (d[:, None] - (d + width / 2)[None, :]))
    right = middle < 0
    right[-1] = False
    # A root's distance from its origin, the nearer pole; bracket [low, high].
    apart = d[:, None] - np.where(right, upper, d)[None, :]
    low, high = np.where(right, -width / 2, 0.0), np.where(right, 0.0, width / 2)
    if middle[-1] < 0:
        low[-1], high[-1] = width[-1] / 2, width[-1]
    t = (low + high) / 2
    own = np.arange(k)
    left_side = (own[:, None] <= own[None, :]).astype(float)
    with np.errstate(all="ignore"):
        for _ in range(60):
            inverse = 1 / (apart - t)
            at_left = inverse * left_side
            psi, psi_slope = squares @ at_left, squares @ (at_left * inverse)
            value, slope = squares @ inverse, squares @ (inverse * inverse)
            phi, phi_slope = value - psi, slope - psi_slope
            f = 1 + value
            low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
            # A root is found where the sum is nothing but rounding; further steps would leave its bracket.
            found = np.abs(f) <= 16 * EPS * (1 + phi - psi)
            if found.all():
                break
            one = apart[own, own] - t
            two = np.append(apart[own[:-1] + 1, own[:-1]] - t[:-1], 0.0)
            s, S = psi_slope * one * one, phi_slope * two * two
            c = 1 + psi - psi_slope * one + phi - phi_slope * two
            b, a = c * (one + two) + s + S, one * two * f
            root = np.sqrt(np.maximum(b * b - 4 * c * a, 0))
            step = np.where(b <= 0, (b - root) / (2 * c), 2 * a / (b + root))
            step[-1] = one[-1] + s[-1] / (1 + psi[-1] - psi_slope[-1] * one[-1])
            moved = t + step
            good = (moved > low) & (moved < high)
            new = np.where(found, t, np.where(good, moved, (low + high) / 2))
            if (new == t).all():
                break
            t = new
    return np.where(right, upper, d) + t, apart - t


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of vectors diag(values) vectors' + weight v v', weight positive."""
    z = np.sqrt(weight) * (v @ vectors)
    norm = np.sqrt(z @ z)
    if not norm:
        return values, vectors
    least = 8 * EPS * max(values[-1], norm * norm)
    kept = np.flatnonzero(np.abs(z) * norm > least)
    if len(kept) > 1:
        a, b = z[kept[:-1]], z[kept[1:]]
        if (np.abs(np.diff(values[kept]) * a * b) <= least * (a * a + b * b)).any():
            # Two equal eigenvalues: turn their vectors so that one of them takes no part.
            vectors, held = vectors.copy(), [kept[0]]
            for j in kept[1:]:
                i = held[-1]
                r = np.hypot(z[i], z[j])
                cos, sin = z[j] / r, z[i] / r
                if abs((values[j] - values[i]) * cos * sin) <= least:
                    z[i], z[j] = 0.0, r
                    vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[cos, sin], [-sin, cos]])
                    held[-1] = j
                else:
                    held.append(j)
            kept = np.array(held)
    if not len(kept):
        return values, vectors
    d = values[kept]
    found, apart = roots(d, z[kept])
    # The z for which these roots are exact: eigenvectors from it are orthogonal to rounding.
    between = d[None, :] - d[:, None]
    np.fill_diagonal(between, 1.0)
    exact = np.sqrt(np.abs(np.prod(-apart / between, axis=1)))
    turn = (np.sign(z[kept]) * exact)[:, None] / apart
    turn /= np.sqrt((turn * turn).sum(axis=0))
    out_values, out_vectors = values.copy(), vectors.copy()
    out_values[kept], out_vectors[:, kept] = found, vectors[:, kept] @ turn
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and eigendecomposed scatter of the vectors seen so far."""

    def __init__(self, width: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(width), np.zeros(width), np.eye(width)
        self.sums = np.zeros(width, object)

    def add(self, x: np.ndarray, times: int) -> None:
        """``times`` copies of one vector."""
        self.sums = self.sums + x.astype(object) * times
        away, total = x - self.mean, self.n + times
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * (times / total))
        self.mean = self.mean + away * (times / total)
        self.n = total

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        self.sums = self.sums + other.sums
        away, total = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * (other.n / total))
        self.mean = self.mean + away * (other.n / total)
        self.n = total

    def row(self) -> tuple:
        return self.n, self.sums.tolist(), self.mean.tolist(), self.values.tolist(), self.vectors.ravel().tolist()

    @staticmethod
    def of(n: int, sums: np.ndarray, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> Spectrum:
        out = Spectrum(len(mean))
        out.n, out.mean, out.values, out.vectors = int(n), np.array(mean), np.array(values), np.array(vectors).reshape(len(mean), -1)
        out.sums = np.array([int(x) for x in sums], object)
        return out


def fixed(vectors: DataFrame) -> DataFrame:
    """(vec_id, width, x array<long>) of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fits = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c * SCALE) > LIMIT))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size("embedding") > 0) & fits)
    return rows.select("vec_id", F.size("embedding").alias("width"), F.transform(x, lambda c: F.when(F.abs(c * SCALE) <= LIMIT, F.floor(c * SCALE) + SHIFT)).alias("x"))


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, vectors as a matrix) of each width in a batch."""
    widths, x = batch.column("width").to_numpy(), batch.column("x")
    values, ends = x.values.to_numpy(), x.offsets.to_numpy()
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        yield width, at, values[ends[at][:, None] + np.arange(width)]


def spectra(rows: DataFrame) -> DataFrame:
    """(part, width, n, sums, mean, evals, evecs): the spectrum of each partition, a row per width."""
    ddl = "part long, width int, n long, sums array<long>, mean array<double>, evals array<double>, evecs array<double>"
    schema = pa.schema([("part", pa.int64()), ("width", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), *[(c, pa.list_(pa.float64())) for c in ("mean", "evals", "evecs")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Spectrum] = {}
        part = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            for width, _, x in by_width(batch):
                spectrum = found.setdefault(width, Spectrum(width))
                once, times = np.unique(x, axis=0, return_counts=True)
                for row, n in zip(once, times.tolist(), strict=True):
                    spectrum.add(row, n)
        if found:
            columns = zip(*((part, width, *s.row()) for width, s in found.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.select(F.spark_partition_id().cast("long").alias("part"), "width", "x").mapInArrow(run, ddl)


def combined(parts: DataFrame, at_once: int = 16) -> list[Spectrum]:
    """One spectrum per width: ``at_once`` spectra are merged in a task, until one of each width is left."""
    names = parts.columns

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        first, *others = (Spectrum.of(*row) for row in rows[["n", "sums", "mean", "evals", "evecs"]].itertuples(index=False))
        for other in others:
            first.merge(other)
        return pd.DataFrame([(rows["part"].iloc[0] // at_once, rows["width"].iloc[0], *first.row())], columns=names)

    parts = materialise(parts, "whitening-spectra")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        groups = parts.groupBy("width", F.floor(F.col("part") / at_once).alias("group"))
        parts = materialise(groups.applyInPandas(merge, parts.schema), "whitening-spectra")
    return [Spectrum.of(r["n"], r["sums"], r["mean"], r["evals"], r["evecs"]) for r in parts.collect()]


def gram_cells(rows: DataFrame, shared, project) -> dict[int, np.ndarray]:
    """Per width the sum of y y' over all rows, y = project(model, x - mean): cells summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in by_width(batch):
                y = project(shared.value[width], x)
                sums[width] = sums.get(width, 0) + y.T @ y
        for width, g in sums.items():
            i, j = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), width, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], names=["width", "i", "j", "cell"])

    cells = rows.select("width", "x").mapInArrow(run, "width int, i int, j int, cell double").groupBy("width", "i", "j").agg(F.sum("cell").alias("cell"))
    out: dict[int, np.ndarray] = {}
    for width, i, j, cell in cells.collect():
        size = shared.value[width]["vectors"].shape[1]
        g = out.setdefault(width, np.zeros((size, size)))
        g[i, j] = g[j, i] = cell
    return out


def centred(model: dict, x: np.ndarray) -> np.ndarray:
    """x - S / n without rounding of the difference's numerator."""
    return (model["n"] * x - model["sums"]) / model["n"]


def whiten(vectors: DataFrame, components: int = 8, at_once: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component.

    ``vectors``: vec_id, embedding. Rows whose vector is null, empty, or holds null, non-finite or (beyond 2^30)
    entries too large for exact sums take no part; every other row is fitted and returned, repeated ones and null ids
    too. Vectors of different widths are fitted apart, each width on its own rows. Narrower vectors have fewer
    components. A component without variance has null in ``whitened``; ``explained`` is null where nothing varies;
    ``deviation`` is null where its exact value is beyond a long. Equal eigenvalues leave their components' turn open;
    it is the same for all rows. Signs: the largest entry of a component is positive. Other columns are ignored; an
    empty table gives no row. Driver and broadcasts hold one matrix of the vectors' width; rows never leave their tasks.
    """
    spark = vectors.sparkSession
    rows = fixed(vectors)
    found = {len(s.mean): s for s in combined(spectra(rows), at_once)}
    models = {width: {"n": s.n, "vectors": np.linalg.qr(s.vectors)[0], "sums": s.sums.astype(np.int64)} for width, s in found.items()}
    gram = gram_cells(rows, spark.sparkContext.broadcast(models), lambda m, x: centred(m, x) @ m["vectors"])
    for width, g in gram.items():
        model, cov = models[width], g / models[width]["n"]
        values, turn = np.linalg.eigh(cov)
        keep = np.argsort(-values, kind="stable")[:components]
        basis = model["vectors"] @ turn[:, keep]
        basis *= np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(keep))])
        trace = float(np.trace(cov))
        values = values[keep]
        live = values > 8 * width * EPS * max(trace, 0.0)
        model |= {"vectors": basis, "scale": np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), np.nan), "live": live, "explained": [float(v) / trace if trace > 0 else None for v in values]}
    shared = spark.sparkContext.broadcast(models)
    checks = gram_cells(rows, shared, lambda m, x: np.nan_to_num(centred(m, x) @ m["vectors"] * m["scale"]))
    for width, g in checks.items():
        live = models[width]["live"]
        away = np.abs(g / models[width]["n"] - np.eye(len(g)))[np.ix_(live, live)]
        models[width]["error"] = float(away.max()) if away.size else None
    shared = spark.sparkContext.broadcast(models)
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, x in by_width(batch):
                m = shared.value[width]
                away = m["n"] * x - m["sums"]
                exact = (away.astype(object) ** 2).sum(axis=1)
                deviation = [v if v < 1 << 63 else None for v in exact]
                white = (away / m["n"]) @ m["vectors"] * m["scale"]
                k = white.shape[1]
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
                columns = (
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, m["n"])), pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(white.ravel(), pa.float64(), from_pandas=True), pa.array(m["explained"] * len(at), pa.float64()), pa.array([m["error"]] * (len(at) * k), pa.float64()),
                )
                yield pa.RecordBatch.from_arrays(list(columns), schema=schema)

    return rows.mapInArrow(run, ddl)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of every row of ``embeddings``."""
    return whiten(table(spark, sf_dir, "embeddings"))
