"""Vector statistics and linear probes; everything is sums over rows, matrices of the vectors' width are solved on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.scale import hash_order, ranked
from corpuslab.functions.storage import written

from .retrieval import dot, unit


def pair_similarity(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with cosine, relative L2 distance and norm ratio of two vector columns."""
    x, y = F.col(a), F.col(b)
    nx, ny = F.sqrt(dot(x, x)), F.sqrt(dot(y, y))
    diff = F.zip_with(x, y, lambda u, v: u.cast("double") - v.cast("double"))
    return rows.withColumns({"cosine": F.when((nx > 0) & (ny > 0), dot(x, y) / (nx * ny)), "relative_l2": F.when(ny > 0, F.sqrt(dot(diff, diff)) / ny), "norm_ratio": F.when(ny > 0, nx / ny)})


def summed_units(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by…, n, s): number of rows and element-wise sum of their unit vectors."""
    cells = rows.select(*by, F.posexplode(unit(F.col(vector))).alias("d", "x")).groupBy(*by, "d").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    return cells.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda c: c["x"]).alias("s"))


def within_cosine(sums: DataFrame) -> DataFrame:
    """Adds ``within``: mean cosine of all pairs of a group without the diagonal, (|s|² - n) / (n (n - 1))."""
    return sums.withColumn("within", F.when(F.col("n") > 1, (dot(F.col("s"), F.col("s")) - F.col("n")) / (F.col("n") * (F.col("n") - 1))))


def across_cosine(sums: DataFrame, group: str) -> DataFrame:
    """(a, b, across): mean cosine of pairs from two groups; groups are few."""
    a = sums.select(F.col(group).alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    b = sums.select(F.col(group).alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", (dot(F.col("sa"), F.col("sb")) / (F.col("na") * F.col("nb"))).alias("across"))


def gram(rows: DataFrame, vector: str, by: list[str] | None = None, targets: list[Column] | None = None) -> dict:
    """Per group: X'X of [1, vector, targets]; tasks add up matrices, Spark adds up their cells, one matrix per group is collected."""
    names = by or []
    data = rows.select(*names, F.col(vector).alias("x"), *[t.cast("double").alias(f"t{i}") for i, t in enumerate(targets or [])])
    extra = len(targets or [])

    def run(batches):
        found: dict[tuple, np.ndarray] = {}
        for part in batches:
            for key, g in part.groupby(names) if names else [((), part)]:
                key = key if isinstance(key, tuple) else (key,)
                z = np.hstack([np.ones((len(g), 1)), np.stack(g["x"].to_numpy()).astype(float), g[[f"t{i}" for i in range(extra)]].to_numpy(float)])
                found[key] = found.get(key, 0.0) + z.T @ z
        yield pd.DataFrame([(*k, m.ravel().tolist()) for k, m in found.items()], columns=[*names, "m"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    parts = data.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "m array<double>"]))
    cells = parts.select(*names, F.posexplode("m").alias("cell", "x")).groupBy(*names, "cell").agg(F.sum("x").alias("x"))
    whole = cells.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "x"))), lambda c: c["x"]).alias("m"))
    return {tuple(r[c] for c in names): np.array(r["m"]).reshape(int(np.sqrt(len(r["m"]))), -1) for r in whole.collect()}


def spread(rows: DataFrame, vector: str) -> DataFrame:
    """One row: participation ratio tr(C)² / |C|², share of the top eigenvalue, rows."""
    m = gram(rows, vector)[()]
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] / n - np.outer(mean, mean)
    top = np.linalg.eigvalsh(c)[-1]
    return rows.sparkSession.createDataFrame([(int(n), float(np.trace(c) ** 2 / (c**2).sum()), float(top / np.trace(c)))], "n long, participation double, top_share double")


def permutation_p(rows: DataFrame, vector: str, label: str, key: str, permutations: int = 50) -> DataFrame:
    """One row: within-minus-across cosine of a two-valued label, and its add-one permutation p.

    Relabelings are hash bits of (key, replicate). Tasks add up the unit vectors of each replicate and label by one
    product of the bits with the vectors, so rows are never copied per replicate.
    """
    bits = F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda i: F.pmod(F.xxhash64(key, i), F.lit(2)).cast("int"))
    mixed = rows.select(F.concat(F.array(F.col(label).cast("int")), bits).alias("l"), unit(F.col(vector)).alias("v")).where("v is not null")

    def run(batches):
        found = 0.0
        for part in batches:
            if len(part):
                ones, v = np.stack(part["l"].to_numpy()).astype(float), np.stack(part["v"].to_numpy()).astype(float)
                v = np.hstack([np.ones((len(v), 1)), v])
                found = found + np.stack([(1 - ones).T @ v, ones.T @ v], axis=1)
        if isinstance(found, np.ndarray):
            yield pd.DataFrame({"perm": np.repeat(np.arange(len(found)), 2) - 1, "l": np.tile([0, 1], len(found)), "s": list(found.reshape(-1, found.shape[2]))})

    cells = mixed.mapInPandas(run, "perm long, l long, s array<double>").select("perm", "l", F.posexplode("s").alias("d", "x")).groupBy("perm", "l", "d").agg(F.sum("x").alias("x"))
    whole = cells.groupBy("perm", "l").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda c: c["x"]).alias("s"))
    sums = within_cosine(whole.select("perm", "l", F.col("s")[0].alias("n"), F.slice("s", 2, 1 << 20).alias("s")))
    wide = sums.groupBy("perm").agg(F.avg("within").alias("within"), F.collect_list("s").alias("s"), F.collect_list("n").alias("n"))
    stat = wide.select("perm", (F.col("within") - dot(F.col("s")[0], F.col("s")[1]) / (F.col("n")[0] * F.col("n")[1])).alias("d"))
    real = stat.where("perm < 0").select(F.col("d").alias("real"))
    return stat.where("perm >= 0").join(F.broadcast(real)).agg(F.first("real").alias("difference"), ((F.count_if(F.col("d") >= F.col("real")) + 1) / (F.count("*") + 1)).alias("p"))


def _solve(m: np.ndarray, d: int, l2: float) -> np.ndarray:
    penalty = l2 * np.eye(d)
    penalty[0, 0] = 0.0
    return np.linalg.solve(m[:d, :d] + penalty, m[:d, d:])


def ridge_folds(rows: DataFrame, vector: str, target: str, fold: str, l2: float = 1.0) -> DataFrame:
    """Rows with ``predicted``: per fold, ridge on the other folds (total minus own sums), applied to this one."""
    by = gram(rows, vector, [fold], [F.col(target)])
    total = sum(by.values())
    d = total.shape[0] - 1
    weights = {k[0]: _solve(total - m, d, l2)[:, 0].tolist() for k, m in by.items()}
    table = rows.sparkSession.createDataFrame([(k, w) for k, w in weights.items()], f"{fold} int, __w array<double>")
    one = F.concat(F.array(F.lit(1.0)), F.transform(vector, lambda x: x.cast("double")))
    return rows.join(F.broadcast(table), fold).withColumn("predicted", dot(one, F.col("__w"))).drop("__w")


def r_squared(m: np.ndarray, columns: list[int], target: int, l2: float = 1e-6) -> float:
    """R² of a target column on some columns (the constant among them) of a block Gram matrix."""
    pick = m[np.ix_(columns, columns)] + l2 * np.eye(len(columns))
    b = np.linalg.solve(pick, m[columns, target])
    syy = m[target, target] - m[0, target] ** 2 / m[0, 0]
    explained = b @ m[columns, target] - m[0, target] ** 2 / m[0, 0]
    return float(explained / syy)


def incremental_r2(rows: DataFrame, vector: str, target: str, base: int, seed: int, key: str) -> DataFrame:
    """(model, r2, bound): H (first ``base`` dimensions), H + E (all), H + control (a hashed column); from one Gram matrix.

    bound = ½ ln(1 / (1 - ΔR²)), the linear information that E adds to H.
    """
    control = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000)) / 1000
    m = gram(rows, vector, None, [control, F.col(target)])[()]
    width = m.shape[0] - 3
    h, full, t = list(range(base + 1)), list(range(width + 1)), width + 2
    found = {"H": r_squared(m, h, t), "H+E": r_squared(m, full, t), "H+control": r_squared(m, [*h, width + 1], t)}
    rows_ = [(k, v, float(0.5 * np.log(1 / max(1e-12, 1 - max(0.0, v - found["H"]))))) for k, v in found.items()]
    return rows.sparkSession.createDataFrame(rows_, "model string, r2 double, bound double")


def rank_bounds(rows: DataFrame, vector: str, base: int, targets: list[Column], l2: float = 10.0, most: int = 32) -> DataFrame:
    """(rank, delta_r2, cumulative, bound): what the inputs beyond ``base`` explain of the targets beside the first ``base``.

    Both the further inputs and the targets are freed of what the first inputs tell (ridge), by the Schur complement of
    one block Gram matrix; no residual is made row by row. Rank 0 is the ridge fit on all further inputs; rank i > 0
    the i-th direction of their cross-covariance with the targets, alone and summed up to it. bound = -½ ln(1 - ΔR²).
    """
    m = gram(rows, vector, None, targets)[()]
    c = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0]
    h, e, y = slice(0, base), slice(base, len(c) - len(targets)), slice(len(c) - len(targets), len(c))
    project = np.linalg.solve(c[h, h] + l2 * np.eye(base), np.hstack([c[h, e], c[h, y]]))
    width = c[e, e].shape[0]
    of_e, of_y = project[:, :width], project[:, width:]
    che, chy = c[h, e], c[h, y]
    inner = c[e, e] - of_e.T @ che - che.T @ of_e + of_e.T @ c[h, h] @ of_e
    cross = c[e, y] - of_e.T @ chy - che.T @ of_y + of_e.T @ c[h, h] @ of_y
    total = float(np.trace(c[y, y]))
    weights = np.linalg.solve(inner + l2 * np.eye(width), cross)
    bound = lambda r2: float(-0.5 * np.log(max(1e-12, 1 - max(0.0, r2))))
    whole = float(np.trace(weights.T @ inner @ weights)) / total if total > 0 else 0.0
    out, upto = [(0, whole, whole, bound(whole))], 0.0
    directions = np.linalg.svd(cross, full_matrices=False)[0]
    for i in range(min(most, directions.shape[1])):
        u = directions[:, i]
        spread_ = float(u @ inner @ u)
        own = float(((u @ cross) ** 2).sum() / spread_ / total) if spread_ > 0 and total > 0 else 0.0
        upto += own
        out.append((i + 1, own, upto, bound(upto)))
    return rows.sparkSession.createDataFrame(out, "rank int, delta_r2 double, cumulative double, bound double")


def information_gap(rows: DataFrame, vector: str, label: str, fold: str, base: int, key: str, l2: float = 1.0) -> DataFrame:
    """One row: held-out squared-error gain of a linear probe with all dimensions over the first ``base``, minus that of a permuted control."""
    target = F.col(label).cast("double")
    narrow = ridge_folds(rows.withColumn("__h", F.slice(vector, 1, base)), "__h", label, fold, l2).select(key, F.col("predicted").alias("p_h"))
    wide = ridge_folds(rows, vector, label, fold, l2).select(key, F.col("predicted").alias("p_e"))
    noisy = rows.withColumn("__c", F.concat(F.slice(vector, 1, base), F.transform(F.slice(vector, base + 1, 1 << 16), lambda x: x * F.when(hash_order(1, key) < "8", 1).otherwise(-1))))
    control = ridge_folds(noisy, "__c", label, fold, l2).select(key, F.col("predicted").alias("p_c"))
    j = rows.select(key, target.alias("y")).join(narrow, key).join(wide, key).join(control, key)
    err = lambda p: (F.col("y") - F.col(p)) ** 2
    return j.agg(F.count("*").alias("n"), F.avg(err("p_h") - err("p_e")).alias("gain"), F.avg(err("p_h") - err("p_c")).alias("control_gain"))


#: The temperatures tried for a probe's scores.
TAUS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 4.0, 8.0)


def _probe(m: np.ndarray, width: int, n_inputs: int, ridge: float) -> np.ndarray:
    """Weights (constant first, then ``width`` inputs; a column per class) of a ridge fit to one-hot labels, from sums.

    Inputs are standardised by their own mean and deviation, taken into the weights; the classes are not centred.
    """
    n, x = m[0, 0], slice(1, 1 + width)
    mu = m[0, x] / n
    sigma = np.sqrt(np.maximum(np.diag(m)[x] / n - mu**2, 0.0))
    sigma[sigma <= 1e-12 * np.maximum(1.0, np.abs(mu))] = 1.0
    inner = (m[x, x] - n * np.outer(mu, mu)) / np.outer(sigma, sigma)
    cross = (m[x, 1 + n_inputs :] - np.outer(mu, m[0, 1 + n_inputs :])) / sigma[:, None]
    w = np.linalg.solve(inner + ridge * np.eye(width), cross) / sigma[:, None]
    return np.vstack([-mu @ w, w])


def _log_loss(scores: np.ndarray, y: np.ndarray, tau: float) -> np.ndarray:
    z = scores / tau
    top = z.max(axis=1)
    return np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(len(y)), y]


def paired_replicates(rows: DataFrame, vector: str, label: str, key: str, base: int, folds: int, permutations: int, seed: int) -> DataFrame:
    """(key, rep, fold, y, x): the rows (rep -1), and per replicate the rows with the inputs beyond ``base`` of another row.

    Rows stand in a hashed order; replicate r takes the inputs of the row (r + 1) n / (permutations + 1) places on, so
    every row gets another one's and each is used once. One rank serves all replicates, which are keys of one table.
    """
    data = rows.select(F.col(key).alias("key"), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int").alias("fold"), F.col(label).cast("int").alias("y"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    placed = written(ranked(data.withColumn("__h", hash_order(seed + 1, "key")), [F.col("__h"), F.col("key")]).drop("__h"), "paired")
    n = placed.count()
    own = placed.select("key", F.lit(-1).alias("rep"), "fold", "y", "x")
    shifts = F.explode(F.array(*[F.struct(F.lit(r).alias("rep"), F.lit((r + 1) * n // (permutations + 1)).alias("by")) for r in range(permutations)]))
    asked = placed.select("key", "fold", "y", F.slice("x", 1, base).alias("h"), "rank", shifts.alias("s")).select("key", "s.rep", "fold", "y", "h", ((F.col("rank") - 1 + F.col("s.by")) % max(1, n) + 1).alias("rank"))
    given = placed.select("rank", F.slice("x", base + 1, 1 << 20).alias("e"))
    return own.unionByName(asked.join(given, "rank").select("key", "rep", "fold", "y", F.concat("h", "e").alias("x")))


def conditional_information(rows: DataFrame, vector: str, label: str, key: str, base: int, folds: int = 5, ridge: float = 1.0, permutations: int = 4, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """One row: what the inputs beyond ``base`` tell about the label given the first ``base``, in nats a row.

    Two multinomial probes, on the first inputs and on all, are fitted by sums per fold (total minus own), their
    temperature by the losses of the training folds, and compared by their held-out losses row by row. delta: mean
    gain, with a bootstrap interval; width_bias: mean gain where the further inputs belong to other rows, mean over
    ``permutations`` replicates; excess: delta less that bias, with its own interval. Labels are 0, 1, ...; rows with
    a null label or vector are left out; ``key`` is unique. Three passes over rows and replicates; a matrix per
    replicate and fold, and weights per fold and probe, are all that the driver holds.
    """
    from .evaluation import bootstrap

    spark = rows.sparkSession
    usable = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    data = written(paired_replicates(usable, vector, label, key, base, folds, permutations, seed), "probe-rows")
    figures = data.agg(F.max("y").alias("y"), F.max(F.size("x")).alias("d")).first()
    n_classes, d = (figures["y"] or 0) + 1, figures["d"] or 0
    sums = gram(data, "x", ["rep", "fold"], [F.col("y") == c for c in range(n_classes)])
    probes = {}
    for rep in sorted({r for r, _ in sums}):
        total = sum(m for (r, _), m in sums.items() if r == rep)
        for fold in [f for r, f in sums if r == rep]:
            rest = total - sums[rep, fold]
            probes[rep, fold] = [_probe(rest, width, d, ridge) for width in (base, d)]
    shared = spark.sparkContext.broadcast(probes)

    def matrix(own: pd.DataFrame) -> np.ndarray:
        return np.hstack([np.ones((len(own), 1)), np.stack(own["x"].to_numpy()).astype(float)])

    def losses(batches):
        found: dict[tuple, np.ndarray] = {}
        for part in batches:
            for (rep, fold), own in part.groupby(["rep", "fold"]):
                x, y = matrix(own), own["y"].to_numpy()
                for (r, f), weights in shared.value.items():
                    if r == rep and f != fold:
                        for wide, w in enumerate(weights):
                            scores = x[:, : len(w)] @ w
                            found[r, f, wide] = found.get((r, f, wide), 0.0) + np.array([_log_loss(scores, y, t).sum() for t in TAUS])
        yield pd.DataFrame([(*k, i, v) for k, each in found.items() for i, v in enumerate(each.tolist())], columns=["rep", "fold", "wide", "i", "loss"])

    grid = data.select("rep", "fold", "y", "x").mapInPandas(losses, "rep int, fold int, wide int, i int, loss double").groupBy("rep", "fold", "wide", "i").agg(F.sum("loss").alias("loss"))
    taus = {(r["rep"], r["fold"], r["wide"]): TAUS[r["i"]] for r in grid.groupBy("rep", "fold", "wide").agg(F.min(F.struct("loss", "i")).alias("x")).select("rep", "fold", "wide", "x.i").collect()}
    fitted = spark.sparkContext.broadcast({k: [(w, taus.get((*k, wide), 1.0)) for wide, w in enumerate(weights)] for k, weights in probes.items()})

    def held(batches):
        for part in batches:
            for (rep, fold), own in part.groupby(["rep", "fold"]):
                x, y = matrix(own), own["y"].to_numpy()
                scores = [(x[:, : len(w)] @ w, tau) for w, tau in fitted.value[rep, fold]]
                nll, ok = [_log_loss(s, y, tau) for s, tau in scores], [s.argmax(axis=1) == y for s, _ in scores]
                yield pd.DataFrame({"key": own["key"], "rep": rep, "nll_h": nll[0], "nll_he": nll[1], "ok_h": ok[0], "ok_he": ok[1]})

    kind = data.schema["key"].dataType.simpleString()
    scored = data.mapInPandas(held, f"key {kind}, rep int, nll_h double, nll_he double, ok_h boolean, ok_he boolean")
    gain, real = F.col("nll_h") - F.col("nll_he"), F.col("rep") < 0
    first = lambda c: F.max(F.when(real, c))
    per_row = scored.groupBy("key").agg(first(gain).alias("delta"), F.avg(F.when(~real, gain)).alias("null"), *[first(F.col(c)).alias(c) for c in ("nll_h", "nll_he")], *[first(F.col(c).cast("int")).alias(c) for c in ("ok_h", "ok_he")])
    per_row = written(per_row.withColumn("excess", F.col("delta") - F.col("null")), "probe-gains")
    means = per_row.agg(F.count("*").alias("n"), F.lit(n_classes).alias("n_classes"), F.avg("nll_h").alias("nll_h"), F.avg("nll_he").alias("nll_he"), F.avg("ok_h").alias("acc_h"), F.avg("ok_he").alias("acc_he"), F.avg("null").alias("width_bias"))
    ends = lambda c: bootstrap(per_row, c, ["key"], [], replicates, seed).select(F.col("mean").alias(c), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi"))
    out = means.join(F.broadcast(ends("delta"))).join(F.broadcast(ends("excess")))
    return out.withColumn("positive", F.col("excess_lo") > 0)


def linear_cka(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: linear CKA of two vector columns, |X'Y|² / (|X'X| |Y'Y|), from centred sums."""
    joined = rows.select(F.concat(F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double"))).alias("__v"), F.size(a).alias("__n"))
    width = joined.select("__n").first()[0]
    m = gram(joined, "__v")[()]
    c = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0]
    xx, xy, yy = c[:width, :width], c[:width, width:], c[width:, width:]
    singular = np.linalg.svd(xy, compute_uv=False).sum()
    return rows.sparkSession.createDataFrame([(int(m[0, 0]), float((xy**2).sum() / np.sqrt((xx**2).sum() * (yy**2).sum())), float(singular / np.sqrt(np.trace(xx) * np.trace(yy))))], "n long, cka double, procrustes double")
