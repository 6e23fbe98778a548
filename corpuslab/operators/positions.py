"""Per-position records: margins, gain curves, bands, mixtures, gates. Records have a unique ``pos``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.scale import ranked
from corpuslab.functions.storage import written

COUNT_EDGES = (0, 1, 2, 3, 5, 10, 50, 200, 1000)
QS = (1, 2, 5, 10, 20, 50, 100)


def finite(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in columns])


def margins(records: DataFrame, a: str, b: str) -> DataFrame:
    """Records with ``margin`` = a - b; rows with a value that is missing or not finite are left out."""
    return records.where(finite(a, b)).withColumn("margin", F.col(a) - F.col(b))


def top_share(records: DataFrame, q: float, score: str = "margin") -> DataFrame:
    """The top q per cent by score: ceil(n q / 100) rows, at least one; ties by position."""
    n = records.count()
    return ranked(records, [F.desc(score), F.col("pos")]).where(F.col("rank") <= max(1, -(-n * q // 100))).drop("rank")


def gain_curve(records: DataFrame, qs=QS, score: str = "margin") -> DataFrame:
    """(q, n, gain): summed score of the top q per cent over all rows, from one ranking with running sums."""
    n = records.count()
    summed = ranked(records.select("pos", score), [F.desc(score), F.col("pos")], {"upto": F.col(score)})
    wanted = records.sparkSession.createDataFrame([(float(q), int(max(1, -(-n * q // 100)))) for q in qs], "q double, n long")
    return summed.join(F.broadcast(wanted), F.col("rank") == F.col("n")).select("q", "n", (F.col("upto") / n).alias("gain"))


def bucket_of(value: Column, edges=COUNT_EDGES) -> Column:
    return reduce(lambda b, e: F.when(value >= e, e).otherwise(b), sorted(edges), F.lit(None).cast("int"))


def band_summary(records: DataFrame, by: str, value: str, edges=COUNT_EDGES) -> DataFrame:
    """(band, n, mean, total) per count band; empty bands stay with n 0."""
    grid = records.sparkSession.createDataFrame([(int(e),) for e in edges], "band int")
    found = records.groupBy(bucket_of(F.col(by), edges).alias("band")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    return F.broadcast(grid).join(found, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cross_table(records: DataFrame, a: str, b: str, value: str, edges_a, edges_b) -> DataFrame:
    """(band_a, band_b, n, mean) with every cell of the grid."""
    spark = records.sparkSession
    grid = spark.createDataFrame([(float(x), float(y)) for x in edges_a for y in edges_b], "band_a double, band_b double")
    found = records.groupBy(bucket_of(F.col(a), edges_a).cast("double").alias("band_a"), bucket_of(F.col(b), edges_b).cast("double").alias("band_b")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return F.broadcast(grid).join(found, ["band_a", "band_b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mixture_nll(p: Column, q: Column, lam: Column) -> Column:
    return -F.ln(F.greatest(lam * p + (1 - lam) * q, F.lit(1e-12)))


def _grid_losses(grid: np.ndarray, nll_p: np.ndarray, nll_q: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The summed mixture loss under each weight. Of rows that count once the logarithm is that of a product of eight."""
    p, q, out = np.exp(-nll_p), np.exp(-nll_q), np.zeros(len(grid))
    weights = np.stack([grid, 1 - grid], axis=1)
    once = times == 1
    for rows in (np.flatnonzero(once), np.flatnonzero(~once)):
        for i in range(0, len(rows), 256):
            at = rows[i : i + 256]
            mixed = np.maximum(weights @ np.stack([p[at], q[at]]), 1e-12)
            if once[at[0]] and len(at) == 256 and mixed.max() < 1e30:
                product = mixed[:, :32].copy()
                for j in range(32, 256, 32):
                    product *= mixed[:, j : j + 32]
                out -= np.log(product).sum(axis=1)
            else:
                out -= np.log(mixed) @ times[at].astype("float64")
    return out


def mixture_grid(records: DataFrame, by: list[str], steps: int = 1000) -> DataFrame:
    """(by…, n, losses): summed mixture loss of nll columns ``nll_p`` and ``nll_q`` for each weight i / steps.

    Rows with equal losses are counted first, so the grid meets each pair of losses once per group. Each task adds
    vectors over the grid; what is shuffled is one vector per group and task, never rows times grid.
    """
    grid = np.linspace(0.0, 1.0, steps + 1)
    names = list(by)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        counts: dict[tuple, int] = {}
        for rows in batches:
            for key, part in rows.groupby(names, dropna=False) if names else [((), rows)]:
                key = key if isinstance(key, tuple) else (key,)
                p, q, times = (part[c].to_numpy() for c in ("nll_p", "nll_q", "times"))
                sums[key] = sums.get(key, 0.0) + _grid_losses(grid, p, q, times)
                counts[key] = counts.get(key, 0) + int(times.sum())
        yield pd.DataFrame([(*k, counts[k], v.tolist()) for k, v in sums.items()], columns=[*names, "n", "losses"])

    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "n long", "losses array<double>"])
    pairs = records.groupBy(*names, "nll_p", "nll_q").agg(F.count("*").alias("times"))
    parts = pairs.mapInPandas(run, schema)
    return _summed_grids(parts, names)


def _summed_grids(parts: DataFrame, names: list[str]) -> DataFrame:
    cells = parts.select(*names, "n", F.posexplode("losses").alias("i", "loss"))
    summed = cells.groupBy(*names, "i").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    return summed.groupBy(*names).agg(F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "loss"))), lambda x: x["loss"]).alias("losses"))


def best_lambda(grids: DataFrame, by: list[str], steps: int = 1000) -> DataFrame:
    """(by…, lam, loss): the weight of the smallest mean loss, ties to the smaller weight."""
    at = F.array_position("losses", F.array_min("losses"))
    return grids.select(*by, "n", ((at - 1) / steps).alias("lam"), (F.array_min("losses") / F.col("n")).alias("loss"))


def crossfit_gain(records: DataFrame, group: str, folds: int = 5, steps: int = 1000) -> DataFrame:
    """(fold, group, lam, n, gain): per fold the weight fitted on the other folds, and its gain over nll_q on this one."""
    rows = records.withColumn("fold", (F.col("pos") % folds).cast("int"))
    return _crossfit(mixture_grid(rows, ["fold", group], steps), [group], steps)


def _crossfit(grids: DataFrame, by: list[str], steps: int) -> DataFrame:
    own = written(grids, "mixture")
    cells = own.select("fold", *by, "n", F.posexplode("losses").alias("i", "loss"))
    whole = cells.groupBy(*by, "i").agg(F.sum("n").alias("all_n"), F.sum("loss").alias("all_loss"))
    rest = cells.join(whole, [*by, "i"]).select("fold", *by, "i", "n", "loss", (F.col("all_loss") - F.col("loss")).alias("train"))
    fitted = rest.groupBy("fold", *by).agg(F.min(F.struct("train", "i", "loss")).alias("x"), F.first("n").alias("n"), F.min_by("loss", "i").alias("at_zero"))
    return fitted.select("fold", *by, (F.col("x.i") / steps).alias("lam"), "n", (F.col("at_zero") - F.col("x.loss")).alias("gain"))


def oracle_bound(records: DataFrame) -> DataFrame:
    """One row: mean gain if every position had its own best weight, which is 0 or 1."""
    return records.agg(F.count("*").alias("n"), F.avg(F.col("nll_q") - F.least("nll_p", "nll_q")).alias("gain"))


#: Rows of a group that one block of ranks has, and rows whose packets are made at once.
BLOCK_ROWS, PACKED_ROWS = 1 << 16, 1 << 19
#: Bits of the digest by which rows are ordered: its first 13 hexadecimal digits.
ORDER_BITS = 52


def _packed(ints: np.ndarray, values: np.ndarray) -> tuple[int, int, bytes]:
    """(rows, distinct values, bytes) of sorted numbers with a value each: differences and places in a list of values."""
    known, codes = np.unique(values, return_inverse=True)
    deltas = np.diff(ints, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    places = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(ints), len(known), pa.compress(deltas.tobytes() + places.tobytes() + known.astype("<f8").tobytes(), codec="zstd", asbytes=True)


def _unpacked(rows: int, known: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 12 * rows + 8 * known, codec="zstd"), np.uint8)
    ints = np.cumsum(np.ascontiguousarray(raw[: 8 * rows].reshape(8, -1).T).view("<i8").ravel())
    codes = np.ascontiguousarray(raw[8 * rows : 12 * rows].reshape(4, -1).T).view("<u4").ravel()
    return ints, raw[12 * rows :].view("<f8")[codes]


def _packets(block: np.ndarray, perm: int, ints: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row (block, perm, n, known, data) per block."""
    order = np.lexsort((values, ints, block))
    block, ints, values = block[order], ints[order], values[order]
    edges = [*np.flatnonzero(np.diff(block, prepend=-1)), len(block)]
    rows = [(int(block[a]), perm, *_packed(ints[a:b], values[a:b])) for a, b in zip(edges, edges[1:])]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["block", "perm", "n", "known", "data"])


def permuted_null(records: DataFrame, group: str, permutations: int = 4, folds: int = 5, steps: int = 100) -> DataFrame:
    """(perm, gain): cross-fitted mean gain with nll_p permuted within its group, per replicate, in one job.

    The row that is k-th of its group by position gets the value of the one that is k-th by a seeded digest of the position.
    Digests are even, so their first bits cut each group into blocks: counts of those say which ranks a block covers, and
    its rows are dealt to it packed, with the few columns that are needed, once for all replicates on the side that is
    not permuted. A block's losses are added up where its rows meet; no permuted row is written or joined.
    """
    own = records.select("pos", group, "nll_p", "nll_q")
    sizes = own.groupBy(group).agg(F.count("*").alias("n")).orderBy(group).collect()
    groups = [r[group] for r in sizes]
    bits = np.array([min(16, max(0, (r["n"] - 1) // BLOCK_ROWS).bit_length()) for r in sizes], np.int64)
    base = np.concatenate([[0], np.cumsum(1 << bits)])
    digit = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(100 + i)), F.col("pos").cast("string"))), 1, ORDER_BITS // 4), 16, 10).cast("long").alias(f"h{i}")
    right = own.select(group, "nll_p", *[digit(i) for i in range(permutations)])
    folds_of = F.pmod(F.col("pos"), F.lit(folds))

    def block_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        g = pc.index_in(batch[group], value_set=pa.array(groups, batch.schema.field(group).type), skip_nulls=False).to_numpy(zero_copy_only=False).astype(np.int64)
        return [base[g] + (batch[f"h{i}"].to_numpy() >> (ORDER_BITS - bits[g])) for i in range(permutations)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((permutations, base[-1]), np.int64)
        for batch in batches:
            for i, block in enumerate(block_of(batch)):
                sums[i] += np.bincount(block, minlength=base[-1])
        perm, block = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(perm, pa.int32()), pa.array(block, pa.int32()), pa.array(sums[perm, block])], ["perm", "block", "n"])

    found = right.mapInArrow(counted, "perm int, block int, n long").groupBy("perm", "block").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((permutations, base[-1]), np.int64)
    for r in found:
        counts[r["perm"], r["block"]] = r["n"]
    #: First rank of each block, per replicate.
    starts = np.concatenate([np.zeros((permutations, 1), np.int64), np.cumsum(counts, axis=1)], axis=1)

    def gathered(batches: Iterator[pa.RecordBatch], pack) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(x.num_rows for x in kept) >= PACKED_ROWS:
                yield from pack(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
                kept = []
        if sum(x.num_rows for x in kept):
            yield from pack(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    def pack_right(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = batch["nll_p"].to_numpy()
        for i, block in enumerate(block_of(batch)):
            yield from _packets(block, i, batch[f"h{i}"].to_numpy(), values)

    def pack_left(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rank, fold, values = (batch[c].to_numpy() for c in ("rank", "fold", "nll_q"))
        at = np.stack([np.searchsorted(s, rank, "right") - 1 for s in starts])
        least, most = at.min(axis=0), at.max(axis=0)
        for step in range(int((most - least).max()) + 1):
            on = least + step <= most
            yield from _packets((least + step)[on], -1, rank[on] * folds + fold[on], values[on])

    grid = np.linspace(0.0, 1.0, steps + 1)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        block, parts = None, {}

        def score() -> None:
            if block is None:
                return
            left, q = (np.concatenate(x) for x in zip(*parts[-1]))
            order = np.argsort(left)
            left, q = left[order], q[order]
            g = int(np.searchsorted(base, block, "right") - 1)
            for i in range(permutations):
                if i not in parts:
                    continue
                h, p = (np.concatenate(x) for x in zip(*parts[i]))
                p = p[np.lexsort((p, h))]
                first = int(np.searchsorted(left, starts[i, block] * folds))
                own_q, fold = q[first : first + len(p)], left[first : first + len(p)] % folds
                for f in np.unique(fold):
                    pairs, times = _distinct(p[fold == f], own_q[fold == f])
                    cell = sums.setdefault((i, g, int(f)), [0, 0.0])
                    cell[0] += int(times.sum())
                    cell[1] = cell[1] + _grid_losses(grid, pairs[:, 0], pairs[:, 1], times)

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    score()
                    block, parts = row["block"], {}
                parts.setdefault(row["perm"], []).append(_unpacked(row["n"], row["known"], row["data"]))
        score()
        if sums:
            keys = zip(*sums)
            yield pa.RecordBatch.from_arrays([*[pa.array(k, pa.int32()) for k in keys], pa.array([v[0] for v in sums.values()]), pa.array([v[1].tolist() for v in sums.values()], pa.list_(pa.float64()))], ["perm", "g", "fold", "n", "losses"])

    left = ranked(own.select("pos", group, "nll_q"), [F.col(group), F.col("pos")]).select((F.col("rank") - 1).cast("long").alias("rank"), folds_of.cast("int").alias("fold"), "nll_q")
    packet = "block int, perm int, n int, known int, data binary"
    sides = left.mapInArrow(lambda x: gathered(x, pack_left), packet).unionByName(right.mapInArrow(lambda x: gathered(x, pack_right), packet))
    parts = sides.repartition("block").sortWithinPartitions("block").mapInArrow(met, "perm int, g int, fold int, n long, losses array<double>")
    gains = _crossfit(_summed_grids(parts, ["perm", "g", "fold"]), ["perm", "g"], steps)
    return gains.groupBy("perm").agg((F.sum("gain") / F.sum("n")).alias("gain"))


def _distinct(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs as rows, and how often each occurs."""
    (ps, a), (qs, b) = (np.unique(x, return_inverse=True) for x in (p, q))
    keys, times = np.unique(a.astype(np.int64) * len(qs) + b, return_counts=True)
    return np.stack([ps[keys // len(qs)], qs[keys % len(qs)]], axis=1), times


def excess_verdict(records: DataFrame, group: str, permutations: int = 8, folds: int = 5, steps: int = 1000, confirmed: float = 0.02, absent: float = 0.005, null_margin: float = 0.01) -> DataFrame:
    """One row: cross-fitted mean gain, mean and spread of its permuted null, their excess and its verdict.

    The excess must clear three standard errors of the null beside the fixed thresholds, in nats.
    """
    from .evaluation import verdict

    own = crossfit_gain(records, group, folds, steps).agg((F.sum("gain") / F.sum("n")).alias("gain"))
    null = permuted_null(records, group, permutations, folds, steps).agg(F.count("*").alias("n_perm"), F.avg("gain").alias("null_gain"), F.stddev_pop("gain").alias("null_std"))
    both = own.join(F.broadcast(null)).withColumn("excess", F.col("gain") - F.col("null_gain")).withColumn("noise_floor", 3 * F.col("null_std") / F.sqrt("n_perm"))
    rules = [
        ("COMPLEMENTARITY_ABSENT", f"excess <= greatest({absent}D, noise_floor)", "only recalibration"),
        ("COMPLEMENTARITY_CONFIRMED", f"excess > greatest({confirmed}D, noise_floor, {null_margin}D)", "above the null and its noise"),
    ]
    return verdict(both, rules, ("COMPLEMENTARITY_MARGINAL", "between the thresholds"))


def loglinear_fusion(rows: DataFrame, scale: float, temperature: float, bias: float = 0.0) -> DataFrame:
    """(pos, token, p) from (pos, token, logit, q): softmax of logit + scale ln q / T + bias where the memory has q."""
    fused = F.col("logit") + F.coalesce(scale * F.ln(F.greatest("q", F.lit(1e-12))) / temperature + bias, F.lit(0.0))
    e = rows.withColumn("e", F.exp(fused))
    total = e.groupBy("pos").agg(F.sum("e").alias("z"))
    return e.join(total, "pos").select("pos", "token", (F.col("e") / F.col("z")).alias("p"))


def calibration_states(rows: DataFrame, scales: list[float]) -> DataFrame:
    """(pos, own, own_lnq, rest, support) of rows (pos, token, logit, q, is_target), q null or 0 outside the memory.

    What a position's loss needs under any scale and bias: the target's logit and ln q (null: not in the memory), and
    the exponentials summed over the tokens the memory lacks and, per scale, over those it has, e^(logit + scale ln q);
    all logits less the position's largest. These are sums, so no list of a position's tokens is made. q below 1e-60
    counts as that. A position without a target, or with several, is left out.
    """
    lnq = F.when(F.col("q") > 0, F.ln(F.greatest("q", F.lit(1e-60))))
    top = rows.groupBy("pos").agg(F.max("logit").alias("top"))
    each = rows.join(top, "pos").select("pos", (F.col("logit") - F.col("top")).alias("x"), lnq.alias("lnq"), "is_target")
    support = [F.coalesce(F.sum(F.when(F.col("lnq").isNotNull(), F.exp(F.col("x") + s * F.col("lnq")))), F.lit(0.0)) for s in scales]
    own = F.max(F.when(F.col("is_target"), F.struct("x", "lnq")))
    out = each.groupBy("pos").agg(F.count_if("is_target").alias("n"), own.alias("own"), F.coalesce(F.sum(F.when(F.col("lnq").isNull(), F.exp("x"))), F.lit(0.0)).alias("rest"), F.sum(F.exp("x")).alias("base"), F.array(*support).alias("support"))
    return out.where("n = 1").select("pos", F.col("own.x").alias("own"), F.col("own.lnq").alias("own_lnq"), "rest", "base", "support")


def calibration_grid(rows: DataFrame, scales: list[float], biases: list[float], temperatures: list[float] | None = None) -> DataFrame:
    """(temperature, scale, bias, n, nll, base_nll): mean loss of the fused softmax in every cell, the whole grid in one pass.

    Fused logits are logit + scale ln q / temperature + bias where the memory has the token. ``rows`` as in
    ``calibration_states``. A task adds up matrices over the grid; what is shuffled is a cell per task, never rows times
    cells. Losses are cut at -ln 1e-12.
    """
    cells = [(float(t), float(s)) for t in temperatures or [1.0] for s in scales]
    wanted = sorted({s / t for t, s in cells})
    place = [wanted.index(s / t) for t, s in cells]
    bias = np.array(biases, float)
    states = calibration_states(rows, wanted)
    effective = np.array(wanted)

    def run(batches):
        sums, n, base = np.zeros((len(wanted), len(bias))), 0, 0.0
        for part in batches:
            for i in range(0, len(part), 256):
                own = part.iloc[i : i + 256]
                x, lnq = own["own"].to_numpy(), own["own_lnq"].to_numpy(float)
                held = ~np.isnan(lnq)
                support = np.stack(own["support"].to_numpy())
                total = own["rest"].to_numpy()[:, None, None] + support[:, :, None] * np.exp(bias)[None, None, :]
                fused = x[:, None, None] + np.where(held, 1.0, 0.0)[:, None, None] * (effective[None, :, None] * np.nan_to_num(lnq)[:, None, None] + bias[None, None, :])
                sums += np.minimum(np.log(total) - fused, -np.log(1e-12)).sum(axis=0)
                base += np.minimum(np.log(own["base"].to_numpy()) - x, -np.log(1e-12)).sum()
                n += len(own)
        if n:
            at = [(i, j) for i in range(len(wanted)) for j in range(len(bias))]
            yield pd.DataFrame({"i": [i for i, _ in at], "j": [j for _, j in at], "n": n, "loss": sums.ravel(), "base": base})

    parts = states.mapInPandas(run, "i int, j int, n long, loss double, base double")
    whole = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), (F.sum("loss") / F.sum("n")).alias("nll"), (F.sum("base") / F.sum("n")).alias("base_nll"))
    names = rows.sparkSession.createDataFrame([(t, s, i, float(b), j) for (t, s), i in zip(cells, place, strict=True) for j, b in enumerate(biases)], "temperature double, scale double, i int, bias double, j int")
    return whole.join(F.broadcast(names), ["i", "j"]).select("temperature", "scale", "bias", "n", "nll", "base_nll")


def best_calibration(grid: DataFrame) -> DataFrame:
    """One row: the cell of the smallest loss (ties to the smaller temperature, scale, bias) and its gain over the bare logits."""
    x = grid.agg(F.min(F.struct("nll", "temperature", "scale", "bias", "n", "base_nll")).alias("x")).select("x.*").where("nll is not null")
    gain = F.col("base_nll") - F.col("nll")
    return x.select("temperature", "scale", "bias", "n", "nll", "base_nll", gain.alias("delta_nats"), (gain / np.log(2)).alias("delta_bits"))


def temperature_grid(records: DataFrame, temperatures: list[float]) -> DataFrame:
    """(temperature, nll): mean loss of the geometric mixture p^(1/T) q, unnormalised, for each temperature."""
    sums = records.agg(*[F.avg(F.col("nll_p") / t + F.col("nll_q") * (1 - 1 / t)).alias(f"t{i}") for i, t in enumerate(temperatures)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(temperatures)])).alias("x")).select("x.*")


def distribution_features(dist: DataFrame) -> DataFrame:
    """(pos, entropy, top1, top_p, support) of sparse distributions (pos, token, p)."""
    return dist.groupBy("pos").agg(F.sum(-F.col("p") * F.ln(F.greatest("p", F.lit(1e-12)))).alias("entropy"), F.max(F.struct("p", F.negative("token").alias("m"))).alias("x"), F.count("*").alias("support")).select("pos", "entropy", F.negative("x.m").alias("top1"), F.col("x.p").alias("top_p"), "support")


def gate(features: DataFrame, mode: str, threshold: float) -> DataFrame:
    """Adds ``open``: by expected gain (density ratio), pseudo label (agreement), confidence of the memory, or both."""
    ratio, sure = F.col("ratio") >= threshold, F.col("top_p") >= threshold
    rule = {"expected_kl": ratio, "pseudo_label": F.col("agrees"), "memory_top1": sure, "hybrid": sure & (ratio | F.col("agrees"))}[mode]
    return features.withColumn("open", rule & (F.col("task") != "semantic"))


def logistic_policy(records: DataFrame, features: list[str], label: str, l2: float = 1e-3) -> DataFrame:
    """Adds ``p_open``: standardised features, L2 logistic regression, fitted where ``train`` holds."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stages = [VectorAssembler(inputCols=features, outputCol="__x"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True), LogisticRegression(featuresCol="__z", labelCol="__y", regParam=l2, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c")]
    rows = records.withColumn("__y", F.col(label).cast("double"))
    fitted = Pipeline(stages=stages).fit(rows.where("train")).transform(rows)
    return fitted.withColumn("p_open", vector_to_array("__p")[1]).drop("__x", "__z", "__y", "__p", "__r", "__c")


def auc(records: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve with half credit for ties, from counts per distinct score."""
    counts = records.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos_n"), F.count_if(F.col(label) == 0).alias("neg_n"))
    summed = ranked(counts, [F.col("s")], {"below": F.col("neg_n")})
    won = F.sum(F.col("pos_n") * (F.col("below") - F.col("neg_n") / 2))
    return summed.agg((won / F.nullif(F.sum("pos_n") * F.sum("neg_n"), F.lit(0))).alias("auc"))


def banded_accuracy(records: DataFrame, by: str, arms: list[str], edges) -> DataFrame:
    """(band, n, accuracy of each arm) by surprisal band, and overall with a null band."""
    rows = records.withColumn("band", bucket_of(F.col(by), edges))
    return rows.rollup("band").agg(F.count("*").alias("n"), *[F.avg(F.col(a).cast("int")).alias(a) for a in arms])


def threshold_curve(records: DataFrame, by: str, value: str, taus: list[float]) -> DataFrame:
    """(tau, kept, gain): share of rows with ``by`` at or above each threshold, and their summed value over all rows."""
    sums = records.agg(F.count("*").alias("n"), *[F.struct(F.count_if(F.col(by) >= t).alias("k"), F.coalesce(F.sum(F.when(F.col(by) >= t, F.col(value))), F.lit(0.0)).alias("v")).alias(f"t{i}") for i, t in enumerate(taus)])
    cells = F.array(*[F.struct(F.lit(float(t)).alias("tau"), (F.col(f"t{i}.k") / F.col("n")).alias("kept"), (F.col(f"t{i}.v") / F.col("n")).alias("gain")) for i, t in enumerate(taus)])
    return sums.select(F.explode(cells).alias("x")).select("x.*")


def concentration(records: DataFrame, value: str, qs=(1, 5, 10, 25, 50)) -> DataFrame:
    """(q, share): part of the total value in the top q per cent; with the negative share and sums beside it."""
    curve = gain_curve(records, qs, value)
    whole = records.agg(F.avg(value).alias("mean"), F.avg((F.col(value) < 0).cast("int")).alias("negative_share"), F.sum(F.when(F.col(value) < 0, F.col(value)).otherwise(0.0)).alias("negative_sum"))
    return curve.join(F.broadcast(whole)).select("q", (F.col("gain") / F.col("mean")).alias("share"), "negative_share", "negative_sum")


def masked_share(records: DataFrame, count: str, value: str, thresholds: list[int]) -> DataFrame:
    """(threshold, share): value of rows with at least so many counts over the total."""
    out = threshold_curve(records, count, value, [float(t) for t in thresholds])
    whole = records.agg((F.sum(value) / F.count("*")).alias("mean"))
    return out.join(F.broadcast(whole)).select(F.col("tau").cast("int").alias("threshold"), (F.col("gain") / F.col("mean")).alias("share"))


def rebase_counts(records: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """Records with the count of their own key; a key without one stays null."""
    return records.join(counts, key, "left")


def best_threshold(records: DataFrame, score: str, value: str) -> DataFrame:
    """One row (threshold, total, kept): keep rows with a score at or above it; the largest total, ties kept whole."""
    per = records.groupBy(F.col(score).alias("s")).agg(F.sum(value).alias("v"), F.count("*").alias("k"))
    summed = ranked(per, [F.desc("s")], {"total": F.col("v"), "kept": F.col("k")})
    return summed.agg(F.max(F.struct("total", "s", "kept")).alias("x")).select(F.col("x.s").alias("threshold"), "x.total", "x.kept")


def fold_of(records: DataFrame, folds: int) -> DataFrame:
    """Adds ``fold``: contiguous stretches of the stream of nearly equal size."""
    n = records.count()
    return ranked(records, [F.col("pos")]).withColumn("fold", F.floor((F.col("rank") - 1) * folds / max(1, n)).cast("int")).drop("rank")


def gate_study(records: DataFrame, score: str, value: str, folds: int = 4) -> DataFrame:
    """(fold, threshold, gain): the threshold best on the other folds, and the mean value it keeps on this one."""
    rows = written(fold_of(records.select("pos", score, value), folds), "folds")
    out = None
    for f in range(folds):
        best = best_threshold(rows.where(F.col("fold") != f), score, value).select("threshold")
        one = rows.where(F.col("fold") == f).join(F.broadcast(best)).agg(F.first("threshold").alias("threshold"), F.avg(F.when(F.col(score) >= F.col("threshold"), F.col(value)).otherwise(0.0)).alias("gain")).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


ORACLE_FIELDS = ("nll_trained", "delta", "margin", "hit_trained")


def ridge_gate(records: DataFrame, features: list[str], target: str, l2: float = 1.0) -> DataFrame:
    """Adds ``predicted``: ridge regression of the gain on observable features, fitted where ``train`` holds.

    Gram sums come from Spark, the d x d solve from the driver. Fields that a gate cannot see are refused by name.
    """
    seen = [f for f in features if f in ORACLE_FIELDS]
    if seen:
        raise ValueError(f"not observable when a gate decides: {', '.join(seen)}")
    train = records.where("train")
    stats = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    z = [F.lit(1.0)] + [(F.col(f) - stats[f"m_{f}"]) / (stats[f"s_{f}"] or 1.0) for f in features]
    d = len(z)
    sums = train.agg(*[F.sum(z[i] * z[j]).alias(f"g_{i}_{j}") for i in range(d) for j in range(i, d)], *[F.sum(z[i] * F.col(target)).alias(f"y_{i}") for i in range(d)]).first()
    gram = np.array([[sums[f"g_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
    weights = np.linalg.solve(gram + l2 * np.diag([0.0] + [1.0] * (d - 1)), np.array([sums[f"y_{i}"] for i in range(d)], float))
    return records.withColumn("predicted", reduce(lambda a, b: a + b, [x * float(w) for x, w in zip(z, weights, strict=True)]))


def changed_rows(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """(key, changed): does any element of two vector columns differ; NaN equals NaN, a missing side is a change."""
    j = a.select(key, F.col(column).alias("x")).join(b.select(key, F.col(column).alias("y")), key, "full_outer")
    differs = F.exists(F.zip_with("x", "y", lambda x, y: ~x.eqNullSafe(y)), lambda v: v)
    return j.select(key, F.coalesce(differs, F.lit(True)).alias("changed"))


def last_change(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds ``last`` (position of the last earlier changed row, -1 if none) and ``distance``.

    The stream is dealt by ranges of position; each range looks back within itself and takes over the last change
    of the ranges before it.
    """
    parts = partitions or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(records.repartitionByRange(parts, "pos").withColumn("__p", F.spark_partition_id()), "ranges")
    mark = F.when(F.col("changed"), F.col("pos"))
    within = Window.partitionBy("__p").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy("__p").agg(F.max(mark).alias("end"))
    carried = ends.select("__p", F.max("end").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    out = dealt.withColumn("__own", F.last(mark, ignorenulls=True).over(within)).join(F.broadcast(carried), "__p")
    last = F.coalesce("__own", "__carried", F.lit(-1))
    return out.withColumn("last", last).withColumn("distance", F.when(F.col("last") >= 0, F.col("pos") - F.col("last"))).drop("__p", "__own", "__carried")


#: The ranges of distance of ``dose_response``.
DISTANCES = ((1, 1), (2, 2), (3, 4), (5, 8), (9, 16), (17, 32), (33, 64), (65, 128), (129, 1 << 40))


def block_split(records: DataFrame, block: int) -> DataFrame:
    """``last_change`` with ``same_block`` and ``boundary``: is the last earlier change in the position's own block of ``block``.

    A boundary means that the last visible change lies in an earlier block; a position without an earlier change is neither.
    """
    own = F.floor(F.col("pos") / block) == F.floor(F.col("last") / block)
    return last_change(records).withColumn("same_block", (F.col("last") >= 0) & own).withColumn("boundary", (F.col("last") >= 0) & ~own)


def dose_response(split: DataFrame, value: str, ranges=DISTANCES, small: float = 1e-3) -> DataFrame:
    """(low, high, n, mean, mean_abs, above, exact_zero) of unchanged rows in whose block a change came before, by its distance.

    above: share with an absolute value over ``small``. Ranges without rows stay, with n 0 and nulls.
    """
    grid = split.sparkSession.createDataFrame([(int(a), int(b)) for a, b in ranges], "low long, high long")
    at = F.coalesce(*[F.when(F.col("distance").between(a, b), F.lit(a)) for a, b in ranges]).cast("long")
    v, one = F.col(value), lambda c: F.avg(c.cast("int"))
    rows = split.where("same_block and not changed").groupBy(at.alias("low")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.avg(F.abs(v)).alias("mean_abs"), one(F.abs(v) > small).alias("above"), one(v == 0).alias("exact_zero"))
    return F.broadcast(grid).join(rows, "low", "left").withColumn("n", F.coalesce("n", F.lit(0))).select("low", "high", "n", "mean", "mean_abs", "above", "exact_zero")


def zero_rule(split: DataFrame, value: str) -> DataFrame:
    """One row: how far exact zeros of ``value`` are those behind a block boundary; zeros_not_boundary are the rule's failures."""
    zero = F.col(value) == 0
    sums = split.agg(F.count("*").alias("n"), F.count_if(zero).alias("n_zero"), F.count_if(zero & ~F.col("changed")).alias("n_zero_untouched"), F.count_if(zero & F.col("changed")).alias("n_zero_changed"), F.count_if("boundary").alias("boundary_n"), F.count_if(F.col("boundary") & zero).alias("boundary_zero"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return sums.withColumn("zeros_not_boundary", F.col("n_zero") - F.col("boundary_zero")).withColumn("boundary_zero_share", share("boundary_zero", "boundary_n")).withColumn("zeros_explained", share("boundary_zero", "n_zero"))


def compare_distributions(layers: DataFrame, final: DataFrame, k: int = 10, least: float = 1e-12) -> DataFrame:
    """(item, layer, kl, overlap) of sparse distributions (item, layer, token, p) against the item's final one (item, token, p).

    Tokens that either side has count; one that a side lacks has ``least`` there, and both sides are scaled to one
    again: kl = sum p ln(p / q) of final p and layer q, from three sums in one pass. overlap: share of the final k most
    probable tokens among the layer's k (ties to the smaller token). A layer needs a row to be compared.
    """
    each = layers.select("item", "layer").distinct()
    p, q = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(least)), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(least))
    both = final.select("item", "token", "p").join(each, "item").join(layers.select("item", "layer", "token", F.col("p").alias("q")), ["item", "layer", "token"], "full_outer")
    sums = both.groupBy("item", "layer").agg(F.sum(p).alias("sp"), F.sum(q).alias("sq"), F.sum(p * (F.ln(p) - F.ln(q))).alias("s"), F.count("p").alias("final_tokens"))
    kl = sums.where("final_tokens > 0").select("item", "layer", (F.col("s") / F.col("sp") - F.ln("sp") + F.ln("sq")).alias("kl"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("p"), "token"))
    top = final.withColumn("r", rank("item")).where(F.col("r") <= k).select("item", "token")
    shared = layers.withColumn("r", rank("item", "layer")).where(F.col("r") <= k).join(top, ["item", "token"]).groupBy("item", "layer").agg((F.count("*") / k).alias("overlap"))
    return kl.join(shared, ["item", "layer"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def distribution_depth(compared: DataFrame, share: float = 0.5, overlap: float = 0.3) -> DataFrame:
    """(item, by_kl, by_overlap): the first layer whose kl is at most ``share`` of the item's largest, and with more overlap than that."""
    rows = compared.join(compared.groupBy("item").agg(F.max("kl").alias("most")), "item")
    return rows.groupBy("item").agg(F.min(F.when(F.col("kl") <= share * F.col("most"), F.col("layer"))).alias("by_kl"), F.min(F.when(F.col("overlap") > overlap, F.col("layer"))).alias("by_overlap"))


def transition_points(curves: DataFrame) -> DataFrame:
    """Per item of (item, layer, value): the first layers at most half the maximum, above 0.3, and of two positives in a row."""
    w = Window.partitionBy("item")
    rows = curves.withColumn("top", F.max("value").over(w)).withColumn("after", F.lead("value").over(w.orderBy("layer")))
    first = lambda c: F.min(F.when(c, F.col("layer")))
    return rows.groupBy("item").agg(first(F.col("value") <= F.col("top") / 2).alias("half"), first(F.col("value") > 0.3).alias("above"), first((F.col("value") > 0) & (F.col("after") > 0)).alias("steady"))
