"""Gates, routing, contrasts and rule sets against plain recomputations and hand-sized cases."""

import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import address as A
from corpuslab.operators import gates as G


def test_rule_sets_by_hand(spark):
    rows = [
        (0, 0.30, 0.50, 0.05, 0.10, None, None, "ROWS_CARRY_THE_TRIGRAM"),
        (1, 0.15, 0.50, 0.05, 0.10, None, None, "ROWS_DEGRADED"),
        (2, 0.05, 0.50, 0.01, 0.02, 0.9, 0.0, "ROWS_NEARLY_DEAD"),
        (3, 0.10, 0.90, 0.05, 0.10, 0.10, 0.02, "ROWS_DEAD"),
        (4, 0.10, 0.90, 0.05, 0.10, None, 0.02, "ROWS_NEARLY_DEAD"),
        (5, 0.10, 0.0, 0.05, 0.10, 0.1, 0.02, "INCOMPLETE"),
        (6, 0.10, 0.9, None, 0.10, 0.1, 0.02, "INCOMPLETE"),
    ]
    schema = "panel int, linear double, counted double, shuffled double, majority double, mlp double, mlp_shuffled double, want string"
    panels = spark.createDataFrame(rows, schema)
    got = G.row_recovery(panels).collect()
    assert all(r["verdict"] == r["want"] for r in got)
    pick = lambda keep: G.most_conservative(G.row_recovery(panels.where(keep))).first()
    assert (pick("panel < 3")["verdict"], pick("panel < 3")["agreement"]) == ("ROWS_NEARLY_DEAD", False)
    assert pick("panel in (0, 3)")["verdict"] == "ROWS_DEAD"
    assert pick("panel = 1")["agreement"] is True
    assert pick("panel > 3")["verdict"] == pick("panel > 90")["verdict"] == "INCOMPLETE"

    nan = float("nan")
    gates = [
        (1, 5, 0.9, 0.5, 0.1, 0.2, 0.1, "INCOMPLETE"),
        (0, 0, 0.9, 0.5, 0.1, 0.2, 0.1, "UNDERPOWERED"),
        (0, 5, 0.4, 0.1, 0.1, 0.2, 0.1, "DISEASE_NOT_REPRODUCED"),
        (0, 5, 0.95, 0.92, 0.1, 0.2, 0.1, "GATE_STILL_SATURATED"),
        (0, 5, 0.95, nan, 0.1, 0.2, 0.1, "GATE_STILL_SATURATED"),
        (0, 5, 0.9, 0.5, 0.1, 0.2, 0.1, "GATE_SELECTIVITY_HELPS"),
        (0, 5, 0.9, 0.5, 0.1, 0.11, 0.1, "GATE_SELECTIVITY_NO_EFFECT"),
        (0, 5, 0.9, 0.5, 0.1, 0.2, 0.195, "PARTIAL"),
        (0, 5, 0.9, 0.8, 0.1, 0.2, 0.1, "PARTIAL"),
    ]
    got = G.judged(spark.createDataFrame(gates, "missing int, injected int, open_scalar double, open_per_dim double, real_scalar double, real_per_dim double, control_per_dim double, want string"), G.GATE_SELECTIVITY).collect()
    assert all(r["verdict"] == r["want"] for r in got), [(r["want"], r["verdict"]) for r in got]

    moved = [(-0.06, -4.0, None, "ROWS_HARMED"), (-0.06, -2.0, None, "ROWS_STUCK"), (0.06, 4.0, None, "ROWS_RESHAPEABLE"), (0.06, None, 0.02, "ROWS_RESHAPEABLE_BUT_NULL_MOVED"), (0.04, 9.0, None, "ROWS_STUCK")]
    got = G.judged(spark.createDataFrame(moved, "delta double, t double, shuffled_delta double, want string"), G.RESHAPING).collect()
    assert all(r["verdict"] == r["want"] for r in got)
    hits = [(0.1, 3.0, "GAIN"), (0.1, 2.9, "FLAT"), (0.1, None, "FLAT"), (0.1, nan, "FLAT"), (-0.1, 9.0, "FLAT"), (None, None, "FLAT")]
    got = G.judged(spark.createDataFrame(hits, "delta double, t double, want string"), G.TAIL_HITS).collect()
    assert all(r["verdict"] == r["want"] for r in got)


def test_depth_shift_by_hand(spark):
    cases = {
        "UNDERPOWERED": (0.0, [(9, 5, 9)] * 3),
        "DEPTH_FREED": (0.1, [(9, 5, 8), (9, 6, 9), (9, None, 9)]),
        "PERTURBATION_ONLY": (0.1, [(9, 5, 5), (9, 9, 9), (9, 8, 9)]),
        "DEPTH_NULL": (0.1, [(9, 9, 9), (9, 8, 1), (9, 10, 9)]),
        "MIXED": (0.1, [(9, 5, 8), (9, 5, 5), (9, None, 9)]),
    }
    rows = [(name, tv, i, *x) for name, (tv, own) in cases.items() for i, x in enumerate(own)]
    out = G.depth_shift(spark.createDataFrame(rows, "report string, tv double, instrument int, off int, real int, shuf int"), ["report"])
    assert all(r["report"] == r["verdict"] for r in out.collect())


def test_gates_by_hand(spark):
    loss = lambda r, c, b: [("real", r), ("control", c), ("bare", b)]
    rows = [(corpus, seed, arm, math.log(v)) for corpus in range(6) for seed in range(3) for arm, v in loss(2.0, 1.0 if corpus == 0 else 3.0, 4.0)]
    gate = lambda rows: G.loss_phase_gate(spark.createDataFrame(rows, "corpus int, seed int, arm string, loss double"), "real", "control", "bare").first()
    first = gate(rows)
    assert (first["corpora_below_control"], first["runs_below_control"], first["passed"]) == (5, 15, True)
    assert gate([r if r[:3] != (5, 0, "bare") else (*r[:3], 0.0) for r in rows])["passed"] is False
    assert gate([r for r in rows if r[:3] != (5, 0, "bare")])["passed"] is False

    tasks = [("c", "win", 0.5, 0.5, 0.4), ("c", "even", 0.5, 0.6, 0.4), ("c", "bad", 0.3, 0.3, 0.4), ("c", "gone", 0.3, None, 0.4)]
    long = [(c, t, arm, v) for c, t, *own in tasks for arm, v in zip(("r", "k", "b"), own, strict=True) if v is not None]
    gated = G.task_gate(spark.createDataFrame(long, "corpus string, task string, arm string, value double"), "r", "k", "b")
    assert {r["task"]: (r["candidate"], r["severe"]) for r in gated.collect()} == {"win": (True, False), "even": (False, True), "bad": (False, True)}
    one = G.task_gate_summary(gated).first()
    assert (one["candidates"], one["severe"], one["passed"]) == (1, 2, False)
    assert G.task_gate_summary(gated.where("task = 'win'")).first()["passed"] is True
    assert G.task_gate_summary(gated.limit(0)).first()["passed"] is False


def test_routing_and_contrast_against_plain_python(spark):
    rng = random.Random(4)
    arms = ["a", "b", "c"]
    rows = [(seed, f"t{i % 2}", i, arm, rng.random() < 0.4) for seed in range(3) for i in range(40) for arm in arms if rng.random() < 0.9]
    held = {(s, i, arm): ok for s, _, i, arm, ok in rows}
    out = G.routing_over_seeds(spark.createDataFrame(rows, "seed int, task string, item_id int, arm string, correct boolean"), arms, {"best": ["a", "b"]})
    got = {(r["task"], r["policy"]): r for r in out.collect()}
    present = {(s, i) for s, i, _ in held}
    for task in ("t0", "t1", None):
        for policy, own in {"always_a": ["a"], "always_c": ["c"], "best": ["a", "b"]}.items():
            per = []
            for seed in range(3):
                items = [i for s, i in present if s == seed and task in (None, f"t{i % 2}")]
                per.append(sum(any(held.get((seed, i, arm), False) for arm in own) for i in items) / len(items))
            assert math.isclose(got[task, policy]["mean"], statistics.fmean(per))
            assert math.isclose(got[task, policy]["deviation"], statistics.pstdev(per), abs_tol=1e-12)

    values = [(rng.choice("xyz"), round(rng.gauss(0, 1), 3)) for _ in range(301)] + [("one", 2.0)]
    medians = {r["g"]: r["median"] for r in G.grouped_median(spark.createDataFrame(values, "g string, v double").repartition(3), "g", "v").collect()}
    assert medians.keys() == {"x", "y", "z", "one"}
    assert all(math.isclose(m, statistics.median(v for g, v in values if g == k), abs_tol=1e-9) for k, m in medians.items())

    hits = [(float(i % 7), i % 3 == 0, i % 2 == 0) for i in range(100)]
    r = G.tail_hits(spark.createDataFrame(hits, "surprisal double, base boolean, arm boolean"), 3.0, "base", ["arm"]).first()
    d = [int(a) - int(b) for s, b, a in hits if s >= 3]
    assert (r["n_total"], r["n_tail"]) == (100, len(d)) and math.isclose(r["delta"], statistics.fmean(d))
    assert math.isclose(r["t"], statistics.fmean(d) / (statistics.stdev(d) / math.sqrt(len(d))))


def test_nulls_and_empty_arms(spark):
    rows = spark.createDataFrame([("a", "x", None), ("a", None, "p"), ("b", "x", None), ("b", "x", "p")], "arm string, l string, m string")
    out = {(r["arm_a"], r["arm_b"], r["kind"]): r["tv"] for r in G.joint_variation(rows, "arm", ["l", "m"], [("a", "b"), ("a", "none")]).collect()}
    assert out["a", "b", "l"] == 0.5 and out["a", "b", "m"] == 0.0 and out["a", "b", "joint"] == 0.5
    assert out["a", "none", "l"] is None
    deltas = G.channel_deltas(spark.createDataFrame([("a", 1.0, True), ("a", float("inf"), None), ("b", 3.0, True), ("c", None, False)], "channel string, logp double, hit boolean"), [("a", "b"), ("a", "c")])
    assert {r["channel_b"]: (r["logp_delta"], r["hit_delta"]) for r in deltas.collect()} == {"b": (2.0, 0.5), "c": (None, -0.5)}
    read = spark.createDataFrame([("a", True, None), ("a", False, True)], "arm string, r1 boolean, r2 boolean")
    assert tuple(G.rule_disagreements(read, "arm", ["r1", "r2"]).first())[3:] == (1, 1, 0)
    assert G.correlation(spark.createDataFrame([(1, 1.0, None), (1, 2.0, 4.0), (1, 3.0, 6.0)], "g int, a double, b double"), ["g"]).select("n", F.round("r", 9)).first() == (2, 1.0)


def test_window_keys_against_the_hash_library(spark):
    xxhash = pytest.importorskip("xxhash")
    rng = random.Random(6)
    rows = [tuple(rng.randrange(1 << 40) for _ in range(3)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a long, b long, c long").withColumn("key", A.window_key([F.col(c) for c in "abc"]))

    def plain(values, seed=42):
        for v in values:
            seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
        return seed - (1 << 64) if seed >> 63 else seed

    assert all(r["key"] == plain((r["a"], r["b"], r["c"])) for r in df.collect())
