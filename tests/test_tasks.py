"""Authoritative tasks and resolutions against plain Python on fixtures with chains, cycles and duplicates."""

import random

import pytest

from matquarry.operators import graph, tasks
from pyspark.sql import functions as F

ORDER = tasks.STEPS


def plain_choice(rows):
    """rows: id -> (key, step, claims, depends_on, verified)."""
    vector = {}
    for t in rows:
        vector[t] = [0] * 8
    for t, (_, step, _, needs, n) in rows.items():
        at = ORDER[::-1].index(step)
        vector[t][at] += n
        seen, todo = set(), list(needs)
        while todo:
            x = todo.pop()
            if x in seen or x not in rows:
                seen.add(x)
                continue
            seen.add(x)
            vector[x][at] += n
            todo += rows[x][3]
    keys = sorted({(ORDER.index(step), key) for key, step, *_ in rows.values()})
    chosen = {}
    for _, key in keys:
        fit = [t for t, r in rows.items() if r[0] == key and all(n in rows and chosen.get(rows[n][0]) == n for n in r[3])]
        order = lambda t: ([-x for x in vector[t]], -rows[t][2] if any(vector[t]) else rows[t][2], t)
        if fit:
            chosen[key] = min(fit, key=order)
    out = set()
    for t, r in rows.items():
        c = chosen.get(r[0])
        out.add((t, r[0], c, "incompatible_dependency_manifest" if c is None else "duplicate_logical_task" if c != t else None))
    return vector, out


@pytest.mark.parametrize("seed", [1, 2])
def test_authoritative_tasks(spark, seed):
    r = random.Random(seed)
    ids = [f"t{i:03}" for i in range(120)]
    rows = {}
    for t in ids:
        step = r.choice(ORDER)
        needs = r.sample([*ids, "lost"], r.choice([0, 0, 1, 2])) if r.random() < 0.5 else []
        rows[t] = (f"{step}-{r.randrange(6)}", step, r.randrange(3), needs, r.choice([0, 0, 1, 2]))
    # Chains within a step, and a cycle.
    for i, (a, b) in enumerate([("x1", "x2"), ("x2", "x3"), ("y1", "y2"), ("y2", "y1")]):
        rows[a] = (f"novelty-{a}" if a[0] == "x" else "target-y", "novelty" if a[0] == "x" else "target", 1, [b], i)
    rows["x3"], rows["x0"] = ("novelty-w", "novelty", 0, [], 1), ("novelty-x1", "novelty", 2, [], 0)
    df = spark.createDataFrame([(t, *x) for t, x in rows.items()], "task_id string, logical_key string, step string, claims long, depends_on array<string>, verified long")
    edges = df.select(F.col("task_id").alias("a"), F.explode("depends_on").alias("b")).join(df.select(F.col("task_id").alias("b")), "b", "left_semi")
    vectors = tasks.progress_vectors(df, graph.closure(edges.select("a", "b")))
    vector, expected = plain_choice(rows)
    assert {x.task_id: x.progress for x in vectors.collect()} == vector
    got = tasks.authoritative(df.join(vectors, "task_id"))
    assert {(x.task_id, x.logical_key, x.active, x.reason) for x in got.collect()} == expected
    assert {x[3] for x in expected} == {None, "duplicate_logical_task", "incompatible_dependency_manifest"}
    assert tasks.authoritative(df.join(vectors, "task_id").limit(0)).count() == 0


RECORDS = "record_id long, identity string, task_id string, model string, properties map<string, double>, evidence array<string>, supersedes array<string>, eligible boolean, novelty_status string, matched boolean, satisfies boolean"


def test_resolutions(spark):
    tasks_ = spark.createDataFrame(
        [
            ("s1", "structure", "A", [], ["gap"]),
            ("c1", "conditions", "B", ["s1"], ["gap"]),
            ("v1", "verification", "C", [], None),
            ("n1", "novelty", "A", [], None),
            ("n2", "novelty", "B", [], None),
            ("k1", "conflict", "D", [], ["gap", "tc"]),
            ("e1", "experiment", "D", [], None),
            ("s2", "structure", "E", [], None),
        ],
        "task_id string, step string, source_identity string, depends_on array<string>, conflict_properties array<string>",
    )
    rows = [
        # A: two equal claims and one more, covered by three returns; a fourth return meets nothing.
        (1, "A", None, "m", {"gap": 1.0}, ["e1"], None, True, None, None, None),
        (2, "A", None, "n", {"gap": 1.0}, ["e2"], None, True, None, None, None),
        (3, "A", None, "m", {"tc": 5.0}, None, None, True, None, None, None),
        (11, "A2", "s1", "z", {"gap": 1.0 + 1e-13, "hull": 0.0}, None, None, True, None, True, True),
        (12, "A2", "s1", "z", {"gap": 1.0}, None, None, True, None, True, True),
        (13, "A", "s1", "z", {"tc": 5.0}, None, None, True, None, True, True),
        (14, "A2", "s1", "z", {"tc": 6.0}, None, None, True, None, True, True),
        # B: conditions need the model; the source includes returns of the task it depends on.
        (20, "B", None, "M", {"gap": 2.0}, None, None, True, None, None, None),
        (21, "B", "s1", "q", {"gap": 3.0}, None, None, True, None, True, False),
        (22, "B2", "c1", "m", {"gap": 2.0}, None, None, True, None, True, True),
        # C: verified, but not by enough returns of the model.
        (30, "C", None, "m", {"gap": 1.0}, None, None, True, None, None, None),
        (31, "C", "v1", "m", {"gap": 1.0}, None, None, True, None, True, True),
        # Novelty: one status for A, two for B.
        (40, "A", "n1", "m", {"gap": 1.0}, None, None, True, "known_reference", True, True),
        (41, "A", "n1", "k", {"gap": 1.0}, None, None, True, "known_reference", True, True),
        (42, "B", "n2", "m", {"gap": 9.0}, None, None, True, "known_reference", True, True),
        (43, "B", "n2", "m", {"gap": 9.0}, None, None, True, "screened_unverified", True, True),
        # D: 51 covers all that it replaces; 52 lacks a property of it; 53 names evidence that nobody has.
        (50, "D", None, "m", {"gap": 1.0}, ["EV-1", "x"], None, True, None, None, None),
        (54, "D", None, "m", {"gap": 1.0, "tc": 3.0}, ["ev-2"], None, True, None, None, None),
        (51, "D", "k1", "m", {"gap": 1.5}, ["ev-1"], ["ev-1"], True, None, True, None),
        (52, "D", "k1", "m", {"gap": 1.5}, None, ["ev-2"], True, None, True, None),
        (53, "D", "k1", "m", {"gap": 1.5}, None, ["ev-1", "ev-9"], True, None, True, None),
        (55, "D", "e1", "m", {"gap": 1.5}, None, None, True, None, True, True),
        (56, "D", "e1", "m", {"gap": 1.5}, None, None, True, None, True, False),
        # No such task, another lineage, and an uncovered migration.
        (60, "A", "zz", "m", {"gap": 1.0}, None, None, True, None, True, True),
        (61, "A", "s1", "m", {"gap": 1.0}, None, None, True, None, False, True),
        (70, "E", None, "m", {"gap": 1.0}, None, None, True, None, None, None),
        (71, "E", None, "m", {"gap": 1.0}, None, None, True, None, None, None),
        (72, "E2", "s2", "m", {"gap": 1.0}, None, None, True, None, True, True),
    ]
    got = {x.record_id: x.state for x in tasks.resolve(spark.createDataFrame(rows, RECORDS), tasks_).collect()}
    expected = dict.fromkeys((1, 2, 3, 50), "superseded") | dict.fromkeys((11, 12, 13, 30, 31, 40, 41, 54, 51, 55, 70, 71), "active")
    expected |= dict.fromkeys((14, 21, 42, 43, 52, 53, 56, 72), "rejected") | {60: "manifest_missing", 61: "quarantined"}
    # 21 is a claim of B that no conditions return meets, so B's return isn't accepted and 20 stays.
    assert got == expected | {20: "active", 22: "rejected"}
    assert tasks.resolve(spark.createDataFrame([], RECORDS), tasks_).count() == 0
