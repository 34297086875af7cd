import math

import numpy as np

from spanloom.llm import nn_descent as N


def brute(rows, threshold=0.93):
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        n = math.sqrt(sum(x * x for x in v))
        return np.array(v) / n if n else None

    units = [unit(v) if i is not None and lab is not None else None for i, v, lab in rows]
    n = len(rows)
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2]:
                if len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                    near[i].append(j)
    out, seen = [], {}
    for i in range(n):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for k in near[todo.pop()]:
                    if k not in group:
                        group.add(k)
                        todo.append(k)
            least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        out.append((rows[i][0], len(near[i]), seen[i], rows[i][0] is not None and rows[i][0] == seen[i]))
    return sorted(out, key=str)


def table(seed=1, n=900):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = rows[int(rng.integers(0, len(rows)))]
            v, label = np.array(base[1]) + rng.normal(0, 0.05, 16), base[2]
        else:
            v, label = rng.normal(0, 1, 16), int(rng.integers(0, 3))
        rows.append((i, [float(x) for x in np.float32(v)], label))
    centre = np.ones(16)  # a large group, more than a list holds
    rows += [(1000 + i, [float(x) for x in np.float32(centre + rng.normal(0, 0.05, 16))], 1) for i in range(120)]
    rows += [(2000 + i, rows[3][1], rows[3][2]) for i in range(30)]
    return rows


def test_links_equal_brute_force(spark):
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [1.0, None] * 8, 1), (5003, [float("nan")] * 16, 1), (5004, [float("inf")] * 16, 1),
           (5005, [1.0] * 16, None), (None, [1.0] * 16, 1), (5006, [], 1), (5007, [1.0, 2.0], 1), (5008, [2.0, 4.0], 1), (5, table()[5][1], table()[5][2])]
    rows = table() + odd
    frame = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(3)
    got = sorted((tuple(r) for r in N.near_duplicates(frame).collect()), key=str)
    want = brute(rows)
    assert len(got) == len(want)
    # Found links are a part of the true ones, and nearly all of them.
    found = sum(r[1] for r in got)
    assert found >= 0.97 * sum(r[1] for r in want)
    true = sorted((r[0], r[1]) for r in want if r[0] is not None)
    assert all(a[1] <= b[1] for a, b in zip(sorted((r[0], r[1]) for r in got if r[0] is not None), true, strict=True))
    same = sum(a == b for a, b in zip(got, want, strict=True))
    assert same >= 0.95 * len(want)


def test_no_usable_vector(spark):
    rows = [(1, None, 1), (2, [0.0], 2), (None, None, None)]
    got = N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)]
    assert N.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def pairs_and_group():
    rng = np.random.default_rng(4)
    rows = [(i, np.ones(64) + rng.normal(0, 0.02, 64), 1) for i in range(150)]
    for i in range(300):
        v = rng.normal(0, 1, 64)
        rows += [(1000 + 2 * i + k, v + rng.normal(0, 0.2, 64), 1) for k in range(2)]
    return [(i, [float(x) for x in np.float32(v)], label) for i, v, label in rows]


def test_links_that_no_forest_finds_are_found(spark):
    rows = pairs_and_group()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = N.near_duplicates(frame, neighbours=1, trees=0, rounds=0).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_audit_sees_lost_pairs_beside_a_large_group(spark):
    items = spark.createDataFrame([(i, 1, 1, v) for i, v, _ in pairs_and_group()], "item long, grp long, copies long, vec array<float>")
    descent = N.Descent(items, 64, N.Workspace(spark, "test"), 10, 8)
    groups, counts = descent.exact(0.93)
    assert descent.recall(groups, counts, 0.93) == 1.0
    assert descent.recall(groups.where("node < 1000"), counts.where("item < 1000"), 0.93) < 0.2  # pairs lost, the group whole
    assert counts.where("item < 1000").agg({"n": "sum"}).first()[0] > 0.95 * counts.agg({"n": "sum"}).first()[0]
