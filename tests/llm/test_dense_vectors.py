"""Links that no list of the nearest holds: between groups whose members all have nearer ones at home."""

import numpy as np
import pytest

from vectide.llm import nndescent


def _rows(rng, dim=16):
    """Two groups of 40 with centres at cosine 0.95, alone under label 1; label 2 has a third one far off."""
    first = np.eye(dim)[0]
    second = 0.95 * first + np.sqrt(1 - 0.95 ** 2) * np.eye(dim)[1]
    groups = [(first, 1), (second, 1), (first, 2), (second, 2), (np.eye(dim)[5], 2)]
    return [(i * 40 + j, (c + 0.002 * rng.normal(size=dim)).tolist(), label) for i, (c, label) in enumerate(groups) for j in range(40)]


def _brute(rows):
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[2] == b[2]
             and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    for a, _ in pairs:
        links[a] += 1
    for _ in range(4):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {i: (links[i], root[i]) for i in links}


@pytest.mark.parametrize("block", [512, 16])
def test_groups_with_full_lists_are_joined(spark, block):
    rows = _rows(np.random.default_rng(3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(df, block=block).collect()}
    want = _brute(rows)
    assert want[0] == (79, 0) and want[40] == (79, 0)
    assert got == want


def test_audit_sees_the_loss_of_small_groups(spark):
    """One group of 100 is found whole, of 30 pairs none: summed links would give 0.99."""
    rng, rows = np.random.default_rng(5), []
    for size in (100, *[2] * 30):
        centre = rng.normal(size=32)
        rows += [(len(rows) + i, 1, (centre + 0.01 * rng.normal(size=32)).tolist(), 1) for i in range(size)]
    nodes = spark.createDataFrame([(i, str(label), v, n) for i, label, v, n in rows], "node long, label string, vec array<double>, n long")
    links = spark.createDataFrame([(i, 99) for i in range(100)], "node long, links long")
    told = nndescent.audit(nodes, links, 0.93)
    assert told.share == 0 and told.sound and told.looked == told.linked == 160


def _nodes(spark, rows):
    return spark.createDataFrame([(i, str(label), v, 1) for i, v, label in rows], "node long, label string, vec array<double>, n long")


def _rare(n, pairs, dim, seed=7):
    """Vectors of which only `pairs` pairs are close."""
    x = np.random.default_rng(seed).normal(size=(n, dim))
    for p in range(pairs):
        x[n - 1 - p] = x[p * 7] + 0.02 * x[n - 1 - p]
    return x


def test_audit_does_not_pass_without_evidence(spark):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(_rare(4000, 3, 32))]
    nodes, none = _nodes(spark, rows), spark.createDataFrame([], "node long, links long")
    told = nndescent.audit(nodes, none, 0.93)
    assert (told.share, told.looked, told.linked, told.sound) == (0.0, 4000, 6, True)
    told = nndescent.audit(nodes, none, 0.93, steps=(256, 1000))
    assert told.looked == 1000 and told.linked < nndescent.ENOUGH and not told.sound
    assert nndescent.audit(nodes.limit(0), none, 0.93).sound


def test_rare_links_among_many_vectors_are_found(spark):
    x = _rare(50_000, 40, 32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>, label int")
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {}
    for at in range(0, len(unit), 2000):
        a, b = np.nonzero(unit[at:at + 2000] @ unit.T >= 0.93)
        for i, j in zip(a + at, b):
            if i != j:
                want[int(i)] = want.get(int(i), 0) + 1
    got = {r["vec_id"]: r["n_links"] for r in nndescent.near_duplicates(df.repartition(16)).filter("n_links > 0").collect()}
    assert len(want) >= 80 and sum(got.get(i, 0) == n for i, n in want.items()) >= 0.9 * len(want) and set(got) <= set(want)


def test_links_that_the_descent_misses_are_found_by_all_pairs(spark, monkeypatch):
    first = nndescent._first_lists
    monkeypatch.setattr(nndescent, "_first_lists", lambda *a: first(*a).filter("sim < 0.93"))
    monkeypatch.setattr(nndescent, "_descend", lambda nodes, lists, k: lists.withColumn("new", nndescent.F.lit(0)))
    rng, rows = np.random.default_rng(6), []
    for size in (12, 3, 2, 2, 1, 1):
        centre = rng.normal(size=16)
        rows += [(len(rows) + i, (centre + 0.01 * rng.normal(size=16)).tolist(), 1) for i in range(size)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(df, block=8).collect()}
    assert got == _brute(rows)
