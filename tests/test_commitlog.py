"""The store on disk: versions that share files, deltas, repeated batches, cleaning up, and the index kept with it."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import similarity
from vectide.operators.cellindex import CellIndex
from vectide.operators.neighbours import NeighbourLists
from vectide.operators.store import latest_per_id, settle
from vectide.sources.commitlog import Conflict, StoreLog

SCHEMA = "embedding_id long, value string, created_at long, shard int, write_id long"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def base_rows(spark):
    return rows(spark, [(i, f"v{i}", 100, i % 4, -1) for i in range(40)])


def files(log, part=None, version=None):
    found = log.read(version).select("shard", F.input_file_name().alias("f")).distinct().collect()
    return {r["f"] for r in found if part is None or r["shard"] == part}


def plain(df):
    return sorted((r["embedding_id"], r["value"], r["created_at"], r["shard"]) for r in df.collect())


@pytest.fixture
def log(spark, tmp_path):
    log = StoreLog(spark, str(tmp_path / "store"), tie="write_id")
    log.write(base_rows(spark))
    return log


def test_only_touched_parts_are_written(spark, log):
    before = {p: files(log, p) for p in range(4)}
    log.upsert(rows(spark, [(5, "new", 200, 1, 1), (9, "old", 50, 1, 2), (101, "more", 1, 1, 3)]))
    after = {p: files(log, p) for p in range(4)}
    assert all(before[p] == after[p] for p in (0, 2, 3)) and not before[1] & after[1]
    got = {r[0]: r for r in plain(log.read())}
    assert got[5] == (5, "new", 200, 1) and got[9] == (9, "v9", 100, 1) and got[101][1] == "more" and len(got) == 41
    assert plain(log.read(1)) == plain(base_rows(spark))  # the version before is still there


def test_a_key_that_moves_leaves_its_old_part(spark, log):
    log.upsert(rows(spark, [(4, "moved", 200, 9, 1), (6, "late", 10, 9, 2)]))
    got = {r[0]: r for r in plain(log.read())}
    assert got[4] == (4, "moved", 200, 9) and got[6] == (6, "v6", 100, 2) and len(got) == 40
    assert set(log.state().parts) == {"0", "1", "2", "3", "9"}


def test_random_writes_equal_a_settled_table(spark, tmp_path):
    rnd, log = random.Random(2), StoreLog(spark, str(tmp_path / "s"), tie="write_id")
    log.write(base_rows(spark))
    want = base_rows(spark)
    for batch in range(5):
        data = [(rnd.randint(0, 60), f"b{batch}", rnd.choice([50, 100, 150]), rnd.choice([0, 1, 5, None]), batch * 100 + i)
                for i in range(12)]
        writes = rows(spark, data)
        (log.append if batch % 2 else log.upsert)(writes, "w", batch)
        clean = writes.withColumn("shard", F.coalesce("shard", F.lit(-1)))
        want = settle(want, latest_per_id(clean, tie="write_id"), "embedding_id", "write_id")
        assert plain(log.read()) == plain(want)
        # by parts, deltas included
        assert plain(log.read().filter("shard = 1")) == plain(want.filter("shard = 1"))
    log.append(rows(spark, [(1, "x", 999, 0, 900), (70, "y", 1, 8, 901)]), "w", 5)
    waiting = plain(log.read())
    log.fold()
    assert plain(log.read()) == waiting and not log.state().deltas and log.fold() == log.state().version


def test_a_repeated_batch_changes_nothing(spark, log):
    writes = rows(spark, [(5, "new", 200, 1, 1)])
    for write in (log.append, log.upsert):
        version = write(writes, "w", 3 if write == log.append else 4)
        seen = files(log)
        assert write(rows(spark, [(5, "other", 300, 1, 2)]), "w", 3) == version == log.state().version
        assert files(log) == seen
    assert plain(log.read())[5][1] == "new"


def test_two_writers_cannot_commit_one_version(spark, log):
    state = log.state()
    log.upsert(rows(spark, [(1, "a", 200, 1, 1)]))
    with pytest.raises(Conflict):
        log._commit(state, state.parts, base_rows(spark).schema, {}, None, None)
    assert not [n for n in os.listdir(f"{log.base}/log") if n.endswith(".tmp")]
    assert log.versions() == [1, 2]


def test_vacuum_keeps_what_a_version_names(spark, log):
    log.upsert(rows(spark, [(1, "a", 200, 1, 1)]))
    log.upsert(rows(spark, [(2, "b", 200, 2, 1)]))
    os.makedirs(f"{log.base}/data/commit=lost/shard=1")
    assert log.vacuum(3_600_000) == [] and log.versions() == [1, 2, 3]
    whole = plain(log.read())
    removed = log.vacuum(-1000)
    # the first commit still holds parts 0 and 3
    assert log.versions() == [3] and "data/commit=lost" in removed and plain(log.read()) == whole


def test_empty_store_and_empty_writes(spark, tmp_path):
    log = StoreLog(spark, str(tmp_path / "e"))
    with pytest.raises(ValueError):
        log.read()
    empty = base_rows(spark).limit(0)
    log.write(empty)
    assert log.read().count() == 0
    log.upsert(empty)
    log.append(empty)
    assert log.read().count() == 0
    log.append(rows(spark, [(1, "a", 2, 0, 1)]))
    assert plain(log.read()) == [(1, "a", 2, 0)]
    log.fold()
    assert plain(log.read()) == [(1, "a", 2, 0)]


DIM = 8


def vectors(spark, n=600, seed=1):
    """Entries around 30 centres, with zero, short and missing vectors among them."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, DIM))
    data = [(i, (centres[i % 30] + 0.15 * rng.standard_normal(DIM)).tolist(), 1) for i in range(n)]
    data += [(n, [0.0] * DIM, 1), (n + 1, [1.0], 1), (n + 2, None, 1), (n + 3, [float("nan")] * DIM, 1)]
    return spark.createDataFrame(data, "embedding_id long, embedding array<float>, created_at long")


def asked(store, n=40):
    return store.filter(F.col("embedding_id") < n).select(F.col("embedding_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def answers(df):
    return sorted((r["query_id"], r["rank"], r["embedding_id"], r["similarity"]) for r in df.collect())


@pytest.mark.parametrize("max_queries", [0, 100])
def test_index_gives_the_exact_answer_before_and_after_writes(spark, tmp_path, max_queries):
    store, index = vectors(spark), CellIndex(spark, str(tmp_path / "i"), DIM)
    index.build(store)
    queries = asked(store)
    want = similarity.similar_topk(store, queries, 5, 0.5, dim=DIM)
    assert answers(index.search(queries, 5, 0.5, max_queries=max_queries)) == answers(want)
    rng = np.random.default_rng(9)
    writes = spark.createDataFrame(
        [(i, rng.standard_normal(DIM).tolist(), 2) for i in [3, 4, 5, 900, 901]] + [(6, [1.0], 2), (7, [0.0] * DIM, 0)],
        "embedding_id long, embedding array<float>, created_at long")
    index.upsert(writes, "w", 0)
    index.upsert(writes, "w", 0)
    merged = settle(store, latest_per_id(writes.filter(F.size("embedding") == DIM)), "embedding_id", None)
    want = similarity.similar_topk(merged, queries, 5, 0.5, dim=DIM)
    assert answers(index.search(queries, 5, 0.5, max_queries=max_queries)) == answers(want)
    sizes = {r["cell"]: r["n"] for r in index.rows().groupBy("cell").agg(F.count("*").alias("n")).collect()}
    assert {c: n for c, n in enumerate(index._sizes()[0].tolist()) if n} == sizes


def test_a_search_reads_only_the_cells_it_visits(spark, tmp_path):
    store, index = vectors(spark), CellIndex(spark, str(tmp_path / "i"), DIM)
    index.build(store)
    queries = asked(store, 2)
    plan = lambda df: df._jdf.queryExecution().toString()
    found = index.probe(queries, 2, 5, 0.5)
    assert "PartitionFilters: [cell#" in plan(found)
    every = len({r[0] for r in index.rows().select(F.input_file_name()).collect()})
    read = []
    for probes in (1, 3, 8):
        text = plan(index.probe(queries, probes, 5, 0.5))
        cells = re.search(r"PartitionFilters: \[cell#\d+ (.*?)\]", text)[1]
        numbers = [int(x) for x in re.findall(r"\d+", re.sub(r"#\d+", "", cells))]
        read.append(len({r[0] for r in index.rows(numbers).select(F.input_file_name()).collect()}))
    assert read == sorted(read) and read[0] < read[-1] < every
    # nearly all of the exact answer lies in few cells
    want = {x[:3] for x in answers(similarity.similar_topk(store, asked(store), 5, 0.9, dim=DIM))}
    got = {x[:3] for x in answers(index.probe(asked(store), 4, 5, 0.9))}
    assert len(want & got) >= 0.9 * len(want)


def test_index_of_signatures(spark, tmp_path):
    store, index = vectors(spark), CellIndex(spark, str(tmp_path / "p"), DIM, planes=True)
    index.build(store, bits=5)
    queries = asked(store)
    want = similarity.approx_similar_join(store, queries, 0.5, 5, bits=5, flips=1, dim=DIM)
    for most in (0, 100):
        assert answers(index.probe(queries, 2, 5, 0.5, max_queries=most)) == answers(want)


def test_empty_index(spark, tmp_path):
    store, index = vectors(spark), CellIndex(spark, str(tmp_path / "i"), DIM)
    index.build(store.limit(0))
    assert index.search(asked(store), 5, 0.5).count() == 0 and index.probe(asked(store), 2, 5, 0.5).count() == 0
    index.upsert(store.limit(5))
    assert index.rows().count() == 5


def test_neighbour_lists_follow_the_writes(spark, tmp_path):
    store, index = vectors(spark), CellIndex(spark, str(tmp_path / "i"), DIM)
    index.build(store)
    lists = NeighbourLists(spark, str(tmp_path / "n"), index, 4, 0.6)
    lists.build()
    every, rng, now = lists.searched, np.random.default_rng(4), store
    for batch in range(3):
        data = [(int(i), (rng.standard_normal(DIM) * [1, 0.1][batch % 2]).tolist(), batch + 2) for i in rng.choice(700, 6, replace=False)]
        data += [(int(900 + batch), [1.0] * DIM, 1), (int(910 + batch), [1.0], 9)]
        writes = spark.createDataFrame(data, "embedding_id long, embedding array<float>, created_at long")
        lists.update(writes, "w", batch)
        lists.update(writes, "w", batch)
        good = latest_per_id(writes.filter(F.size("embedding") == DIM))
        now = settle(now, good, "embedding_id", None)
        want = similarity.precompute_neighbors(now.filter(F.size("embedding") == DIM), 4, 0.6, with_empty=True, dim=DIM)
        got = {r["embedding_id"]: [n["embedding_id"] for n in r["neighbors"]] for r in lists.read().collect()}
        assert got == {r["embedding_id"]: r["precomputed_neighbors"] for r in want.collect()}
        # entries that were written, and those that named one: about four for each
        assert lists.searched < every / 4
    assert lists.log.state().applied == {"w": 2}


def test_many_writes_are_scored_under_the_bound_of_each_list(spark, tmp_path, monkeypatch):
    """Copies of a few vectors, written in numbers: no step asks for all pairs at the threshold."""
    store, index = vectors(spark, 300), CellIndex(spark, str(tmp_path / "i"), DIM)
    index.build(store)
    lists = NeighbourLists(spark, str(tmp_path / "n"), index, 4, 0.6)
    lists.build()
    some = [r["embedding"] for r in store.orderBy("embedding_id").limit(3).collect()]
    writes = spark.createDataFrame([(1000 + i, some[i % 3], 2) for i in range(60)], "embedding_id long, embedding array<float>, created_at long")
    monkeypatch.setattr(similarity, "MAX_QUERIES", 20)
    monkeypatch.setattr(index, "matches", None)
    lists.update(writes, "w", 0)
    now = settle(store, writes, "embedding_id", None).filter(F.size("embedding") == DIM)
    want = similarity.precompute_neighbors(now, 4, 0.6, with_empty=True, dim=DIM)
    got = {r["embedding_id"]: [n["embedding_id"] for n in r["neighbors"]] for r in lists.read().collect()}
    assert got == {r["embedding_id"]: r["precomputed_neighbors"] for r in want.collect()}
