"""Cosine search: exact top-k, k-nearest, neighbour lists, approximate and cell-pruned search.

Two physical forms give the same exact answer:

* Small query side (measured, bounded in rows and bytes): its unit matrix is broadcast and each
  Arrow batch of the store is scored by one matrix product. Vectors are never shuffled; only matches
  that can still be in a query's top k leave the batch.
* Any query side: the store is cut into cells around pivots, about the square root of its size. The
  triangle inequality on angles says which cells can hold a match for a query, so a query meets only
  those. With a limit, a query first meets the cells around it; the k-th best score found there is its
  bound for all others. Small cells are packed into blocks, large ones cut, and so are the queries that visit a
  block; a query is sent once to a block, with the cells it visits there. One task scores one pair of blocks.

Vectors have one length, `dim`. Without it the commonest length of the queries is taken. Entries and
queries of another length take no part; `set_aside` gives those queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from vectide.functions.vectors import dense, unit_rows, usable
from vectide.operators.groups import top_per_group
from vectide.operators.store import validate_requests
from vectide.session import cut_lineage

# Default thresholds and limits of the search operators.
ENGINE_THRESHOLD, ENGINE_LIMIT = 0.7, 10
ROUTER_THRESHOLD, ROUTER_CANDIDATES = 0.85, 50
NEIGHBOUR_THRESHOLD, NEIGHBOUR_LIMIT = 0.8, 10

# bounds of a broadcast query side, in rows and in bytes of its double matrix
MAX_QUERIES = 20_000
BROADCAST_BYTES = 128 << 20
# cells are about the square root of the store's rows, up to this; beyond it they are cut into more blocks
MAX_PIVOTS = 1024
# a query first meets the nearest cells that hold this many times its limit
FIRST_SHARE = 4
# added to a bound before cells are left out: above the rounding of scores and of arccos
BOUND_SLACK = 1e-8
# rows of a block; a smaller store has about MIN_BLOCKS of them, so that its copies grow as it does
BLOCK_ROWS = 32_768
MIN_BLOCKS, MIN_BLOCK_ROWS = 8, 1024
# matches that a pair of blocks may leave: with a limit its queries times the limit, without one all its pairs
HELD_MATCHES = 1 << 24
# maps a matrix of unit rows to one cell number, or one row of cell numbers, per row
CellOf = Callable[[np.ndarray], np.ndarray]
QUERY_STRIP = 256
PAIR_STRIP = 65_536
# scores are ranked as rounded to this many digits, so equal vectors tie in whichever block they are scored
RANK_DIGITS = 9


def _unit(ids: pa.Array, vectors: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Ids and unit rows of the vectors that have a direction: not zero, no NaN."""
    matrix = unit_rows(dense(vectors))
    good = ~np.isnan(matrix).any(axis=1)
    return (ids, matrix) if good.all() else (ids.filter(pa.array(good)), matrix[good])


def _asked(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, unit rows and thresholds of the queries that have a direction."""
    rows, unit = _unit(pa.array(np.arange(table.num_rows)), table.column("query_vec"))
    kept = table.take(rows)
    return kept.column("query_id").combine_chunks(), unit, kept.column("bar").to_numpy().astype(np.float64)


def _places(ids: pa.Array) -> np.ndarray:
    """The place of each id in their order, null first as in Spark."""
    return np.argsort(pc.sort_indices(ids, null_placement="at_start").to_numpy())


def _leading(q: np.ndarray, v: np.ndarray, scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the matches that can be among the k best of their query, by query.

    `order` gives the place of each vector's id. Of equal scores the k lowest ids stay, so copies of a vector don't
    add up; scores that may be equal once rounded stay all.
    """
    at = np.lexsort((order[v], -scores, q))
    q, scores = q[at], scores[at]
    place = np.arange(len(at))
    opens = np.concatenate([[True], q[1:] != q[:-1]]) if len(at) else np.zeros(0, bool)
    starts = np.maximum.accumulate(np.where(opens, place, 0))
    tie = opens | np.concatenate([[True], scores[1:] != scores[:-1]]) if len(at) else opens
    tied = place - np.maximum.accumulate(np.where(tie, place, 0))
    kth = starts + k - 1
    reached = (kth < len(at)) & (q[np.minimum(kth, len(at) - 1)] == q) if len(at) else opens
    edge = np.where(reached, scores[np.minimum(kth, len(at) - 1)] if len(at) else 0.0, -np.inf)
    return at[(tied < k) & (scores >= edge - 2 * 10.0 ** -RANK_DIGITS)]


def _first_copies(vectors: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Positions of the rows without those that have `n` equal ones of lower ids."""
    whole = np.ascontiguousarray(vectors)
    same = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_inverse=True)[1]
    at = np.lexsort((order, same))
    opens = np.concatenate([[True], same[at][1:] != same[at][:-1]])
    place = np.arange(len(at))
    return np.sort(at[place - np.maximum.accumulate(np.where(opens, place, 0)) < n])


def _best(query_ids: pa.Array, ids: pa.Array, queries: np.ndarray, vectors: np.ndarray, thresholds: np.ndarray,
          k: int | None, skip_self: bool, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions (query, vector) and cosine of matches between unit rows, a strip of queries at a time;
    each query has its threshold.

    A float32 product picks the candidates, with a margin above its rounding error; their cosine is then
    computed in double. With k, `floor` holds per query a score that k vectors seen so far reach, less
    the margin: below it a vector cannot be among the k best. The caller keeps it from batch to batch.
    """
    margin = 2 * vectors.shape[1] * float(np.finfo(np.float32).eps) + 2 * 10.0 ** -RANK_DIGITS
    order, stay = None, None
    if k is not None:
        # equal vectors tie by id: of those, an entry itself aside, no more than k can be among the best
        order = _places(ids)
        stay = _first_copies(vectors, order, k + 1)
        ids, vectors, order = ids.take(pa.array(stay)), vectors[stay], order[stay]
    light = vectors.astype(np.float32).T
    n = len(vectors)
    for low in range(0, len(queries), QUERY_STRIP):
        strip, bar = queries[low:low + QUERY_STRIP], floor[low:low + QUERY_STRIP]
        least = thresholds[low:low + QUERY_STRIP]
        scores = strip.astype(np.float32) @ light
        if skip_self:
            own = pc.index_in(query_ids.slice(low, len(strip)), value_set=ids)
            rows = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
            scores[rows, own.drop_null().to_numpy()] = -np.inf
        keep = scores >= np.maximum(bar, least - margin)[:, None]
        if k is not None:
            crowded = np.flatnonzero(keep.sum(axis=1) > k)
            if len(crowded):
                edge = np.partition(scores[crowded], n - k, axis=1)[:, n - k] - margin
                bar[crowded] = np.maximum(bar[crowded], edge)
                keep[crowded] &= scores[crowded] >= edge[:, None]
        q_all, v_all = np.nonzero(keep)
        held = []
        for start in range(0, len(q_all), PAIR_STRIP):
            q, v = q_all[start:start + PAIR_STRIP], v_all[start:start + PAIR_STRIP]
            exact = np.einsum("ij,ij->i", strip[q], vectors[v])
            good = exact >= least[q]
            found = q[good], v[good], exact[good]
            if k is None:
                yield found[0] + low, found[1], found[2]
                continue
            # what is held is cut again with each part, so it stays as small as the answer
            held = [np.concatenate(pair) for pair in zip(held, found)] if held else list(found)
            lead = _leading(*held, order, k)
            held = [column[lead] for column in held]
        if held and len(held[0]):
            yield held[0] + low, stay[held[1]], held[2]


def _no_floor(queries: np.ndarray) -> np.ndarray:
    return np.full(len(queries), -np.inf)


def _matches(query_ids: pa.Array, ids: pa.Array, found) -> Iterator[pa.RecordBatch]:
    for q, v, scores in found:
        yield pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(q)), ids.take(pa.array(v)), pa.array(scores)],
            ["query_id", "embedding_id", "similarity"])


def _pairs_schema(queries: DataFrame, store: DataFrame) -> str:
    query_type = dict(queries.dtypes)["query_id"]
    id_type = dict(store.dtypes)["embedding_id"]
    return f"query_id {query_type}, embedding_id {id_type}, similarity double"


def _common_length(queries: DataFrame) -> int:
    """The commonest length of the query vectors, the shorter one on a tie; 0 without queries."""
    lengths = queries.filter(usable("query_vec")).groupBy(F.size("query_vec").alias("n")).count()
    first = lengths.orderBy(F.col("count").desc(), "n").first()
    return first["n"] if first else 0


def set_aside(queries: DataFrame, dim: int) -> DataFrame:
    """The queries that a search with `dim` leaves out: no vector, another length or a null number."""
    return queries.filter(~F.coalesce(usable("query_vec", dim), F.lit(False)))


def _prepare(store: DataFrame, queries: DataFrame, threshold: float | None, dim: int | None, skip_self: bool,
             extra: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """(usable store rows, usable queries with their threshold as `bar`, vector length)."""
    if skip_self and dict(queries.dtypes)["query_id"] != dict(store.dtypes)["embedding_id"]:
        raise ValueError("query_id and embedding_id must have one type where an entry is not to match itself")
    dim = _common_length(queries) if dim is None else dim
    bar = F.col("threshold") if threshold is None else F.lit(threshold)
    return (store.filter(usable("embedding", dim)).select("embedding_id", "embedding", *extra),
            queries.filter(usable("query_vec", dim)).select("query_id", "query_vec", bar.cast("double").alias("bar"), *extra),
            dim)


def _query_head(queries: DataFrame, dim: int, max_queries: int) -> tuple[pa.Table, bool]:
    """(queries up to the bound, whether these are all); one row more than the bound is asked for."""
    most = min(max_queries, BROADCAST_BYTES // (8 * max(dim, 1)))
    head = queries.limit(most + 1).toArrow()
    return head, head.num_rows <= most


def visitors_of(visits: np.ndarray) -> dict[int, np.ndarray]:
    """The queries (by position) that visit each cell; `visits` has a row of cell numbers for each query."""
    if not visits.size:
        return {}
    asking = np.repeat(np.arange(len(visits)), visits.shape[1])[np.argsort(visits, axis=None, kind="stable")]
    numbers, starts = np.unique(np.sort(visits, axis=None), return_index=True)
    return dict(zip(numbers.tolist(), np.split(asking, starts[1:])))


def _score_broadcast(store: DataFrame, query_table: pa.Table, schema: str, k: int | None, skip_self: bool,
                     cell_of: CellOf | None = None, cells_of: CellOf | None = None) -> DataFrame:
    """Scores each Arrow batch of the store against all queries or, with cell functions, each cell's rows
    in the batch against the queries that visit the cell."""
    asked = _asked(query_table)
    visitors = visitors_of(cells_of(asked[1])) if cells_of is not None and len(asked[1]) else {}
    return score_visitors(store, asked, visitors, schema, k, skip_self, cell_of)


def score_visitors(store: DataFrame, asked: tuple[pa.Array, np.ndarray, np.ndarray], visitors: dict[int, np.ndarray],
                   schema: str, k: int | None, skip_self: bool, cell_of: CellOf | None = None) -> DataFrame:
    """As `_score_broadcast`, with the visitors of each cell. Rows bring their `cell` if `cell_of` is not given
    and there are visitors; without either all queries meet all rows."""
    shared = store.sparkSession.sparkContext.broadcast((*asked, visitors))
    stored = cell_of is None and "cell" in store.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, bars, visitors = shared.value
        floor = _no_floor(queries)
        for batch in batches:
            rows, vectors = _unit(pa.array(np.arange(batch.num_rows)), batch.column(1))
            ids = batch.column(0).take(rows)
            if not len(ids) or not len(query_ids):
                continue
            if cell_of is None and not stored:
                found = _best(query_ids, ids, queries, vectors, bars, k, skip_self, floor)
                yield from _matches(query_ids, ids, found)
                continue
            cells = batch.column(2).take(rows).to_numpy() if stored else cell_of(vectors)
            for cell in np.unique(cells).tolist():
                asked, rows = visitors.get(cell), np.flatnonzero(cells == cell)
                if asked is None:
                    continue
                some_queries, some_ids, bar = query_ids.take(pa.array(asked)), ids.take(pa.array(rows)), floor[asked]
                found = _best(some_queries, some_ids, queries[asked], vectors[rows], bars[asked], k, skip_self, bar)
                yield from _matches(some_queries, some_ids, found)
                floor[asked] = bar

    return store.select("embedding_id", "embedding", *(["cell"] if stored else [])).mapInArrow(score, schema)


def pick_pivots(store: DataFrame, n: int) -> np.ndarray:
    """Unit matrix of n stored vectors, picked by the hash of their id."""
    rows = store.orderBy(F.xxhash64("embedding_id"), "embedding_id").limit(n).select("embedding").toArrow()
    unit = unit_rows(dense(rows.column("embedding")))
    return unit[~np.isnan(unit).any(axis=1)]


def nearest_cell(vector: Column | str, pivots: np.ndarray) -> Column:
    """struct(cell, angle): the pivot with the highest cosine (lowest number on a tie) and the angle to it."""

    @F.arrow_udf("struct<cell:int,angle:double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        with np.errstate(invalid="ignore"):
            scores = unit_rows(dense(vectors)) @ pivots.T
        if not len(scores):
            return pa.array([], pa.struct([("cell", pa.int32()), ("angle", pa.float64())]))
        # a vector without a direction goes to the first cell and does not count for its radius
        undirected = np.isnan(scores).any(axis=1)
        scores[undirected] = -1.0
        cell = scores.argmax(axis=1).astype(np.int32)
        angle = np.arccos(np.clip(scores[np.arange(len(cell)), cell], -1.0, 1.0))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle, mask=undirected)], ["cell", "angle"])

    return nearest(vector)


def _angles(vectors: pa.Array, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.arccos(np.clip(unit_rows(dense(vectors)) @ pivots.T, -1.0, 1.0))


def _around(angles: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """Marks per query its nearest cells, as many as are needed to hold `rows` entries."""
    order = np.argsort(angles, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    marks = np.zeros(angles.shape, bool)
    np.put_along_axis(marks, order, before < rows, axis=1)
    return marks & (sizes > 0)


def _lists(marks: np.ndarray) -> pa.Array:
    """The marked columns of each row as a list."""
    offsets = np.concatenate([[0], np.cumsum(marks.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(marks)[1].astype(np.int32)))


def cells_around(vector: Column | str, pivots: np.ndarray, sizes: np.ndarray, rows: int) -> Column:
    """The cells nearest to a vector that together hold `rows` entries."""

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int32()))
        return _lists(_around(_angles(vectors, pivots), sizes, rows))

    return cells(vector)


def cells_in_reach(vector: Column | str, bar: Column | str, pivots: np.ndarray, radii: np.ndarray,
                   sizes: np.ndarray, seen_rows: int = 0) -> Column:
    """Cells that can hold a vector with cosine >= bar: angle to the pivot <= radius + arccos(bar).

    With `seen_rows` the cells that `cells_around` gives for it are left out.
    """

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array, bars: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int32()))
        angles = _angles(vectors, pivots)
        least = np.arccos(np.clip(bars.to_numpy(zero_copy_only=False) - BOUND_SLACK, -1.0, 1.0))
        with np.errstate(invalid="ignore"):
            near = angles <= radii[None, :] + least[:, None] + 1e-7
        if seen_rows:
            near &= ~_around(angles, sizes, seen_rows)
        return _lists(near & (sizes > 0))

    return cells(vector, bar)


def _cell_column(cell_of: CellOf, vector: str) -> Column:
    """Cell per vector; `cell_of` maps a unit matrix to cell numbers."""

    @F.arrow_udf("int")
    def cell(vectors: pa.Array) -> pa.Array:
        return pa.array(cell_of(unit_rows(dense(vectors))).astype(np.int32))

    return cell(vector)


def _cells_column(cells_of: CellOf, vector: str) -> Column:
    """Cells to visit per query vector; `cells_of` maps a unit matrix to rows of cell numbers."""

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        return pa.array(list(cells_of(unit_rows(dense(vectors))).astype(np.int32)), pa.list_(pa.int32()))

    return cells(vector)


def _met(stored: pa.Table, asked: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, queries) by position that meet in a block; a query without a list of cells meets all rows."""
    cells, visits = stored.column("cell").to_numpy(), asked.column("cells").combine_chunks()
    everywhere = np.flatnonzero(visits.is_null().to_numpy(zero_copy_only=False))
    if len(everywhere):
        yield np.arange(len(cells)), everywhere
    asking = np.repeat(np.arange(len(visits)), pc.list_value_length(visits).fill_null(0).to_numpy(zero_copy_only=False))
    if not len(asking):
        return
    visited = visits.flatten().to_numpy(zero_copy_only=False)
    by_visit, by_cell = np.argsort(visited, kind="stable"), np.argsort(cells, kind="stable")
    numbers, starts = np.unique(visited[by_visit], return_index=True)
    lows, highs = (np.searchsorted(cells[by_cell], numbers, side) for side in ("left", "right"))
    for low, high, queries in zip(lows, highs, np.split(asking[by_visit], starts[1:])):
        if high > low:
            yield by_cell[low:high], queries


def _match_blocks(k: int | None, skip_self: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores one block of the store against one block of queries, by the cells that the queries visit."""

    def score(stored: pa.Table, asked: pa.Table) -> pa.Table:
        good, vectors = _unit(pa.array(np.arange(stored.num_rows)), stored.column("embedding"))
        stored = stored.take(good)
        good, unit = _unit(pa.array(np.arange(asked.num_rows)), asked.column("query_vec"))
        asked = asked.take(good)
        ids, query_ids = stored.column("embedding_id").combine_chunks(), asked.column("query_id").combine_chunks()
        bars = asked.column("bar").to_numpy().astype(np.float64)
        out = pa.schema([("query_id", query_ids.type), ("embedding_id", ids.type), ("similarity", pa.float64())])
        if not len(ids) or not len(query_ids):
            return out.empty_table()
        floor, found, order = _no_floor(unit), [], _places(ids)
        for rows, queries in _met(stored, asked):
            bar = floor[queries]
            pairs = _best(query_ids.take(pa.array(queries)), ids.take(pa.array(rows)), unit[queries], vectors[rows],
                          bars[queries], k, skip_self, bar)
            found += [(queries[q], rows[v], scores) for q, v, scores in pairs]
            floor[queries] = bar
            if k is not None and sum(len(q) for q, _, _ in found) > 4 * k * len(unit):
                columns = [np.concatenate(column) for column in zip(*found)]
                lead = _leading(*columns, order, k)
                found = [tuple(column[lead] for column in columns)]
        if not found:
            return out.empty_table()
        q, v, scores = (np.concatenate(column) for column in zip(*found))
        if k is not None:
            lead = _leading(q, v, scores, order, k)
            q, v, scores = q[lead], v[lead], scores[lead]
        return pa.Table.from_batches(_matches(query_ids, ids, [(q, v, scores)]), out)

    return score


def _packed(sizes: dict[int, int], block_rows: int) -> tuple[np.ndarray, list[int]]:
    """(block of each cell, parts of each block): small cells share a block, a large one is a block in parts."""
    block_of, parts, filled = np.full(max(sizes, default=-1) + 1, -1, np.int32), [], 0
    for cell, rows in sorted(sizes.items()):
        if not rows:
            continue
        if not parts or filled + rows > block_rows:
            parts.append(0)
            filled = 0
        filled += rows
        block_of[cell] = len(parts) - 1
        parts[-1] = math.ceil(filled / block_rows)
    return block_of, parts


def _by_block(block_of: np.ndarray, cells: Column | str) -> Column:
    """The cells as an array of struct(block, cells), without a list where they are all cells of the block."""
    whole = np.bincount(block_of[block_of >= 0], minlength=1)

    @F.arrow_udf("array<struct<block:int,cells:array<int>>>")
    def split(lists: pa.Array) -> pa.Array:
        rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        numbers = lists.flatten().to_numpy(zero_copy_only=False)
        known = numbers < len(block_of)
        rows, numbers = rows[known], numbers[known]
        blocks = block_of[numbers]
        rows, numbers, blocks = rows[blocks >= 0], numbers[blocks >= 0], blocks[blocks >= 0]
        at = np.lexsort((numbers, blocks, rows))
        rows, numbers, blocks = rows[at], numbers[at], blocks[at]
        opens = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (blocks[1:] != blocks[:-1])])) if len(at) else at
        rows, blocks = rows[opens], blocks[opens]
        lengths = np.diff(np.concatenate([opens, [len(numbers)]]))
        every = lengths == whole[blocks]
        listed = numbers[~np.repeat(every, lengths)]
        offsets = np.concatenate([[0], np.cumsum(np.where(every, 0, lengths))]).astype(np.int32)
        inner = pa.ListArray.from_arrays(pa.array(offsets), pa.array(listed.astype(np.int32)), mask=pa.array(every))
        pairs = pa.StructArray.from_arrays([pa.array(blocks.astype(np.int32)), inner], ["block", "cells"])
        ends = np.searchsorted(rows, np.arange(len(lists) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pairs)

    return split(cells)


def _visits(queries: DataFrame, block_of: np.ndarray) -> tuple[list[int], dict[int, int]]:
    """(cells that are visited, queries that visit each block); a batch sends one row for each of them."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = set(), {}
        for batch in batches:
            blocks = batch.column(0)
            pairs = blocks.flatten()
            numbers, n = np.unique(pairs.field("block").to_numpy(zero_copy_only=False), return_counts=True)
            for block, visitors in zip(numbers.tolist(), n.tolist()):
                counts[block] = counts.get(block, 0) + visitors
            lists = pairs.field("cells")
            whole = np.unique(pairs.field("block").to_numpy(zero_copy_only=False)[lists.is_null().to_numpy(zero_copy_only=False)])
            cells.update(np.flatnonzero(np.isin(block_of, whole)).tolist(), np.unique(lists.flatten().to_numpy(zero_copy_only=False)).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array([*cells, *[None] * len(counts)], pa.int32()), pa.array([*[None] * len(cells), *counts], pa.int32()),
             pa.array([*[None] * len(cells), *counts.values()], pa.int64())], ["cell", "block", "n"])

    seen = queries.select("blocks").mapInArrow(tally, "cell int, block int, n long").groupBy("cell", "block").agg(
        F.sum("n").alias("n")).collect()
    return (sorted(r["cell"] for r in seen if r["cell"] is not None),
            {r["block"]: r["n"] for r in seen if r["block"] is not None})


def _score_cells(store: DataFrame, queries: DataFrame, sizes: dict[int, int], schema: str,
                 score: Callable[[pa.Table, pa.Table], pa.Table], block_rows: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Scores store rows (with `cell`) against queries (with `cells`), one pair of blocks per group.

    `sizes` is the row count per cell. Cells are packed into blocks of up to `block_rows` store rows, or cut into
    parts of about as many, and the visitors of a block likewise, so no group grows with the data. Fewer rows make
    smaller blocks, about MIN_BLOCKS. A query is copied once per part of a block it visits, not per cell, a store
    row once per strip of its block's visitors; cells without visitors are dropped before the shuffle.
    """
    block_rows = min(block_rows, max(MIN_BLOCK_ROWS, sum(sizes.values()) // MIN_BLOCKS))
    block_of, parts = _packed(sizes, block_rows)
    asked = queries.withColumn("blocks", _by_block(block_of, "cells"))
    visited, visitors = _visits(asked, block_of)
    strips = [math.ceil(visitors.get(b, 0) / block_rows) for b in range(len(parts))]

    def of(values: list[int], number: Column) -> Column:
        return F.element_at(F.array(*[F.lit(int(n)) for n in values] or [F.lit(0)]), number + 1)

    def one_of(key: str, blocks: Column) -> Column:
        return F.pmod(F.xxhash64(key), blocks).cast("int")

    def each_of(blocks: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks - 1))

    # where `cell` is a folder the first condition prunes the scan
    left = store.filter(F.col("cell").isin(visited)).withColumn("block", of(block_of.tolist(), F.col("cell"))).select(
        "embedding_id", "embedding", *extra, "cell", "block", one_of("embedding_id", of(parts, F.col("block"))).alias("part"),
        each_of(of(strips, F.col("block"))).alias("strip"))
    right = asked.select("query_id", "query_vec", "bar", *extra, F.explode("blocks").alias("_at")).select(
        "query_id", "query_vec", "bar", *extra, "_at.cells", "_at.block").select(
            "*", each_of(of(parts, F.col("block"))).alias("part"), one_of("query_id", of(strips, F.col("block"))).alias("strip"))
    group = ["block", "part", "strip"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(score, schema)


def _cells(store: DataFrame, n_pivots: int | None) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(store with `cell`, pivots, radius and row count per cell); no pivots where nothing can match."""
    if n_pivots is None:
        n_pivots = max(1, min(MAX_PIVOTS, math.isqrt(store.count())))
    pivots = pick_pivots(store, n_pivots)
    if not len(pivots):
        return store, pivots, np.empty(0), np.empty(0, np.int64)
    # read by the counts and by each round
    celled = cut_lineage(store.withColumn("_near", nearest_cell("embedding", pivots)).select(
        *store.columns, F.col("_near.cell").alias("cell"), F.col("_near.angle").alias("angle")))
    radii, sizes = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for row in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect():
        sizes[row["cell"]] = row["n"]
        if row["radius"] is not None:
            radii[row["cell"]] = row["radius"]
    return celled, pivots, radii, sizes


def scored_pairs(store: DataFrame, queries: DataFrame, threshold: float | None, k: int | None = None,
                 skip_self: bool = False, dim: int | None = None, max_queries: int = MAX_QUERIES,
                 n_pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, embedding_id, similarity) with similarity >= threshold.

    Without a threshold each query has its own in the column `threshold`. With k, each query's k best
    (ties included) are among the rows; rank them to cut to k. An empty side gives no rows.
    """
    schema = _pairs_schema(queries, store)
    store, queries, dim = _prepare(store, queries, threshold, dim, skip_self, [])
    head, fits = _query_head(queries, dim, max_queries)
    if fits:
        return _score_broadcast(store, head, schema, k, skip_self)
    celled, pivots, radii, sizes = _cells(store, n_pivots)
    if not len(pivots):
        return store.sparkSession.createDataFrame([], schema)
    return search_cells(celled, queries, pivots, radii, sizes, schema, k, skip_self, block_rows)


def search_cells(celled: DataFrame, queries: DataFrame, pivots: np.ndarray, radii: np.ndarray, sizes: np.ndarray,
                 schema: str, k: int | None, skip_self: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact matches of `queries` (query_id, query_vec, bar) among store rows with `cell`, by blocks.

    `radii` and `sizes` are the largest angle to the pivot and the rows of each cell. Cells that no query can
    need are left out; they are not even read where `cell` is a folder.
    """
    counts = dict(enumerate(sizes.tolist()))
    score = _match_blocks(k, skip_self)
    if k is None:
        block_rows = min(block_rows, math.isqrt(HELD_MATCHES))
        visiting = queries.withColumn("cells", cells_in_reach("query_vec", "bar", pivots, radii, sizes))
        return _score_cells(celled, visiting, counts, schema, score, block_rows)
    block_rows = min(block_rows, max(MIN_BLOCK_ROWS, HELD_MATCHES // (4 * max(k, 1))))
    rows = FIRST_SHARE * (k + 1)
    around = queries.withColumn("cells", cells_around("query_vec", pivots, sizes, rows))
    # k rows per query, read for the bounds and for the answer
    first = cut_lineage(_ranked(_score_cells(celled, around, counts, schema, score, block_rows), k))
    reached = first.filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("_reached"))
    bounded = queries.join(reached, "query_id", "left").withColumn(
        "bar", F.greatest("bar", F.col("_reached") - BOUND_SLACK)).drop("_reached")
    rest = bounded.withColumn("cells", cells_in_reach("query_vec", "bar", pivots, radii, sizes, rows))
    return first.drop("rank").unionByName(_score_cells(celled, rest, counts, schema, score, block_rows))


def _ranked(pairs: DataFrame, limit: int) -> DataFrame:
    """Best first per query, ids break ties. A task passes on at most `limit` rows of a query, so one shuffle will do."""
    pairs = pairs.withColumn("similarity", F.round("similarity", RANK_DIGITS))
    return top_per_group(pairs, ["query_id"], [F.col("similarity").desc(), F.col("embedding_id")], limit, spread=1)


def search_requests(store: DataFrame, requests: DataFrame, dim: int, **how) -> tuple[DataFrame, DataFrame]:
    """(answers, rejected requests) where each request brings its own top_k and threshold.

    Requests have query_id (unique), query_vec, top_k and threshold; see `validate_requests` for the rules and
    the default threshold. A vector of another length than `dim` is rejected, too.
    """
    checked = validate_requests(requests).withColumn("error", F.coalesce(
        "error", F.when(~F.coalesce(usable("query_vec", dim), F.lit(False)), "wrong dimension")))
    good = checked.filter(F.col("error").isNull())
    # at most MAX_TOP_K, by the rules
    most = good.agg(F.max("top_k")).first()[0] or 1
    asked = good.select("query_id", "query_vec", F.col("threshold_used").alias("threshold"))
    ranked = _ranked(scored_pairs(store, asked, None, most, dim=dim, **how), most)
    answers = ranked.join(good.select("query_id", "top_k"), "query_id").filter(F.col("rank") <= F.col("top_k"))
    return answers.drop("top_k"), checked.filter(F.col("error").isNotNull()).drop("threshold_used")


def similar_topk(store: DataFrame, queries: DataFrame, limit: int = ENGINE_LIMIT,
                 threshold: float = ENGINE_THRESHOLD, **how) -> DataFrame:
    """For each query vector the stored vectors with cosine >= threshold, best first, at most `limit`."""
    return _ranked(scored_pairs(store, queries, threshold, limit, **how), limit)


def knn_then_threshold(store: DataFrame, queries: DataFrame, k: int = ROUTER_CANDIDATES,
                       threshold: float = ROUTER_THRESHOLD, **how) -> DataFrame:
    """The k nearest by cosine distance, then those with 1 - distance >= threshold; k = 0 means the default.

    In a list sorted by similarity a cut at k and a cut at the threshold commute, so the threshold is
    applied inside the scoring and fewer rows are shuffled.
    """
    return similar_topk(store, queries, k or ROUTER_CANDIDATES, threshold, **how)


def route_projection(matches: DataFrame, store: DataFrame | None = None, metadata: tuple[str, ...] = ()) -> DataFrame:
    """Matches as result records with their cache key and, from `store`, the metadata columns of the entry.

    The columns are fetched for the matches alone, after the ranking; they are null for an entry that is gone.
    """
    from vectide.functions.keys import TEXT_PREFIX, prefixed

    records = matches.select(
        "query_id", "rank", "embedding_id", F.col("similarity").alias("similarity_score"),
        prefixed(TEXT_PREFIX, "embedding_id").alias("cache_key"))
    return records if store is None else records.join(store.select("embedding_id", *metadata), "embedding_id", "left")


def find_similar_fetch(index: DataFrame, live: DataFrame, queries: DataFrame, k: int, threshold: float,
                       **how) -> DataFrame:
    """Matches from the index with vector and metadata of the live store; entries gone from it are dropped.

    Ranking runs on ids alone; the vectors are joined to the few that are left.
    """
    hits = knn_then_threshold(index, queries, k, threshold, **how)
    return hits.join(live, "embedding_id")


def filtered_search(store: DataFrame, queries: DataFrame, equals: dict[str, object],
                    limit: int = ENGINE_LIMIT, threshold: float = ENGINE_THRESHOLD, **how) -> DataFrame:
    """Search among the entries whose columns equal the given values; filters reach the scan."""
    for name, value in equals.items():
        store = store.filter(F.col(name) == value)
    return similar_topk(store, queries, limit, threshold, **how)


def global_topk(store: DataFrame, query: DataFrame, limit: int = ENGINE_LIMIT, threshold: float = -1.0,
                **how) -> DataFrame:
    """Best-first list for one query vector."""
    pairs = scored_pairs(store, query, threshold, limit, **how).withColumn("similarity", F.round("similarity", RANK_DIGITS))
    return pairs.orderBy(F.col("similarity").desc(), F.col("embedding_id")).limit(limit)


def precompute_neighbors(store: DataFrame, limit: int = NEIGHBOUR_LIMIT,
                         threshold: float = NEIGHBOUR_THRESHOLD, with_empty: bool = False, **how) -> DataFrame:
    """Per entry the ids of its up to `limit` nearest other entries, best first, as an array.

    An entry that no other is near to has no row or, `with_empty`, an empty array.
    """
    asked = store.select(F.col("embedding_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    best = _ranked(scored_pairs(store, asked, threshold, limit, skip_self=True, **how), limit)
    lists = best.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "embedding_id"))).alias("_best"))
    found = lists.select(F.col("query_id").alias("embedding_id"),
                         F.col("_best.embedding_id").alias("precomputed_neighbors"))
    if not with_empty:
        return found
    none = F.array().cast(dict(found.dtypes)["precomputed_neighbors"])
    return store.select("embedding_id").join(found, "embedding_id", "left").withColumn(
        "precomputed_neighbors", F.coalesce("precomputed_neighbors", none))


def _pruned_search(store: DataFrame, queries: DataFrame, cells: Callable[[int], tuple[CellOf, CellOf]],
                   threshold: float, limit: int, max_queries: int, block_rows: int, dim: int | None) -> DataFrame:
    """Search where a query only meets the cells it visits; `cells` gives both cell functions for a length."""
    schema = _pairs_schema(queries, store)
    store, queries, dim = _prepare(store, queries, threshold, dim, False, [])
    cell_of, cells_of = cells(dim)
    head, fits = _query_head(queries, dim, max_queries)
    if fits:
        return _ranked(_score_broadcast(store, head, schema, limit, False, cell_of, cells_of), limit)
    celled = store.withColumn("cell", _cell_column(cell_of, "embedding"))
    sizes = {row["cell"]: row["count"] for row in celled.groupBy("cell").count().collect()}
    visiting = queries.withColumn("cells", _cells_column(cells_of, "query_vec"))
    return _ranked(_score_cells(celled, visiting, sizes, schema, _match_blocks(limit, False), block_rows), limit)


def cluster_pruned_search(store: DataFrame, queries: DataFrame, centroids: np.ndarray, probes: int = 4,
                          limit: int = ENGINE_LIMIT, threshold: float = ENGINE_THRESHOLD,
                          max_queries: int = MAX_QUERIES, block_rows: int = BLOCK_ROWS,
                          dim: int | None = None) -> DataFrame:
    """Search only the `probes` clusters nearest to each query; exact cosine inside them.

    Approximate: a match in a cluster that is not probed is missed.
    """
    unit = unit_rows(centroids)

    def nearest(vectors: np.ndarray) -> np.ndarray:
        return np.nan_to_num(vectors @ unit.T, nan=-1.0).argmax(axis=1)

    def probed(vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-(vectors @ unit.T), axis=1, kind="stable")[:, :probes]

    return _pruned_search(store, queries, lambda _: (nearest, probed), threshold, limit, max_queries, block_rows, dim)


def hyperplanes(dim: int, bits: int, seed: int) -> np.ndarray:
    """Normals of `bits` random planes through the origin."""
    return np.random.default_rng(seed).standard_normal((bits, dim))


def approx_similar_join(store: DataFrame, queries: DataFrame, threshold: float = ROUTER_THRESHOLD,
                        limit: int = ROUTER_CANDIDATES, bits: int = 6, flips: int = 2, seed: int = 42,
                        max_queries: int = MAX_QUERIES, block_rows: int = BLOCK_ROWS,
                        dim: int | None = None) -> DataFrame:
    """Approximate neighbours by random-hyperplane signatures, checked by exact cosine.

    A cell is a signature: on which side of each plane a vector lies. A query visits its own signature and
    those within `flips` bits. More flips find more and cost more; flips = bits is the exact search.
    """
    weights = 1 << np.arange(bits)
    masks = np.array([m for m in range(1 << bits) if m.bit_count() <= flips])

    def cells(dim: int) -> tuple[CellOf, CellOf]:
        planes = hyperplanes(dim, bits, seed)

        def signature(vectors: np.ndarray) -> np.ndarray:
            return ((vectors @ planes.T) > 0) @ weights

        return signature, lambda vectors: signature(vectors)[:, None] ^ masks[None, :]

    return _pruned_search(store, queries, cells, threshold, limit, max_queries, block_rows, dim)


def threshold_sweep(store: DataFrame, queries: DataFrame, thresholds: list[float], label: str = "label",
                    dim: int | None = None, max_queries: int = MAX_QUERIES, n_pivots: int | None = None,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per threshold: pairs at or above it and the share whose labels agree.

    `queries` has query_id, query_vec and the label column. Pairs are counted where they are scored; a
    batch or pair of blocks gives one row per threshold, so no pair is ever shuffled.
    """
    cuts = np.array(thresholds)
    lowest = float(cuts.min()) - 1e-6
    store, queries, dim = _prepare(store, queries, lowest, dim, True, [label])
    columns = ["threshold", "pairs", "agreeing"]
    schema = "threshold double, pairs long, agreeing long"

    def tally(stored: pa.Table, q_ids: pa.Array, q_unit: np.ndarray, bars: np.ndarray, q_labels: pa.Array) -> np.ndarray:
        """Rows (pairs, agreeing) by threshold; a null label agrees with none."""
        totals = np.zeros((2, len(cuts)), np.int64)
        rows, vectors = _unit(pa.array(np.arange(stored.num_rows)), stored.column("embedding"))
        if not len(rows) or not len(q_unit):
            return totals
        kept = stored.take(rows)
        ids, labels = kept.column("embedding_id").combine_chunks(), kept.column(label).combine_chunks()
        for q, v, scores in _best(q_ids, ids, q_unit, vectors, bars, None, True, _no_floor(q_unit)):
            same = pc.equal(q_labels.take(pa.array(q)), labels.take(pa.array(v))).fill_null(False)
            at = np.round(scores, RANK_DIGITS)[None, :] >= cuts[:, None]
            totals += np.array([at.sum(axis=1), (at & same.to_numpy(zero_copy_only=False)[None, :]).sum(axis=1)])
        return totals

    def asked_with_labels(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
        rows, unit = _unit(pa.array(np.arange(table.num_rows)), table.column("query_vec"))
        kept = table.take(rows)
        return (kept.column("query_id").combine_chunks(), unit, kept.column("bar").to_numpy(),
                kept.column(label).combine_chunks())

    head, fits = _query_head(queries, dim, max_queries)
    if fits:
        shared = store.sparkSession.sparkContext.broadcast(asked_with_labels(head))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs, agreeing = tally(pa.Table.from_batches([batch]), *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(cuts), pa.array(pairs), pa.array(agreeing)], columns)

        counted = store.mapInArrow(count, schema)
    else:

        def count_blocks(stored: pa.Table, asked: pa.Table) -> pa.Table:
            totals = np.zeros((2, len(cuts)), np.int64)
            for rows, some in _met(stored, asked):
                totals += tally(stored.take(pa.array(rows)), *asked_with_labels(asked.take(pa.array(some))))
            return pa.table([pa.array(cuts), pa.array(totals[0]), pa.array(totals[1])], columns)

        celled, pivots, radii, sizes = _cells(store, n_pivots)
        if len(pivots):
            visiting = queries.withColumn("cells", cells_in_reach("query_vec", "bar", pivots, radii, sizes))
            counted = _score_cells(celled, visiting, dict(enumerate(sizes.tolist())), schema, count_blocks, block_rows, (label,))
        else:
            counted = store.sparkSession.createDataFrame([], schema)
    every = store.sparkSession.createDataFrame([(t, 0, 0) for t in thresholds], schema)
    return counted.unionByName(every).groupBy("threshold").agg(
        F.sum("pairs").alias("pairs"), F.sum("agreeing").alias("agreeing"),
        F.coalesce(F.try_divide(F.sum("agreeing").cast("double"), F.sum("pairs").cast("double")),
                   F.lit(0.0)).alias("agreement"))
