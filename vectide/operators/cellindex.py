"""A search index kept with the store: vectors in cells, each cell a folder, and searches that read few cells.

The cells are those nearest to given centres or, for signatures, the sides of random planes. Centres, radii and row
counts are small side tables of the same version. A write gives new rows their cell and rewrites only the cells it
touches; a search works out which cells its queries visit and filters on the cell, which is a partition column, so
the other folders are not listed among the files of the scan.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectide.functions.vectors import dense, unit_rows, usable
from vectide.operators import similarity as sim
from vectide.session import cut_lineage
from vectide.sources.commitlog import State, StoreLog

# Fixed bounds: centres that go to every task, and rows of a signature's cell that more planes would halve.
MAX_CENTRES = 4096
PLANE_ROWS = 4096
CELL, ANGLE = "cell", "angle"


class CellIndex:
    """Vectors of length `dim` with `embedding_id`, `embedding`, `created_at` and any more columns, below `base`.

    `planes` keeps signatures instead of nearest centres. Entries without a usable vector are not in the index.
    """

    def __init__(self, spark: SparkSession, base: str, dim: int, planes: bool = False, tie: str | None = None):
        self.spark, self.dim, self.planes = spark, dim, planes
        self.log = StoreLog(spark, base, part=CELL, tie=tie)

    # -- building

    def build(self, store: DataFrame, centres: np.ndarray | None = None, bits: int | None = None, seed: int = 42) -> int:
        """Writes the whole index; its version.

        Centres default to stored vectors, about the square root of the rows and at most MAX_CENTRES. Planes default
        to as many as keep about PLANE_ROWS rows in a cell, at least six.
        """
        good = self._good(store)
        if self.planes:
            bits = bits or max(6, math.ceil(math.log2(max(1, good.count()) / PLANE_ROWS)))
            centres = sim.hyperplanes(self.dim, bits, seed)
        elif centres is None:
            wanted = max(1, min(MAX_CENTRES, math.isqrt(good.count())))
            centres = sim.pick_pivots(good, wanted)
        if len(centres) > MAX_CENTRES:
            raise ValueError(f"more than {MAX_CENTRES} centres")
        rows = cut_lineage(self._placed(good, centres))
        table = [(n, [float(x) for x in centre]) for n, centre in enumerate(centres)]
        return self.log.write(rows, {
            "centres": self.spark.createDataFrame(table, "number int, centre array<double>").coalesce(1), "sizes": _sizes(rows)})

    def upsert(self, writes: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """Writes rows into the cells of their vectors; only cells that hold or held a written id are written.

        A write without a usable vector is left out, and the stored row stays.
        """
        state = self.log.state()
        rows = self._placed(self._good(writes), self._centres(state))
        before = self.spark.read.parquet(state.side["sizes"])

        def sizes(touched: list[int], fresh: DataFrame) -> dict[str, DataFrame]:
            return {"sizes": before.filter(~F.col(CELL).isin(touched)).unionByName(_sizes(fresh))}

        return self.log.upsert(rows, writer, batch, sizes)

    def _good(self, store: DataFrame) -> DataFrame:
        return store.filter(usable("embedding", self.dim))

    def _centres(self, state: State) -> np.ndarray:
        rows = self.spark.read.parquet(state.side["centres"]).orderBy("number").toArrow()
        return dense(rows.column("centre")) if rows.num_rows else np.zeros((0, self.dim))

    def _placed(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        rows = rows.drop(CELL, ANGLE)
        if self.planes:
            return rows.withColumn(CELL, sim._cell_column(_signatures(centres), "embedding")).withColumn(
                ANGLE, F.lit(None).cast("double"))
        if not len(centres):
            return rows.withColumn(CELL, F.lit(0)).withColumn(ANGLE, F.lit(None).cast("double"))
        near = rows.withColumn("_near", sim.nearest_cell("embedding", unit_rows(centres)))
        return near.withColumn(CELL, F.col("_near.cell")).withColumn(ANGLE, F.col("_near.angle")).drop("_near")

    # -- searching

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The indexed rows; `cells` prunes the scan."""
        rows = self.log.read().drop(ANGLE)
        return rows if cells is None else rows.filter(F.col(CELL).isin(cells))

    def probe(self, queries: DataFrame, probes: int = 4, limit: int = sim.ENGINE_LIMIT, threshold: float = sim.ENGINE_THRESHOLD,
              max_queries: int = sim.MAX_QUERIES, block_rows: int = sim.BLOCK_ROWS) -> DataFrame:
        """The best matches in the `probes` cells nearest to each query; matches in other cells are missed.

        With planes a query visits the signatures that differ from its own in fewer bits than `probes`.
        """
        centres = self._centres(self.log.state())
        if self.planes:
            signature = _signatures(centres)
            masks = np.array([m for m in range(1 << len(centres)) if m.bit_count() < probes])
            visits = lambda vectors: signature(vectors)[:, None] ^ masks[None, :]
        else:
            unit = unit_rows(centres)
            visits = lambda vectors: np.argsort(-(vectors @ unit.T), axis=1, kind="stable")[:, :probes]
        schema, asked, head, fits = self._asked(queries, threshold, max_queries)
        if fits:
            table = sim._asked(head)
            visitors = sim.visitors_of(visits(table[1])) if len(table[1]) and len(centres) else {}
            return sim._ranked(sim.score_visitors(self.rows(sorted(visitors)), table, visitors, schema, limit, False), limit)
        sizes = dict(enumerate(self._sizes()[0].tolist()))
        visiting = asked.withColumn("cells", sim._cells_column(visits, "query_vec"))
        return sim._ranked(sim._score_cells(self.rows(), visiting, sizes, schema, sim._match_blocks(limit, False), block_rows), limit)

    def search(self, queries: DataFrame, limit: int = sim.ENGINE_LIMIT, threshold: float = sim.ENGINE_THRESHOLD,
               max_queries: int = sim.MAX_QUERIES, block_rows: int = sim.BLOCK_ROWS) -> DataFrame:
        """The exact answer of `similar_topk`, from the cells that the radii leave in reach.

        Queries first meet the cells around them; the k-th best score there bounds what else is read.
        """
        if self.planes:
            raise ValueError("signatures have no radii; use probe")
        schema, asked, head, fits = self._asked(queries, threshold, max_queries)
        centres = unit_rows(self._centres(self.log.state()))
        sizes, radii = self._sizes()
        if not len(centres) or not sizes.sum():
            return sim._ranked(self.spark.createDataFrame([], schema), limit)
        if not fits:
            return sim._ranked(sim.search_cells(self.rows(), asked, centres, radii, sizes, schema, limit, False, block_rows), limit)
        ids, unit, bars = sim._asked(head)
        if not len(unit):
            return sim._ranked(self.spark.createDataFrame([], schema), limit)
        angles = np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))
        around = sim._around(angles, sizes, sim.FIRST_SHARE * (limit + 1))
        first = cut_lineage(sim._ranked(self._score((ids, unit, bars), around, schema, limit), limit))
        # at most one row for each query of the broadcast side
        known = first.filter(F.col("rank") == limit).select("query_id", "similarity").toArrow()
        reached = dict(zip(known.column(0).to_pylist(), known.column(1).to_pylist()))
        bars = np.maximum(bars, [reached.get(i, -np.inf) - sim.BOUND_SLACK for i in ids.to_pylist()])
        reach = angles <= radii[None, :] + np.arccos(np.clip(bars - sim.BOUND_SLACK, -1.0, 1.0))[:, None] + 1e-7
        rest = self._score((ids, unit, bars), reach & ~around & (sizes > 0), schema, limit)
        return sim._ranked(first.drop("rank").unionByName(rest), limit)

    def matches(self, queries: DataFrame, threshold: float, max_queries: int = sim.MAX_QUERIES,
                block_rows: int = sim.BLOCK_ROWS) -> DataFrame:
        """All entries with cosine >= threshold, for each query, from the cells in reach."""
        schema, asked, head, fits = self._asked(queries, threshold, max_queries)
        centres = unit_rows(self._centres(self.log.state()))
        sizes, radii = self._sizes()
        if not len(centres) or not sizes.sum():
            return self.spark.createDataFrame([], schema)
        if not fits:
            return sim.search_cells(self.rows(), asked, centres, radii, sizes, schema, None, False, block_rows)
        ids, unit, bars = sim._asked(head)
        if not len(unit):
            return self.spark.createDataFrame([], schema)
        angles = np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))
        reach = angles <= radii[None, :] + np.arccos(np.clip(bars - sim.BOUND_SLACK, -1.0, 1.0))[:, None] + 1e-7
        return self._score((ids, unit, bars), reach & (sizes > 0), schema, None)

    def _score(self, asked: tuple, marks: np.ndarray, schema: str, limit: int | None) -> DataFrame:
        visitors = {int(c): np.flatnonzero(marks[:, c]) for c in np.flatnonzero(marks.any(axis=0))}
        return sim.score_visitors(self.rows(sorted(visitors)), asked, visitors, schema, limit, False)

    def _asked(self, queries: DataFrame, threshold: float, max_queries: int):
        schema = sim._pairs_schema(queries, self.rows())
        good = queries.filter(usable("query_vec", self.dim)).select(
            "query_id", "query_vec", F.lit(threshold).cast("double").alias("bar"))
        return schema, good, *sim._query_head(good, self.dim, max_queries)

    def _sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows, radius) of each cell; at most as many as there are centres or signatures."""
        state = self.log.state()
        found = self.spark.read.parquet(state.side["sizes"]).collect()
        n = 1 + max([row[CELL] for row in found], default=-1)
        if not self.planes:
            n = max(n, len(self._centres(state)))
        sizes, radii = np.zeros(n, np.int64), np.full(n, -np.inf)
        for row in found:
            sizes[row[CELL]] = row["rows"]
            if row["radius"] is not None:
                radii[row[CELL]] = row["radius"]
        return sizes, radii


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(CELL).agg(F.count(F.lit(1)).alias("rows"), F.max(ANGLE).alias("radius")).coalesce(1)


def _signatures(planes: np.ndarray) -> sim.CellOf:
    weights = 1 << np.arange(len(planes))
    return lambda vectors: ((vectors @ planes.T) > 0) @ weights

