"""Neighbour lists kept with the index, and brought up to date by what a write changes.

After a write three kinds of entry have a new list. Entries that were written and entries whose list names a written
one are searched anew, from the cells in reach. Any other entry can only gain a written one, and only if it beats the last
one of the list: a few written entries are scored against the cells in reach of the threshold; if there are many, the other
entries look for their best among them, from the last one of their list on. What beats the list is merged into it. All
other entries are neither read nor scored beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vectide.operators import similarity as sim
from vectide.operators.cellindex import CellIndex
from vectide.operators.groups import top_per_group
from vectide.operators.store import latest_per_id
from vectide.session import cut_lineage
from vectide.sources.commitlog import StoreLog

# Parts of the stored lists, by the hash of the entry.
PARTS = 64


class NeighbourLists:
    """The up to `limit` nearest other entries at or above `threshold` of each entry of an index."""

    def __init__(self, spark: SparkSession, base: str, index: CellIndex, limit: int = sim.NEIGHBOUR_LIMIT,
                 threshold: float = sim.NEIGHBOUR_THRESHOLD):
        self.spark, self.index, self.limit, self.threshold = spark, index, limit, threshold
        self.log = StoreLog(spark, base, part="part")
        self.searched = 0  # entries whose lists the last build or update searched

    def read(self) -> DataFrame:
        """(embedding_id, neighbors) with neighbors as array<struct<embedding_id, similarity>>, best first; also empty ones."""
        return self.log.read().select("embedding_id", "neighbors")

    def build(self) -> int:
        """All lists anew; the version of the index they belong to is the current one."""
        entries = self.index.rows().select("embedding_id", "embedding")
        return self.log.write(self._stored(self._search(entries), 0))

    def update(self, writes: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """Writes into the index and brings the lists up to date; a repeated batch changes nothing."""
        state = self.log.state()
        if writer is not None and state.applied.get(writer, -1) >= batch:
            return state.version
        written = cut_lineage(latest_per_id(self.index._good(writes), tie=self.index.log.tie).select("embedding_id"))
        self.index.upsert(writes, writer, batch)
        rows = self.index.rows().select("embedding_id", "embedding")
        lists = self.log.read().select("embedding_id", "neighbors")
        named = lists.filter(F.size("neighbors") > 0).select(
            F.col("embedding_id").alias("holder"), F.explode("neighbors.embedding_id").alias("embedding_id")).join(
                written, "embedding_id", "left_semi").select(F.col("holder").alias("embedding_id"))
        again = cut_lineage(written.union(named).distinct())
        fresh = self._search(rows.join(again, "embedding_id", "left_semi"))
        # the written entries among the neighbours of all others
        asked = rows.join(written, "embedding_id", "left_semi").select(
            F.col("embedding_id").alias("query_id"), F.col("embedding").alias("query_vec"))
        bound = lists.select("embedding_id", "neighbors", F.when(F.size("neighbors") >= self.limit, F.element_at("neighbors", -1)).alias("last"))
        if written.count() <= sim.MAX_QUERIES:
            near = self.index.matches(asked, self.threshold).select("embedding_id", F.col("query_id").alias("other"), "similarity").join(
                again, "embedding_id", "left_anti")
        else:
            near = self._gains(rows.join(again, "embedding_id", "left_anti"), asked, bound)
        near = near.withColumn("similarity", F.round("similarity", sim.RANK_DIGITS))
        better = F.col("last").isNull() | (F.col("similarity") > F.col("last.similarity")) | (
            (F.col("similarity") == F.col("last.similarity")) & (F.col("other") < F.col("last.embedding_id")))
        gained = cut_lineage(near.join(bound, "embedding_id").filter(better).select("embedding_id", "other", "similarity"))
        kept = lists.join(gained.select("embedding_id").distinct(), "embedding_id", "left_semi").select(
            "embedding_id", F.explode("neighbors").alias("n")).select("embedding_id", F.col("n.embedding_id").alias("other"), "n.similarity")
        merged = self._lists(kept.unionByName(gained))
        return self.log.upsert(self._stored(fresh.unionByName(merged), state.version), writer, batch)

    def _gains(self, entries: DataFrame, written: DataFrame, bound: DataFrame) -> DataFrame:
        """(embedding_id, other, similarity): the best written entries of each entry that reach the last one of its list.

        The entries ask here, so no more than `limit` of a block of written entries are held or passed on for each.
        """
        least = F.greatest(F.lit(self.threshold), F.coalesce(F.col("last.similarity") - sim.BOUND_SLACK, F.lit(self.threshold)))
        asking = entries.join(bound.select("embedding_id", least.alias("threshold")).distinct(), "embedding_id").select(
            F.col("embedding_id").alias("query_id"), F.col("embedding").alias("query_vec"), "threshold")
        store = cut_lineage(written.select(F.col("query_id").alias("embedding_id"), F.col("query_vec").alias("embedding")))
        return sim.scored_pairs(store, cut_lineage(asking), None, self.limit, dim=self.index.dim).select(
            F.col("query_id").alias("embedding_id"), F.col("embedding_id").alias("other"), "similarity")

    def _search(self, entries: DataFrame) -> DataFrame:
        """Lists of the given entries, empty ones included."""
        entries = cut_lineage(entries)
        self.searched = entries.count()
        asked = entries.select(F.col("embedding_id").alias("query_id"), F.col("embedding").alias("query_vec"))
        found = self.index.search(asked, self.limit + 1, self.threshold).filter(F.col("query_id") != F.col("embedding_id"))
        lists = self._lists(found.select(F.col("query_id").alias("embedding_id"), F.col("embedding_id").alias("other"), "similarity"))
        none = F.array().cast(dict(lists.dtypes)["neighbors"])
        return entries.select("embedding_id").join(lists, "embedding_id", "left").withColumn("neighbors", F.coalesce("neighbors", none))

    def _lists(self, pairs: DataFrame) -> DataFrame:
        best = top_per_group(pairs, ["embedding_id"], [F.col("similarity").desc(), F.col("other")], self.limit, spread=1)
        ranked = F.sort_array(F.collect_list(F.struct("rank", F.col("other").alias("embedding_id"), "similarity")))
        return best.groupBy("embedding_id").agg(ranked.alias("_best")).select("embedding_id", F.transform(
            "_best", lambda x: F.struct(x["embedding_id"].alias("embedding_id"), x["similarity"].alias("similarity"))).alias("neighbors"))

    def _stored(self, lists: DataFrame, age: int) -> DataFrame:
        return lists.select("embedding_id", "neighbors", F.lit(age).cast("long").alias("created_at"),
                            F.pmod(F.xxhash64("embedding_id"), F.lit(PARTS)).cast("int").alias("part"))
