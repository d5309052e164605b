"""Near-duplicate vectors by NN-descent.

1. Equal vectors become one node with a weight. 2. Random hyperplanes give each node first neighbours.
3. Rounds: each node's list and the nodes that list it meet, all are compared with each other, and better
neighbours replace worse ones: neighbours of neighbours. Rounds end when the links above the threshold
hardly change and the audited recall reaches its target; where further first neighbours do not bring it
there, or links are too rare for an audit, all pairs of a label are compared in blocks. 4. A node all of whose list is above the threshold
is saturated: its list is enlarged to all saturated nodes of its component. Those within half the
threshold's angle of the component's centre are linked with each other by the triangle inequality and are
only counted; the others are scored against the component in blocks. Two components whose centres and radii
leave room for a link are scored across, as their lists may hold only nodes nearer than any of the other's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from vectide.llm.components import components
from vectide.llm.shared import first_by_hash, kept

THRESHOLD = 0.93
K = 8
TABLES = 6
BLOCK = 512
# Rows of the left side that are scored at once, and how much larger than BLOCK the blocks of all pairs are.
STRIP = 512
EXACT_BLOCKS = 8
# Nodes that are compared with all others, first few, then more, until ENOUGH of them have links; and the share of a
# node's links that must be found on average.
AUDIT = (256, 4096)
ENOUGH = 32
RECALL = 0.97
# Rounds of first lists before all pairs of a label are compared, and the chance that a pair at the threshold meets in one.
ROUNDS = 4
MEET = 0.8
SEED = 20


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _groups(column: pa.ListArray):
    """Of each list of structs: the fields as arrays, `vec` as a matrix of unit rows."""
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    flat = column.flatten()
    vecs = flat.field("vec")
    at = vecs.offsets.to_numpy() - vecs.offsets[0].as_py()
    values = vecs.flatten().to_numpy()
    others = {f.name: flat.field(f.name).to_numpy() for f in flat.type if f.name != "vec"}
    for a, b in zip(ends[:-1], ends[1:]):
        yield {n: x[a:b] for n, x in others.items()}, _unit(values[at[a]:at[b]].reshape(b - a, -1))


def _table(names: list[str], parts: list[tuple], types: list) -> pa.RecordBatch:
    columns = [np.concatenate([p[i] for p in parts]) if parts else [] for i in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


PAIR = "node long, nb long, sim double"
_PAIR = (["node", "nb", "sim"], [pa.int64(), pa.int64(), pa.float64()])


def _signatures(bits: int, tables: int, round_: int):
    """Side of each node for `bits` random hyperplanes, per table."""

    def run(batches):
        for batch in batches:
            vecs = batch.column("vec")
            sizes, values = np.diff(vecs.offsets.to_numpy()), vecs.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            out = np.empty((batch.num_rows, tables), np.int64)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = np.stack([values[starts[r]:starts[r] + dim] for r in rows]).astype(np.float64)
                planes = np.random.default_rng([SEED, round_, int(dim)]).standard_normal((dim, tables * bits))
                side = (x @ planes > 0).reshape(len(rows), tables, bits)
                out[rows] = side @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label"), pa.array(sizes.astype(np.int32)),
                 pa.ListArray.from_arrays(np.arange(0, out.size + 1, tables, dtype=np.int32), pa.array(out.reshape(-1)))],
                names=["node", "label", "dim", "cells"])

    return run


def _nearest(k: int):
    """The k best neighbours of each node among the nodes of its block."""

    def run(batches):
        for batch in batches:
            parts = []
            for fields, x in _groups(batch.column("members")):
                n = len(x)
                if n < 2:
                    continue
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                best = np.argpartition(-sims, min(k, n - 1) - 1, axis=1)[:, :min(k, n - 1)]
                parts.append((np.repeat(fields["node"], best.shape[1]), fields["node"][best].reshape(-1),
                              np.take_along_axis(sims, best, 1).reshape(-1)))
            yield _table(_PAIR[0], parts, _PAIR[1])

    return run


def _meet(k: int):
    """Pairs of a node's neighbours that are better than the worst one either has in its list."""

    def run(batches):
        for batch in batches:
            parts = []
            for fields, x in _groups(batch.column("members")):
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                a, b = np.nonzero(sims > fields["worst"][:, None])
                parts.append((fields["node"][a], fields["node"][b], sims[a, b]))
            yield _table(_PAIR[0], parts, _PAIR[1])

    return run


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """Each node's k best, once each; `new` tells which were not in the list before."""
    once = pairs.groupBy("node", "nb").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    best = Window.partitionBy("node").orderBy(F.col("sim").desc(), "nb")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _first_lists(nodes: DataFrame, k: int, tables: int, block: int, round_: int) -> DataFrame:
    """Neighbours inside hyperplane cells; a cell with more than `block` nodes is dealt to several blocks."""
    bits = max(1, min(48, math.ceil(math.log2(max(2, nodes.count()) / 32))))
    one = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    tables = max(tables, math.ceil(math.log(1 - MEET) / math.log(1 - one)))
    cells = kept(
        nodes.select("node", "label", "vec").mapInArrow(
            _signatures(bits, tables, round_), "node long, label string, dim int, cells array<long>")
        .select("node", "label", "dim", F.posexplode("cells").alias("t", "cell")), "cells")
    key = ["label", "dim", "t", "cell"]
    sizes = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = cells.join(sizes, key).withColumn(
        "part", F.pmod(F.xxhash64("node", "t"), F.ceil(F.col("n") / block)))
    blocks = dealt.join(nodes.select("node", "vec"), "node").groupBy(*key, "part").agg(
        F.collect_list(F.struct("node", "vec")).alias("members"))
    return blocks.select("members").mapInArrow(_nearest(k), PAIR)


def _across_blocks(k: int):
    """The k best neighbours of each node of the first list in the second."""

    def run(batches):
        for batch in batches:
            parts = []
            for (q, x), (t, y) in zip(_groups(batch.column("left")), _groups(batch.column("right"))):
                for at in range(0, len(x), STRIP):
                    asking = q["node"][at:at + STRIP]
                    sims = np.where(asking[:, None] == t["node"], -2, x[at:at + STRIP] @ y.T)
                    best = np.argpartition(-sims, min(k, len(y)) - 1, axis=1)[:, :min(k, len(y))]
                    found = np.take_along_axis(sims, best, 1).reshape(-1)
                    true = found > -2
                    parts.append((np.repeat(asking, best.shape[1])[true], t["node"][best].reshape(-1)[true], found[true]))
            yield _table(_PAIR[0], parts, _PAIR[1])

    return run


def _exact_lists(nodes: DataFrame, k: int, block: int) -> DataFrame:
    """Each node's k best by all pairs within label and length, in blocks."""
    key = ["label", "dim"]
    sized = nodes.select("node", "label", F.size("vec").alias("dim"), "vec")
    sized = sized.join(sized.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")), key)
    own, each = F.pmod(F.xxhash64("node"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    member = F.struct("node", "vec")
    left = sized.withColumn("i", own).withColumn("j", each).groupBy(*key, "i", "j").agg(F.collect_list(member).alias("left"))
    right = sized.withColumn("j", own).withColumn("i", each).groupBy(*key, "i", "j").agg(F.collect_list(member).alias("right"))
    pairs = left.join(right, [*key, "i", "j"]).select("left", "right").mapInArrow(_across_blocks(k), PAIR)
    return kept(_top(pairs.withColumn("new", F.lit(1)), k), "lists")


def _descend(nodes: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """One round; of the nodes that list a node the k nearest take part."""
    near = Window.partitionBy("nb").orderBy(F.col("sim").desc(), "node")
    back = lists.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k).select(
        F.col("nb").alias("v"), F.col("node"))
    member = lists.select(F.col("node").alias("v"), F.col("nb").alias("node")).union(back).union(
        nodes.select(F.col("node").alias("v"), "node")).distinct()
    worst = lists.groupBy("node").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("n")).select(
        "node", F.when(F.col("n") >= k, F.col("worst")).alias("worst"))
    known = nodes.select("node", "vec").join(worst, "node", "left").select(
        "node", "vec", F.coalesce("worst", F.lit(-1.5)).alias("worst"))
    found = member.join(known, "node").groupBy("v").agg(
        F.collect_list(F.struct("node", "worst", "vec")).alias("members")).select("members").mapInArrow(_meet(k), PAIR)
    return kept(_top(lists.select("node", "nb", "sim", F.lit(0).alias("new")).union(
        found.select("*", F.lit(1).alias("new"))), k), "lists")


def _score(threshold: float):
    """Weighted counts of links of the first list's nodes in the second, and back for core nodes."""

    def run(batches):
        for batch in batches:
            parts = []
            for (q, x), (t, y) in zip(_groups(batch.column("left")), _groups(batch.column("right"))):
                hit = (x @ y.T >= threshold) & (q["node"][:, None] != t["node"][None, :])
                parts.append((q["node"], hit @ t["n"]))
                core = t["core"]
                parts.append((t["node"][core], q["n"] @ hit[:, core]))
            yield _table(["node", "links"], parts, [pa.int64(), pa.int64()])

    return run


def _centres(unit: DataFrame) -> DataFrame:
    """(root, centre): the mean of the unit vectors of each component."""
    return (
        unit.select("root", F.posexplode("unit").alias("i", "x")).groupBy("root", "i").agg(F.avg("x").alias("x"))
        .groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre")))


def _unit_column() -> Column:
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform("vec", lambda x: x.cast("double") / norm)


def _inner(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _close_centres(angle: float):
    """Pairs of components that can hold two nodes within `angle`, by the triangle inequality."""

    def run(batches):
        for batch in batches:
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for q, t in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = (np.array([m["centre"] for m in side]) for side in (q, t))
                a, b = (np.array([m["root"] for m in side]) for side in (q, t))
                wide = np.array([m["radius"] for m in q])[:, None] + np.array([m["radius"] for m in t])
                i, j = np.nonzero((np.arccos(np.clip(x @ y.T, -1, 1)) <= wide + angle + 1e-6) & (a[:, None] < b))
                left.append(a[i])
                right.append(b[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (left, right)], names=["a", "b"])

    return run


def _score_across(threshold: float):
    """Weighted counts of links from each side to the other, and the two components where there are any."""

    def run(batches):
        for batch in batches:
            parts = []
            for a, b, (q, x), (t, y) in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(),
                                            _groups(batch.column("left")), _groups(batch.column("right"))):
                hit = x @ y.T >= threshold
                if hit.any():
                    parts.append((q["node"], hit @ t["n"], np.full(len(x), -1)))
                    parts.append((t["node"], q["n"] @ hit, np.full(len(y), -1)))
                    parts.append((np.array([a]), np.array([0]), np.array([b])))
            yield _table(["node", "links", "other"], parts, [pa.int64()] * 3)

    return run


def _links_across(dense: DataFrame, threshold: float, block: int) -> DataFrame | None:
    """(node, links, other): links between saturated nodes (node, root, label, vec, n) of different components;
    where `other` is not -1, `node` and `other` are roots of components that a link joins.

    Centres meet within label and length, in blocks. Of two components only nodes that are near enough to the
    other's centre are scored. None if no two components can hold a link.
    """
    if dense.select("root").distinct().limit(2).count() < 2:
        return None
    angle = math.acos(threshold)
    unit = dense.withColumn("unit", _unit_column())
    length = F.sqrt(_inner("centre", "centre"))
    # without a direction a centre tells nothing, and its radius is all there is
    centred = _centres(unit).withColumn("known", length > 1e-6).withColumn(
        "centre", F.when(F.col("known"), F.transform("centre", lambda x: x / length)).otherwise(F.col("centre")))
    placed = kept(unit.join(centred, "root"), "placed")
    away = F.when(F.col("known"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _inner("unit", "centre"))))).otherwise(F.lit(math.pi))
    key = ["label", "dim"]
    spans = kept(placed.select("root", "label", F.size("vec").alias("dim"), "centre", away.alias("away")).groupBy("root", *key).agg(
        F.max("away").alias("radius")).join(centred.select("root", "centre"), "root"), "spans")
    sized = spans.join(spans.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"), F.count(F.lit(1)).alias("all"))
                       .filter(F.col("all") > 1), key)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own, member = F.pmod(F.xxhash64("root"), F.col("parts")), F.struct("root", "centre", "radius")
    rows = sized.withColumn("i", own).withColumn("j", each("parts"))
    columns = sized.withColumn("j", own).withColumn("i", each("parts"))
    near = kept(
        rows.groupBy(*key, "i", "j").agg(F.collect_list(member).alias("left"))
        .join(columns.groupBy(*key, "i", "j").agg(F.collect_list(member).alias("right")), [*key, "i", "j"])
        .select("left", "right").mapInArrow(_close_centres(angle), "a long, b long"), "close-components")
    if near.isEmpty():
        return None
    both = near.select("a", "b", F.col("a").alias("root"), F.col("b").alias("far")).union(
        near.select("a", "b", F.col("b").alias("root"), F.col("a").alias("far")))
    far = both.join(spans.select(F.col("root").alias("far"), F.col("centre").alias("beyond"), "radius"), "far")
    reach = F.cos(F.least(F.lit(math.pi), F.col("radius") + angle + 1e-6))
    sides = kept(placed.select("root", "node", "n", "vec", "unit").join(far, "root").filter(
        (F.col("radius") >= math.pi - 1e-6) | (_inner("unit", "beyond") >= reach - 1e-9)).select("a", "b", "root", "node", "n", "vec"), "facing")
    left = F.col("root") == F.col("a")
    counts = sides.groupBy("a", "b").agg(F.ceil(F.count(F.when(left, 1)) / block).alias("lefts"),
                                         F.ceil(F.count(F.when(~left, 1)) / block).alias("rights")).filter("lefts > 0 and rights > 0")
    dealt, own, member = sides.join(counts, ["a", "b"]), F.xxhash64("node"), F.struct("node", "n", "vec")
    lefts = dealt.filter(left).withColumn("i", F.pmod(own, F.col("lefts"))).withColumn("j", each("rights"))
    rights = dealt.filter(~left).withColumn("j", F.pmod(own, F.col("rights"))).withColumn("i", each("lefts"))
    blocks = lefts.groupBy("a", "b", "i", "j").agg(F.collect_list(member).alias("left")).join(
        rights.groupBy("a", "b", "i", "j").agg(F.collect_list(member).alias("right")), ["a", "b", "i", "j"])
    return kept(blocks.select("a", "b", "left", "right").mapInArrow(
        _score_across(threshold), "node long, links long, other long"), "across")


def _saturated_links(dense: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links): links among the saturated nodes (node, root, vec, n) of each component."""
    unit = dense.withColumn("unit", _unit_column())
    centre, inner = _centres(unit), _inner("unit", "centre")
    length = F.sqrt(_inner("centre", "centre"))
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    # the hash is the node's place among the blocks
    placed = kept(unit.join(centre, "root").select(
        "node", "root", "n", "vec", (F.coalesce(inner / F.nullif(length, F.lit(0.0)), F.lit(0.0)) >= half).alias("core")), "dense")
    totals = kept(placed.groupBy("root").agg(
        F.sum(F.when(F.col("core"), F.col("n"))).alias("weight"), F.count(F.lit(1)).alias("all"),
        F.count(F.when(~F.col("core"), 1)).alias("shell")), "dense-totals")
    counted = placed.filter("core").join(totals, "root").select("node", (F.col("weight") - F.col("n")).alias("links"))
    if totals.filter("shell > 0").isEmpty():
        return counted
    sized = placed.join(totals.filter("shell > 0").select(
        "root", F.ceil(F.col("shell") / block).alias("lefts"), F.ceil(F.col("all") / block).alias("rights")), "root")
    own = F.xxhash64("node")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = sized.filter(~F.col("core")).withColumn("i", F.pmod(own, F.col("lefts"))).withColumn("j", each("rights"))
    right = sized.withColumn("j", F.pmod(own, F.col("rights"))).withColumn("i", each("lefts"))
    member = F.struct("node", "n", "core", "vec")
    sides = left.groupBy("root", "i", "j").agg(F.collect_list(member).alias("left")).join(
        right.groupBy("root", "i", "j").agg(F.collect_list(member).alias("right")), ["root", "i", "j"])
    scored = sides.select("left", "right").mapInArrow(_score(threshold), "node long, links long")
    return counted.union(scored).groupBy("node").agg(F.sum("links").alias("links"))


def _brute(queries: list[tuple], threshold: float):
    """Weighted count of the links of each query, over the nodes of a task; one matrix product for each label and length."""
    asked: dict[tuple, list] = {}
    for q, label, vec in queries:
        asked.setdefault((label, len(vec)), []).append((q, vec))
    sides = {key: (np.array([q for q, _ in part]), _unit(np.array([v for _, v in part]))) for key, part in asked.items()}

    def run(batches):
        sums = {key: np.zeros(len(ids), np.int64) for key, (ids, _) in sides.items()}
        for batch in batches:
            labels, vecs = np.array(batch.column("label").to_pylist(), object), batch.column("vec")
            nodes, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            sizes, values = np.diff(vecs.offsets.to_numpy()), vecs.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for (label, dim), (ids, unit) in sides.items():
                rows = np.flatnonzero((labels == label) & (sizes == dim))
                for at in range(0, len(rows), STRIP):
                    part = rows[at:at + STRIP]
                    x = _unit(values[starts[part][:, None] + np.arange(dim)])
                    hit = (unit @ x.T >= threshold) & (ids[:, None] != nodes[part])
                    sums[label, dim] += hit @ weight[part]
        for key, (ids, _) in sides.items():
            yield pa.RecordBatch.from_pydict({"node": pa.array(ids), "links": pa.array(sums[key])})

    return run


@dataclass(frozen=True)
class Audit:
    """Lower average share of links found, nodes looked at, those among them with links, and whether that is enough."""

    share: float
    looked: int
    linked: int
    sound: bool


def audit(nodes: DataFrame, links: DataFrame, threshold: float, few: int = K, enough: int = ENOUGH,
          steps: tuple[int, ...] = AUDIT) -> Audit:
    """Compares nodes, the first by hash, with all others: the average share of a node's links that are in `links`.

    Nodes without links say nothing, so more are looked at until `enough` have links. Nodes of up to `few` links are
    also averaged apart, and the lower average counts, so that neither large groups hide the loss of small ones nor
    the other way round. It is sound if `enough` nodes had links or all nodes were looked at.
    """
    total, result = nodes.count(), Audit(1.0, 0, 0, True)
    for step in steps if total else ():
        picked = first_by_hash(nodes.select("node", "label", "vec"), ["node"], step).collect()
        queries = [(r["node"], r["label"], list(r["vec"])) for r in picked]
        truth = nodes.select("node", "label", "vec", "n").mapInArrow(
            _brute(queries, threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).filter("links > 0")
        share = F.least("links", F.coalesce("found", F.lit(0))) / F.col("links")
        mean, mean_few, linked = truth.join(links.select("node", F.col("links").alias("found")), "node", "left").agg(
            F.avg(share), F.avg(F.when(F.col("links") <= few, share)), F.count(F.lit(1))).first()
        result = Audit(min([1.0, *[x for x in (mean, mean_few) if x is not None]]), len(queries), linked,
                       linked >= enough or len(queries) >= total)
        if result.sound:
            break
    return result


def _weighted_links(nodes, lists, threshold, k, block):
    """(node, links) and the components, from lists at one stage."""
    over = lists.filter(F.col("sim") >= threshold)
    high, low = F.greatest("node", "nb").alias("a"), F.least("node", "nb").alias("b")
    edges = kept(over.select(high, low).distinct(), "edges")
    roots = kept(components(edges), "roots")
    full = kept(over.groupBy("node").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= k).select("node"), "saturated")
    weights = nodes.select("node", "n")
    both = edges.union(edges.select("b", "a")).toDF("node", "nb")
    flagged = both.join(full.withColumn("f", F.lit(1)), "node", "left").join(
        full.select(F.col("node").alias("nb"), F.lit(1).alias("g")), "nb", "left")
    listed = flagged.filter(F.col("f").isNull() | F.col("g").isNull()).join(
        weights.select(F.col("node").alias("nb"), "n"), "nb").groupBy("node").agg(F.sum("n").alias("links"))
    dense = full.join(nodes.select("node", "label", "vec", "n"), "node").join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "label", "vec", "n")
    links = listed.union(_saturated_links(dense.drop("label"), threshold, block))
    across = _links_across(dense, threshold, block)
    if across is not None:
        links = links.union(across.filter("other < 0").select("node", "links"))
        joins = across.filter("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b"))
        roots = kept(components(edges.union(joins)), "roots-across")
    return kept(links.groupBy("node").agg(F.sum("links").alias("links")), "links"), roots


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, k: int = K, tables: int = TABLES, block: int = BLOCK,
                    recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `table`.

    Rows are compared if their labels are equal and their vectors equally long. A vector that is null,
    empty, zero or holds null or non-finite components, or has no label or no id, links with nothing; a
    row without id has a null component and is not kept. Repeated rows link with each other. Extra columns
    are ignored; an empty table gives an empty result.
    """
    single = table.schema[vector].dataType == ArrayType(FloatType())
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
                        F.col(vector).cast("array<float>" if single else "array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    usable = good & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    nodes = kept(
        rows.filter(usable).groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    lists = kept(_top(_first_lists(nodes, k, tables, block, 0).withColumn("new", F.lit(1)), k), "lists")
    over = F.col("sim") >= threshold
    reached, round_ = 0, 0
    while True:
        while True:
            lists = _descend(nodes, lists, k)
            now, new = lists.filter(over).agg(F.count(F.lit(1)), F.sum("new")).first()
            if (new or 0) <= 0.001 * now:
                break
        links, roots = _weighted_links(nodes, lists, threshold, k, block)
        told = audit(nodes, links, threshold)
        share = told.share
        round_ += 1
        if told.sound and share >= recall:
            break
        if not told.sound or round_ >= ROUNDS or (round_ > 1 and share <= reached):
            # too few links to tell, or the descent does not get there
            lists = _exact_lists(nodes, k, EXACT_BLOCKS * block)
            links, roots = _weighted_links(nodes, lists, threshold, k, block)
            break
        # more first neighbours where the descent has stopped too early
        reached = share
        lists = kept(_top(lists.select("node", "nb", "sim", F.lit(0).alias("new")).union(
            _first_lists(nodes, k, tables, block, round_).withColumn("new", F.lit(1))), k), "lists")
    rooted = nodes.join(roots, "node", "left").select("node", "label", "vec", "first", "n", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component"))
    answer = rooted.join(ids, "root").join(links, "node", "left").select(
        "label", "vec", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    found = rows.filter(usable).join(answer, ["label", "vec"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
