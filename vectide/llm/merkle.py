"""Merkle manifest of a table of documents, by lag and lead windows.

Leaves are numbered within their group and cut into blocks of 2 ** LEVELS. A block is one window partition, and
LEVELS levels are built in it: a node lives on the row of its first leaf, so at level k its sibling stands 2 ** k
rows before or after it, a fixed offset. Slot and run length say which of the two there is; the row of the
first child hashes the parent. The nodes that end a pass are the leaves of the next one, over a table 2 ** LEVELS
times smaller; the subroots of all groups then form one last tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vectide.llm.shared import kept

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
# Levels built in one shuffle; a window partition holds 2 ** LEVELS rows of about 300 bytes.
LEVELS = 10
# One document in about this many is folded from a changed copy.
TAMPER_EVERY = 7


def sha(*parts: Column) -> Column:
    """A leaf hashes its fields, a node the hex digests of its children, side by side."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    return sha(*[framed(changed.get(name, F.col(name))) for name in FIELDS])


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `pos`, the number from 0 in the order of `order` within `group`, and `n`, the group's rows.

    Rows are dealt by ranges of (group, order), equal ones by a running number too, so no group and no run of
    equal rows is one task. A summary of one row per group and range gives each range its first number.
    """
    # the running number only spreads equal rows; they take consecutive positions, whichever first
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "__tie")
    ranged = ranged.sortWithinPartitions(group, *order, "__tie").drop("__tie")
    placed = kept(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    ends = placed.groupBy(group, part.alias("__part")).agg(F.count(F.lit(1)).alias("rows"), F.min("__at").alias("first"))
    whole = Window.partitionBy(group)
    chain = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(
        F.col(group).alias("__g"), F.col("__part").alias("__p"), F.sum("rows").over(whole).alias("n"),
        (F.coalesce(F.sum("rows").over(chain), F.lit(0)) - F.col("first")).alias("__shift"))
    return placed.join(starts, (F.col(group) == F.col("__g")) & (part == F.col("__p"))).withColumn(
        "pos", F.col("__at") + F.col("__shift")).drop("__at", "__g", "__p", "__shift")


def build_levels(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """`nodes` (g, pos, n, h, more columns) with `block`, `siblings`, and `top` on the rows that begin a block.

    `n` counts the nodes of the group. `siblings` lists for each of the `levels` levels the digest that the row's
    node of that level stands beside: null where the group has no such level any more, empty where its run has
    no other. `top` is the block's node after `levels` levels.
    """
    rows = nodes.withColumn("block", F.shiftright("pos", levels)).withColumn("h0", F.col("h"))
    window = Window.partitionBy("g", "block").orderBy("pos")
    to_here = window.rowsBetween(Window.unboundedPreceding, 0)
    found = []
    for k in range(levels):
        step = 1 << k
        first = F.col("pos").bitwiseAND(F.lit(step - 1)) == 0  # rows that carry a node of this level
        odd = F.col("pos").bitwiseAND(F.lit(step)) != 0  # slot of that node in its run of two
        alone = ~odd & (F.col("pos") + F.lit(step) >= F.col("n"))  # a last run of one
        rising = F.col("n") > F.lit(step)  # more than one node on this level
        here = F.col(f"h{k}")
        before, after = F.lag(here, step).over(window), F.lead(here, step).over(window)
        rows = rows.withColumn(f"__s{k}", F.when(
            first & rising, F.when(odd, before).when(alone, F.lit("")).otherwise(after)))
        rows = rows.withColumn(f"h{k + 1}", F.when(
            first & ~odd, F.when(rising, sha(here, F.col(f"__s{k}"))).otherwise(here)))
        found.append(f"__s{k}")
    # all rows below a node take what its first row found
    beside = F.array(*[F.last(F.col(name), ignorenulls=True).over(to_here) for name in found])
    return rows.withColumn("siblings", beside).withColumn("top", F.col(f"h{levels}")).drop(
        *found, *[f"h{k}" for k in range(levels + 1)])


def folded(start: Column, pos: Column, path: Column) -> Column:
    """The digest that `start` at `pos` grows into beside the siblings of `path`, level by level."""
    return F.aggregate(
        F.transform(path, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), start,
        lambda h, x: F.when(x["s"].isNull(), h)
        .when(F.getbit(pos, x["k"]) == 1, sha(x["s"], h)).otherwise(sha(h, x["s"])))


def tree(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (g, root) of all groups, and the tables of each pass from the leaves up, as `build_levels` gives them.

    `leaves` has g, pos, n, h. The number of passes is a logarithm of the largest group; each pass is written.
    """
    passes, now = [], leaves
    while True:
        done = kept(build_levels(now, levels), "merkle-pass")
        passes.append(done)
        tops = done.filter(F.col("top").isNotNull()).select(
            "g", F.col("block").alias("pos"), F.shiftright(F.col("n") + F.lit((1 << levels) - 1), levels).alias("n"),
            F.col("top").alias("h"))
        if tops.filter(F.col("n") > 1).isEmpty():
            return tops.select("g", F.col("h").alias("root")), passes
        now = tops


def paths(passes: list[DataFrame], top: DataFrame | None = None) -> DataFrame:
    """The leaves of a tree with `path`, all siblings up to the root: bit k of `pos` is the slot beside path[k].

    `top` (g, more columns) is joined to the last pass, where a group has few rows, and handed down by block;
    no join has more than a block of rows to a key.
    """
    above = passes[-1].withColumn("path", F.col("siblings"))
    if top is not None:
        above = above.join(top, "g")
    more = [c for c in top.columns if c != "g"] if top is not None else []
    for nodes in reversed(passes[:-1]):
        upper = above.select(F.col("g").alias("__g"), F.col("pos").alias("__pos"), F.col("path").alias("__path"), *more)
        above = nodes.join(upper, (F.col("g") == F.col("__g")) & (F.col("block") == F.col("__pos"))).withColumn(
            "path", F.concat("siblings", "__path")).drop("__g", "__pos", "__path")
    return above.drop("siblings", "block", "top")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of `docs`.

    A leaf hashes doc_id, source, lang, n_chars and text; other columns are ignored. Leaves of one lang in the
    order of doc_id (null first; rows of equal doc_id by their leaf) form a binary tree; its subroot is a leaf of
    the tree of all langs (null first, then by bytes). A lang that is null is a group of its own, apart from the
    empty one. Equal rows are leaves each. The proof of a document is tested on a copy with n_chars one higher
    where TAMPER_EVERY divides the CRC-32 of its decimal doc_id (never where either is null): `verified` is
    false there. An empty table gives an empty result.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    leaves = kept(docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("g"), F.col("doc_id"), leaf_hash().alias("h"),
        F.when(tampered & F.col("n_chars").isNotNull(), leaf_hash(n_chars=F.col("n_chars") + 1)).alias("changed")), "leaves")
    subroots, passes = tree(numbered(leaves, "g", ["doc_id", "h"]), levels)
    groups = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("lang"), F.col("root").alias("h")), "g", ["lang"])
    root, upper = tree(groups, levels)
    langs = paths(upper, root).select(
        F.col("lang").alias("g"), F.col("h").alias("subroot"), "root", F.col("pos").alias("lang_pos"),
        F.col("path").alias("lang_path"))
    rows = paths(passes, langs)
    grown = folded(folded(F.coalesce("changed", "h"), F.col("pos"), F.col("path")), F.col("lang_pos"), F.col("lang_path"))
    return rows.withColumn("folded_root", grown).select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root",
        F.sha2(F.concat(F.array_join("path", ""), F.array_join("lang_path", "")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
