"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A covering family of bit masks replaces random sampling: bit i gets a vector phi(i) of radius + 1 bits,
and mask v keeps the bits whose phi has odd overlap with v. The bits in which two fingerprints within the
radius differ span at most `radius` dimensions, so some v other than zero overlaps none of them oddly:
the pair agrees on that mask and meets in its table, always.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vectide.llm.components import components
from vectide.llm.shared import kept, null_safe, text_key

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
# Fingerprints that one task compares at once; larger buckets are split by further masks, not cut.
BUCKET = 512
# Fingerprints of a task that writes them into all tables.
TABLE_ROWS = 16_384


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes, as an unsigned integer; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly the blanks 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 14):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + (1 << 14)], ends[at:at + (1 << 14)])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(t or b"") for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(prints.view(np.int64))],
            names=["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp) for every row; a null text counts as empty, fp is a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"),
                       F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_key long, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit numbers of which every set of `radius` bits misses at least one."""
    classes = (1 << (radius + 1)) - 1
    # unit vectors first: with more than `radius` bits no mask is empty
    phi = sorted(range(1, classes + 1), key=lambda v: (v.bit_count() > 1, v))
    masks = [0] * classes
    for n, bit in enumerate(bits):
        for v in range(1, classes + 1):
            if (phi[n % classes] & v).bit_count() % 2:
                masks[v - 1] |= 1 << bit
    return masks


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _forest(radius: int):
    """Spanning links of each bucket: a member and the smallest member it is connected with."""

    def run(batches):
        for batch in batches:
            left, right = [], []
            for members in batch.column("members").to_pylist():
                x = np.unique(np.array(members, np.int64))
                near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
                root = np.arange(len(x))
                while True:
                    new = np.where(near, root[None, :], len(x)).min(axis=1)
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                moved = root != np.arange(len(x))
                left.append(x[moved])
                right.append(x[root[moved]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.empty(0, np.int64), *side])) for side in (left, right)],
                names=["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect exactly the distinct `fp` values within `radius` bits of each other.

    Buckets of two come straight out of a partial aggregate (their minimum and maximum). Buckets up to
    `bucket` become one bounded list and give a spanning forest, never all pairs. Larger ones are hashed
    again by covering masks over the bits their table had left out, where all differences must lie; each
    step halves those bits, and with 2**m <= bucket for m bits left no bucket can be larger.
    """
    if bucket < 1 << radius:
        raise ValueError("bucket must be at least 2 ** radius")
    spark = prints.sparkSession
    tables = {str(n): mask for n, mask in enumerate(covering_masks(list(range(BITS)), radius))}
    # few bytes, but each row becomes many: dealt by the number of rows
    single = kept(prints.select("fp").distinct(), "distinct-fingerprints")
    single = single.repartition(max(1, -(-single.count() // TABLE_ROWS)), "fp")
    cells = single.select("fp", F.explode(F.array(*[
        F.struct(F.lit(name).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("k"))
        for name, mask in tables.items()])).alias("cell")).select("fp", "cell.t", "cell.k")
    found = None
    while True:
        counted = kept(
            cells.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
            .filter(F.col("n") > 1), "buckets")
        step = counted.filter(
            (F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
        if not counted.filter(F.col("n").between(3, bucket)).isEmpty():
            step = step.union(
                cells.join(counted.filter(F.col("n").between(3, bucket)).select("t", "k"), ["t", "k"])
                .groupBy("t", "k").agg(F.collect_list("fp").alias("members"))
                .select("members").mapInArrow(_forest(radius), "a long, b long"))
        found = step if found is None else found.union(step)
        large = counted.filter(F.col("n") > bucket).select("t", "k")
        names = [row["t"] for row in large.select("t").distinct().collect()]  # names of masks, not of buckets
        if not names:
            return found
        inner = {}
        for name in names:
            free = [bit for bit in range(BITS) if not tables[name] >> bit & 1]
            inner |= {f"{name}.{n}": (name, tables[name] | mask) for n, mask in enumerate(covering_masks(free, radius))}
        tables = {name: mask for name, (_, mask) in inner.items()}
        masks = spark.createDataFrame(
            [(old, name, _signed(mask)) for name, (old, mask) in inner.items()], "t string, new string, mask long")
        split = kept(cells.join(large, ["t", "k"]).select("t", "fp"), "large-buckets")
        cells = split.join(F.broadcast(masks), "t").select(
            "fp", F.col("new").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS) -> DataFrame:
    """doc_id, text_key, fingerprint (16 hex digits), component_id (smallest doc_id of the group).

    One row per input row, repeated rows included. Empty and null texts have fingerprint zero and form a
    group like any other. Rows without doc_id take part and keep a null id; component_id is null only if
    no row of the group has an id. Extra columns are ignored; an empty table gives an empty result.
    """
    prints = kept(fingerprints(docs, id_col, text_col), "fingerprints")
    # a fingerprint as a node that sorts by its first document, so that a group's root names the group
    node = F.struct(F.col("first").isNull().alias("none"), "first", "fp")
    firsts = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", "first", node.alias("node")), "first-documents")
    links = near_links(prints, radius)
    for side in ("a", "b"):
        links = links.join(firsts.select(F.col("fp").alias(side), F.col("node").alias(f"{side}_node")), side)
    groups = components(links.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    named = firsts.select("fp", "first").join(groups.select("node.fp", F.col("root.first").alias("root")), "fp", "left").select(
        "fp", F.coalesce("root", "first").alias("component_id"))
    return prints.join(named, "fp").select(
        "doc_id", "text_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id, with all its columns.

    Ties and repeated rows: one of them stays. A row without id stays only where its group has no id. Null and empty
    texts are one group. An empty table gives an empty result; other columns stay as they are.
    """
    return keep_first(docs, near_duplicates(docs, id_col, text_col, radius), id_col, text_col)


def keep_first(docs: DataFrame, group: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are the first of their group; `group` has doc_id, text_key, fingerprint, component_id.

    Of rows that share the id the one with the smallest hash of its text is the first, of equal rows any one. Groups whose
    rows all lack an id are told apart by their fingerprint. Other columns stay as they are.
    """
    # a group whose rows all lack an id is told by its fingerprint
    whole = F.struct(F.col("component_id").alias("c"),
                     F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f"))
    rows = group.groupBy(whole.alias("g"), "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    rows = kept(rows, "groups")
    first = rows.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("m"))
    stay = F.col("m.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("m.text_key") == F.col("text_key"))
    judged = kept(null_safe(rows.select("g.c", "g.f", "doc_id", "text_key", "n"),
                            first.select("g.c", "g.f", "m"), ["c", "f"]), "judged")
    go = judged.filter(~stay).select(F.col("doc_id").alias("__go_id"), F.col("text_key").alias("__go_key")).distinct()
    keyed = docs.withColumn("__key", text_key(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__go_id")) & (F.col("__key") == F.col("__go_key"))
    left = keyed.join(go.hint("shuffle_hash"), same, "left_anti")
    repeats = judged.filter(stay & (F.col("n") > 1)).select(
        F.col("doc_id").alias("__go_id"), F.col("text_key").alias("__go_key"))
    if not repeats.isEmpty():
        again = left.join(repeats, same, "left_semi").dropDuplicates([id_col, "__key"])
        left = left.join(repeats, same, "left_anti").unionByName(again)
    return left.drop("__key")
