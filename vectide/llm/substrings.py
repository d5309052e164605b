"""Removal of repeated passages by prefix-partitioned suffix trees over words.

A suffix is a word position with the words that follow it; `length` words in blocks of equal size are its
letters. Suffixes that start alike meet in one partition: they are dealt by a prefix of one block, and a
prefix with too many suffixes is made longer, block by block, until its group fits. There the suffixes are
ordered, which lays out the subtree from left to right: common prefixes of neighbours are its internal
nodes. A node as deep as `length` words is a passage that occurs more than once; the leaves below it that
belong to later documents mark the words to remove, and runs of marks are the maximal repeats.

Most suffixes need not travel. A window of `length` words contains `length - GRAM + 1` runs of GRAM words;
the least hash of these is its anchor, and equal windows have equal anchors. Neighbouring windows with one
anchor form a stretch. A stretch whose words also occur as a stretch of an earlier document is marked as a
whole; of equal stretches the first document's stands for all, and its suffixes are dealt out only if its
anchor has different stretches too, which happens where copies begin, end or differ.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from vectide.llm.chunks import CHUNK_BYTES, chunked
from vectide.llm.shared import kept

LENGTH = 50
BLOCK = 10
GRAM = 10
# Suffixes that may share a prefix before it is made longer.
GROUP = 200_000

_SCAN = pa.schema([("chunk", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("payload", pa.binary()),
                   ("anchor", pa.int64()), ("stretch", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
SCAN = ("chunk long, row int, doc_id long, payload binary, anchor long, stretch long, low long, high long")
_FACTOR = 0xD6E8FEB86659FD93


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place; shorter by n - 1."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(_FACTOR) + words[i:len(words) - n + 1 + i]
    return _mixed(out)


def _word_hashes(texts: list[bytes]) -> tuple[list[int], np.ndarray]:
    """Words of each text, and the hashes of all words."""
    known, sizes, out = _Hashes(), [], []
    for text in texts:
        words = text.split()
        sizes.append(len(words))
        out.append(np.array([known[w] for w in words], np.uint64))
    return sizes, np.concatenate(out) if out else np.empty(0, np.uint64)


def _places(sizes: list[int], length: int) -> np.ndarray:
    """Where windows start, in the row of all words."""
    ends = np.cumsum(sizes)
    return np.concatenate([np.empty(0, np.int64)] + [
        np.arange(end - size, end - length + 1) for size, end in zip(sizes, ends.tolist()) if size >= length])


def _anchors(words: np.ndarray, starts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Hash of each window's anchor; windows that cross documents are not asked for."""
    if not len(starts):
        return np.empty(0, np.uint64)
    least, reach, need = _runs(words, gram), 1, length - gram + 1
    while reach < need:  # minimum over ever longer stretches
        step = min(reach, need - reach)
        least = np.minimum(least[:len(least) - step], least[step:])
        reach += step
    return least[starts]


def _stretches(words: np.ndarray, sizes: list[int], length: int, gram: int):
    """Of each stretch: its row, the window starts [begin, end) in the row of all words, anchor and hash."""
    starts = _places(sizes, length)
    found = _anchors(words, starts, length, gram)
    owner = np.repeat(np.arange(len(sizes)), sizes)[starts]
    change = np.ones(len(found), bool)
    change[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(change)
    begin = starts[at]
    end = starts[np.append(at[1:], len(starts)) - 1] + 1 if len(at) else begin
    # sums of words by powers of the factor; the inverse powers take the place out again
    powers = np.ones((2, len(words) + 1), np.uint64)
    for line, factor in zip(powers, (_FACTOR, pow(_FACTOR, -1, 1 << 64))):
        line[1:] = np.multiply.accumulate(np.full(len(words), factor, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[0, :-1], dtype=np.uint64)])
    stop = end + length - 1
    stretch = _mixed((sums[stop] - sums[begin]) * powers[1, begin] + (stop - begin).astype(np.uint64))
    return owner[at], begin, end, found[at], stretch


def _scan(length: int, gram: int, limit: int):
    """Each document's text, and each chunk's different stretches with their smallest and largest document."""

    def run(batches):
        for chunk, rows in chunked(batches, ["doc_id", "text"], "text", limit):
            for at in range(0, len(rows), 1000):
                part = rows[at:at + 1000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * n, pa.int64()), pa.array(range(at, at + n), pa.int32()),
                    pa.array([doc_id for doc_id, _ in part], pa.int64()),
                    pa.array([_pack(text or b"") for _, text in part], pa.binary()),
                    *[pa.nulls(n, pa.int64())] * 4], schema=_SCAN)
            sizes, words = _word_hashes([text or b"" for _, text in rows])
            owner, _, _, anchor, stretch = _stretches(words, sizes, length, gram)
            ids = [doc_id for doc_id, _ in rows]
            has = np.array([i is not None for i in ids])[owner]
            doc, anchor, stretch = np.array([i or 0 for i in ids], np.int64)[owner][has], anchor[has], stretch[has]
            order = np.lexsort((doc, stretch, anchor))
            doc, anchor, stretch = doc[order], anchor[order], stretch[order]
            first = np.ones(len(doc), bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])
            last = np.roll(first, -1)
            n = int(first.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, chunk, np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.binary()), pa.array(anchor[first].view(np.int64)), pa.array(stretch[first].view(np.int64)),
                pa.array(doc[first]), pa.array(doc[last])], schema=_SCAN)

    return run


_SUFFIX = pa.schema([("chunk", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("payload", pa.binary()),
                     ("letters", pa.list_(pa.int64()))])
SUFFIX = "chunk long, place long, doc_id long, payload binary, letters array<long>"


def _spread(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, in order."""
    size = end - begin
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _suffixes(length: int, block: int, gram: int):
    """The suffixes that a chunk must deal out, and a state row: marked stretches and those dealt out."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending")])
        is_text = table["row"].is_valid()
        rows, known = table.filter(is_text), table.filter(pc.invert(is_text))
        if not len(known):
            return _SUFFIX.empty_table()
        ids = rows["doc_id"].to_pylist()
        sizes, words = _word_hashes([_unpack(p) for p in rows["payload"].to_pylist()])
        owner, begin, end, anchor, stretch = _stretches(words, sizes, length, gram)
        a, r = (known[c].to_numpy().view(np.uint64) for c in ("anchor", "stretch"))
        key = _mixed(a) + r
        order = np.argsort(key)
        spot = order[np.minimum(np.searchsorted(key[order], _mixed(anchor) + stretch), len(key) - 1)]
        has = (a[spot] == anchor) & (r[spot] == stretch) & np.array([i is not None for i in ids])[owner]
        owner, begin, end, spot = owner[has], begin[has], end[has], spot[has]
        docs, first = np.array([i or 0 for i in ids], np.int64)[owner], known["first"].to_numpy()[spot]
        marked = first < docs
        dealt = ~marked & known["open"].to_numpy(zero_copy_only=False)[spot]
        shift = (np.cumsum(sizes) - sizes)[owner]
        state = [np.stack([owner[s], (begin - shift)[s], (end - shift)[s]]) for s in (marked, dealt)]
        chunk = table["chunk"][0].as_py()
        head = np.array([state[0].shape[1], state[1].shape[1]], np.int64)
        state_row = pa.table([[chunk], [None], [None], [_pack(b"".join(x.astype(np.int64).tobytes() for x in (head, *state)))],
                              [None]], schema=_SUFFIX)
        starts = _spread(begin[dealt], end[dealt])
        n, letters = len(starts), length // block
        blocks = _runs(words, block)
        flat = np.stack([blocks[starts + at].view(np.int64) for at in range(0, length, block)], axis=1).reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * letters, letters, dtype=np.int32)), pa.array(flat))
        return pa.concat_tables([state_row, pa.table([
            pa.array(np.full(n, chunk, np.int64)), pa.array(np.arange(n)),
            pa.array(np.repeat(docs[dealt], (end - begin)[dealt])), pa.nulls(n, pa.binary()), lists], schema=_SUFFIX)])

    return run


def _deep_leaves(depth: int):
    """Leaves under the nodes of full depth that belong to a later document than the node's first leaf.

    Rows come in the order of their suffixes, so a subtree is a run of rows and the common prefix of
    neighbours is the depth of the node between them; only the open node is carried on.
    """

    def run(batches):
        node, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            letters = np.stack([batch.column(f"l{n}").to_numpy() for n in range(depth)])
            docs = batch.column("doc_id").to_numpy()
            common = np.cumprod(letters[:, 1:] == letters[:, :-1], axis=0).sum(axis=0) if batch.num_rows > 1 else []
            opens = np.concatenate([[node is None or (letters[:, 0] != node).any()], np.asarray(common) < depth])
            begin = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), -1))
            firsts = np.where(begin >= 0, docs[begin], docs[0] if first is None else first)
            node, first = letters[:, -1].copy(), firsts[-1]
            yield batch.select(["chunk", "place"]).filter(pa.array(docs > firsts))

    return run


def _longer_prefixes(suffixes: DataFrame, depth: int, group: int) -> DataFrame:
    """Adds `prefix`, the hash of as many letters as keep its group within `group` suffixes."""
    rows = suffixes.withColumn("prefix", F.xxhash64("l0"))
    for n in range(1, depth):
        large = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group)
        large = kept(large.select("prefix", F.lit(True).alias("large")), "large-prefixes")
        if large.isEmpty():
            break
        longer = F.xxhash64(*[f"l{i}" for i in range(n + 1)])
        rows = rows.join(large, "prefix", "left").withColumn(
            "prefix", F.when(F.col("large"), longer).otherwise(F.col("prefix"))).drop("large")
    return rows


def _marked(table: pa.Table, length: int):
    """(doc_id, words, mask of the words that are repeats) of each document of a chunk."""
    table = table.sort_by([("row", "ascending")])
    rows = table.filter(table["row"].is_valid())
    states = [p for p, r in zip(table["payload"].to_pylist(), table["row"].to_pylist()) if r is None and p is not None]
    hits = table.filter(table["place"].is_valid())["place"].to_numpy()
    docs = list(zip(rows["doc_id"].to_pylist(), [_unpack(p).split() for p in rows["payload"].to_pylist()]))
    marks = [[] for _ in docs]
    if states:
        data = np.frombuffer(_unpack(states[0]), np.int64)
        n, m = data[:2].tolist()
        marked, dealt = data[2:2 + 3 * n].reshape(3, n), data[2 + 3 * n:].reshape(3, m)
        owner = np.concatenate([np.repeat(marked[0], marked[2] - marked[1]),
                                np.repeat(dealt[0], dealt[2] - dealt[1])[hits]])
        place = np.concatenate([_spread(marked[1], marked[2]), _spread(dealt[1], dealt[2])[hits]])
        order = np.argsort(owner, kind="stable")
        owner, place = owner[order], place[order]
        for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
            if len(part):
                marks[owner[part[0]]] = place[part]
    for (doc_id, words), starts in zip(docs, marks):
        mask = np.zeros(len(words) + 1, np.int64)
        if len(starts):
            np.add.at(mask, starts, 1)
            np.add.at(mask, starts + length, -1)
        yield doc_id, words, np.cumsum(mask)[:-1] > 0


def _digests(length: int):
    def run(table: pa.Table) -> pa.Table:
        out = []
        for doc_id, words, gone in _marked(table, length):
            left = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
            out.append((doc_id, len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                            ("kept_sha256", pa.string())])
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return run


def _spans(length: int):
    def run(table: pa.Table) -> pa.Table:
        ids, texts, spans = [], [], []
        for doc_id, words, gone in _marked(table, length):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
            ids.append(doc_id)
            texts.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
            spans.append([{"start": a, "end": b} for a, b in edges.tolist()])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "kept": pa.array(texts, pa.string()),
                         "repeats": pa.array(spans, kind)})

    return run


def _run(docs, id_col, text_col, length, group, chunk_bytes, finish, schema):
    if length % BLOCK or length < GRAM:
        raise ValueError(f"length must be a multiple of {BLOCK}")
    depth = length // BLOCK
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    scanned = kept(rows.mapInArrow(_scan(length, GRAM, chunk_bytes), SCAN), "scanned")
    texts = scanned.filter(F.col("row").isNotNull()).select("chunk", "row", "doc_id", "payload")
    stretches = scanned.filter(F.col("anchor").isNotNull()).select("chunk", "anchor", "stretch", "low", "high")
    classes = stretches.groupBy("anchor", "stretch").agg(F.min("low").alias("first"), F.max("high").alias("last"))
    twice = classes.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("first").alias("a"), F.max("last").alias("b")).filter("a < b").select(
        "anchor", (F.col("n") > 1).alias("open"))
    shared = kept(classes.join(twice, "anchor").filter(F.col("open") | (F.col("first") < F.col("last"))).select(
        "anchor", "stretch", "first", "open"), "shared-stretches")
    wanted = stretches.select("chunk", "anchor", "stretch").join(shared, ["anchor", "stretch"])
    both = texts.unionByName(wanted, allowMissingColumns=True)
    found = kept(both.groupBy("chunk").applyInArrow(_suffixes(length, BLOCK, GRAM), SUFFIX), "suffixes")
    suffixes = found.filter(F.col("place").isNotNull()).select(
        "chunk", "place", "doc_id", *[F.col("letters")[n].alias(f"l{n}") for n in range(depth)])
    letters = [f"l{n}" for n in range(depth)]
    dealt = _longer_prefixes(suffixes, depth, group).repartition("prefix").sortWithinPartitions(*letters, "doc_id")
    hits = dealt.mapInArrow(_deep_leaves(depth), "chunk long, place long")
    states = found.filter(F.col("payload").isNotNull()).select("chunk", "payload")
    parts = texts.withColumn("place", F.lit(None).cast("long")).unionByName(
        states, allowMissingColumns=True).unionByName(hits, allowMissingColumns=True)
    return parts.groupBy("chunk").applyInArrow(finish(length), schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            group: int = GROUP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, kept (the words left, joined by one blank), repeats (maximal runs of removed words, end exclusive).

    A word goes if a window of `length` words of its document that covers it also starts in a document
    with a smaller id. Rows that share an id count as one document and never remove each other's words;
    rows without id lose nothing and remove nothing. Null and empty texts have no words. Extra columns
    are ignored; an empty table gives an empty result.
    """
    return _run(docs, id_col, text_col, length, group, chunk_bytes, _spans,
                "doc_id long, kept string, repeats array<struct<start:int,end:int>>")


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   group: int = GROUP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """As `repeats`: doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return _run(docs, id_col, text_col, length, group, chunk_bytes, _digests,
                "doc_id long, n_words long, n_removed long, kept_sha256 string")
