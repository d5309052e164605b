"""Alignment of two tokenizers over a corpus, by white-space anchors and memoised windows.

Both tokenizers encode the whole text. Where a token of each ends at the same byte and the next token of each
begins with a blank, the text is cut: no token crosses such an anchor, so what lies between two anchors (a
window, in prose a word) is aligned for itself, once for each pair of id tuples in a chunk of documents. The
distinct windows of a chunk are laid end to end and aligned together: both sides cover the same bytes, so every
place where a token of either side ends closes one overlap, and every place where both end closes a group.

1. Tasks cut documents into chunks and write each document as positions of its windows, each distinct window
   as positions of the id pairs it links, and each distinct id pair with its count in the chunk. 2. Counts are
   summed over all chunks, and the highest of each B id is found, by plain aggregates. 3. The sums go back by
   (chunk, position), and each chunk adds up its windows, then its documents.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from vectide.llm.chunks import chunked
from vectide.llm.shared import kept

# Bytes of text whose windows one task holds at once.
CHUNK_BYTES = 8 << 20
# The split pattern of the byte-level tokenizer; fixed values of its format.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CODED = ("chunk long, kind string, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
         "place int, a int, b int, n long, payload binary")
_CODED = pa.schema([
    ("chunk", pa.int64()), ("kind", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("place", pa.int32()), ("a", pa.int32()),
    ("b", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 letters are their own
    byte, the other bytes are the letters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def load_a(path: str):
    """(text -> ids, bytes of each id) of a byte-level tokenizer's JSON file; special tokens are plain text.

    Where merges run in the order of ids, the faster library gets the same vocabulary as ranks; what it
    refuses (blanks by the hundred thousand) and files of another make go to the tokenizers library.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    slow = Tokenizer.from_str(json.dumps(spec))
    slow.encode_special_tokens = True
    slow.no_truncation()
    slow.no_padding()

    def by_library(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    letters, added = byte_letters(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocabulary = spec["model"]["vocab"]
    pieces = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
    for token, number in vocabulary.items():
        if token not in added:
            pieces[number] = bytes(letters[c] for c in token)
    before = spec.get("pre_tokenizer") or {}
    merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in spec["model"]["merges"]]
    if (spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
            or not before.get("use_regex", True) or merged != sorted(set(merged))):
        return by_library, pieces
    import tiktoken

    fast = tiktoken.Encoding("own", pat_str=SPLIT, special_tokens={},
                             mergeable_ranks={piece: n for n, piece in enumerate(pieces) if piece})

    def ids(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except BaseException as error:  # its panic is no Exception
            if type(error).__name__ != "PanicException":
                raise
            return by_library(text)

    return ids, pieces


def load_b(path: str):
    """(text -> ids, bytes of each id) of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(number) else piece.replace("▁", " ").encode())
    return lambda text: model.encode(text, num_threads=1), pieces


# Added to ids of B in a window's key, so that a key is one sequence of numbers that names both sides.
SHIFT = 1 << 24


class Names:
    """Decimal ids with what follows them in a list of groups."""

    def __init__(self, count_a: int, count_b: int):
        names = [str(n) for n in range(max(count_a, count_b))]
        self.a = np.array([[n + end for n in names[:count_a]] for end in ",|"], object)
        self.b = np.array([[n + end for n in names[:count_b]] for end in (",", ";", "")], object)


def align(keys: list[bytes], size_a: np.ndarray, size_b: np.ndarray, names: Names):
    """(groups as text, number of groups) of each window, and (a, b, window) of each link, by window.

    A key holds a window's ids of A, then its ids of B plus SHIFT, as 32-bit numbers. A group is the tokens
    between two places where both sides end a token; links are the pairs whose byte ranges overlap.
    """
    if not keys:
        return [], *[np.zeros(0, np.int64)] * 4
    flat = np.frombuffer(b"".join(keys), "<u4").astype(np.int64)
    window = np.repeat(np.arange(len(keys)), np.fromiter(map(len, keys), np.int64, len(keys)) // 4)
    side_a = flat < SHIFT
    a, b = flat[side_a], flat[~side_a] - SHIFT
    window_a, window_b = window[side_a], window[~side_a]
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    closes_a, closes_b = (x[np.searchsorted(x, y)] == y for x, y in ((end_b, end_a), (end_a, end_b)))
    ends = np.sort(np.concatenate([end_a, end_b[~closes_b]]), kind="stable")  # two sorted runs
    at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    last_b = np.append(window_b[1:] != window_b[:-1], True)
    words = np.concatenate([names.a[closes_a.astype(int), a], names.b[closes_b.astype(int) + last_b, b]])
    # tokens in the order group, side, place
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    words = words[order].tolist()
    stops = np.cumsum(np.bincount(window, minlength=len(keys))).tolist()
    texts = ["".join(words[x:y]) for x, y in zip([0, *stops], stops)]
    return texts, np.bincount(window_a, closes_a, len(keys)).astype(np.int64), a[at_a], b[at_b], window_a[at_a]


class _Places(dict):
    """Position of each distinct window, in the order in which windows are met."""

    def __missing__(self, key: bytes) -> int:
        self[key] = len(self)
        return self[key]


def anchors(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray,
            blank_a: np.ndarray, blank_b: np.ndarray) -> tuple[list[int], list[int]]:
    """Token numbers in A and in B at which windows begin: both tokens start at one byte, with a blank."""
    start_a, start_b = np.cumsum(size_a[a]) - size_a[a], np.cumsum(size_b[b]) - size_b[b]
    in_a, in_b = np.flatnonzero(blank_a[a]), np.flatnonzero(blank_b[b])
    _, x, y = np.intersect1d(start_a[in_a], start_b[in_b], assume_unique=True, return_indices=True)
    cut_a, cut_b = in_a[x].tolist(), in_b[y].tolist()
    if not cut_a or cut_a[0] or cut_b[0]:  # the first window begins with the text
        cut_a, cut_b = [0, *cut_a], [0, *cut_b]
    return cut_a, cut_b


def _pack(numbers: np.ndarray) -> bytes:
    """Low bytes of all numbers first: the high ones are mostly zero and pack away."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def _rows(columns: dict) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values() if not isinstance(v, (str, int)))
    return pa.RecordBatch.from_arrays([
        pa.nulls(n, field.type) if field.name not in columns else
        pa.repeat(pa.scalar(columns[field.name], field.type), n) if isinstance(columns[field.name], (str, int)) else
        pa.array(columns[field.name], field.type) for field in _CODED], schema=_CODED)


def _code(path_a: str, path_b: str, limit: int):
    def run(batches):
        encode_a, pieces_a = load_a(path_a)
        encode_b, pieces_b = load_b(path_b)
        size_a, size_b = (np.array([len(p) for p in pieces], np.int64) for pieces in (pieces_a, pieces_b))
        blank_a, blank_b = (np.array([p.startswith(b" ") for p in pieces]) for pieces in (pieces_a, pieces_b))

        def tokens(data: bytes | None):
            """Ids of A and B, or two empty lists where their bytes are not those of the text."""
            try:
                text = (data or b"").decode()
            except UnicodeDecodeError:
                return [], []
            if not text:
                return [], []
            whole, a, b = b" " + data, encode_a(" " + text), encode_b(text)
            same = b"".join(map(pieces_a.__getitem__, a)) == whole and b"".join(map(pieces_b.__getitem__, b)) == whole
            return (a, b) if same else ([], [])

        names = Names(len(pieces_a), len(pieces_b))
        for chunk, rows in chunked(batches, ["doc_id", "text"], "text", limit):
            places, spots, counts = _Places(), [], []
            for _, text in rows:
                a, b = tokens(text)
                counts.append((len(a), len(b)))
                if not a:
                    spots.append(np.zeros(0, np.uint32))
                    continue
                a, b = np.array(a, np.uint32), np.array(b, np.uint32)
                cut_a, cut_b = anchors(a, b, size_a, size_b, blank_a, blank_b)
                a, b = a.tobytes(), (b + np.uint32(SHIFT)).tobytes()
                cut_a, cut_b = [4 * x for x in cut_a], [4 * x for x in cut_b]
                spots.append(np.array([places[a[i:j] + b[k:m]] for i, j, k, m in zip(
                    cut_a, [*cut_a[1:], len(a)], cut_b, [*cut_b[1:], len(b)])], np.uint32))
            texts, groups, link_a, link_b, window = align(list(places), size_a, size_b, names)
            digests = [hashlib.sha256(";".join([texts[s] for s in part.tolist()]).encode()).hexdigest() if len(part) else ""
                       for part in spots]
            n_a, n_b = (np.array(c, np.int64) for c in zip(*counts))
            yield _rows({"chunk": chunk, "kind": "text", "doc_id": [i for i, _ in rows], "n_a": n_a, "n_b": n_b,
                         "n_groups": [int(groups[part].sum()) for part in spots], "groups_sha256": digests,
                         "payload": [_pack(part) for part in spots]})
            if places:
                pairs, links = np.unique(link_a << 32 | link_b, return_inverse=True)
                sizes = np.bincount(window, minlength=len(places))
                uses = np.bincount(np.concatenate(spots), minlength=len(places))
                count = np.bincount(links, uses[window], len(pairs)).astype(np.int64)  # exact below 2 ** 53
                yield _rows({"chunk": chunk, "kind": "windows", "payload": [
                    _pack(np.concatenate([[len(sizes)], sizes, links]))]})
                yield _rows({"chunk": chunk, "kind": "pair", "place": np.arange(len(pairs)), "n": count,
                             "a": pairs >> 32, "b": pairs & 0xFFFFFFFF})

    return run


def _finish(coded: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums of the corpus-wide counts over the links of each document of a chunk."""
    places = pairs.column("place").to_numpy()
    count, top = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    count[places], top[places] = pairs.column("count").to_numpy(), pairs.column("top").to_numpy()
    kinds = coded.column("kind").to_pylist()
    sums = best = np.zeros(0, np.int64)
    for kind, payload in zip(kinds, coded.column("payload")):
        if kind == "windows":
            numbers = _unpack(payload.as_py()).astype(np.int64)
            sizes, links = numbers[1:numbers[0] + 1], numbers[numbers[0] + 1:]
            starts = np.cumsum(sizes) - sizes  # every window has a link
            sums, best = np.add.reduceat(count[links], starts), np.add.reduceat(top[links], starts)
    docs = coded.filter(pa.array([kind == "text" for kind in kinds]))
    totals, bests = [], []
    for payload in docs.column("payload"):
        spots = _unpack(payload.as_py())
        totals.append(int(sums[spots].sum()) if len(spots) else 0)
        bests.append(int(best[spots].sum()) if len(spots) else 0)
    n_a, n_b, n_groups = (docs.column(c).to_numpy() for c in ("n_a", "n_b", "n_groups"))
    return pa.table({
        "doc_id": docs.column("doc_id"), "n_a": n_a, "n_b": n_b, "n_groups": n_groups,
        "n_links": n_a + n_b - n_groups,  # a group of x and y tokens has x + y - 1 overlaps
        "n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(totals, pa.int64()),
        "groups_sha256": docs.column("groups_sha256")})


def _coded(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return kept(rows.mapInArrow(_code(path_a, path_b, chunk_bytes), CODED), "windows")


def _counts(coded: DataFrame) -> DataFrame:
    return coded.filter(F.col("kind") == "pair").groupBy("a", "b").agg(F.sum("n").alias("count"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(a, b, count): how many links of the corpus hold an id of A with an id of B.

    Null, empty and refused texts (see `align_documents`) have no links; an empty table gives an empty result.
    """
    return _counts(_coded(docs, path_a, path_b, id_col, text_col, chunk_bytes))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    A encodes a blank and the text with the byte-level tokenizer of `path_a`, B the text with the
    sentencepiece model of `path_b`, which adds the blank itself. A text that is null, empty, no UTF-8, or
    whose tokens do not give back its bytes has zeros and an empty digest. Rows with equal or null doc_id
    are answered each for itself and count each. n_best counts links whose pair has the highest count of
    its B id, ties included. Extra columns are ignored; an empty table gives an empty result.
    """
    coded = _coded(docs, path_a, path_b, id_col, text_col, chunk_bytes)
    counts = _counts(coded)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    rated = counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("top"))
    places = coded.filter(F.col("kind") == "pair").select("chunk", "place", "a", "b")
    back = places.join(rated, ["a", "b"]).select("chunk", "place", "count", "top")
    texts = coded.filter(F.col("kind") != "pair").select(
        F.col("chunk").alias("part"), "kind", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "payload")
    return texts.groupBy("part").cogroup(back.groupBy("chunk")).applyInArrow(_finish, RESULT)
