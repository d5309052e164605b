"""BPE encoding and decoding by a table of distinct words.

A word here is a run without ASCII blanks. No rule of the tokenizer (normal form, white space, lower case,
split pattern, merges) looks across a blank, so the ids of a text are those of its words, in order.

1. Tasks cut documents into chunks, give each distinct word of a chunk a position, and write the documents
   as lists of positions and the words, sorted, in packets by word hash. 2. All packets of one hash range
   meet; each distinct word is encoded once, and the ids go back by (chunk, position). 3. Chunks meet their
   ids; pieces come from the id-to-piece table, whose size is the vocabulary's.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from vectide.llm.chunks import chunked
from vectide.llm.shared import kept

# Bytes of text for each hash range of words: a task holds the distinct words of one range, which cannot be more.
RANGE_BYTES = 32 << 20
CHUNK_BYTES = 32 << 20
# Documents in a row of positions.
ROW_DOCS = 1000
PACKET = "chunk long, range int, kind string, words long, payload binary"


def _pack(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(b"".join(parts))


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(numbers: np.ndarray) -> bytes:
    """Low bytes of all numbers first: the high ones are mostly zero and pack away."""
    return np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").reshape(-1)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


_PACKETS = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("kind", pa.string()), ("words", pa.int64()),
                      ("payload", pa.binary())])


def _range(word: bytes, ranges: int) -> int:
    return xxhash.xxh64_intdigest(word) % ranges


class _Places(dict):
    """Position of each word, in the order in which words are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def _code(limit: int, ranges: int):
    """Documents as positions into their chunk's words, and the words by hash range."""

    def run(batches):
        for chunk, rows in chunked(batches, ["doc_id", "text"], "text", limit):
            places = _Places()
            spots = [np.array([places[w] for w in (text or b"").split()], np.uint32) for _, text in rows]
            uses = np.bincount(np.concatenate(spots), minlength=len(places)).tolist()
            names = list(places)
            hashed = [_range(word, ranges) for word in names]
            # words of one use count and range in a row, by their letters: packets then pack well
            order = np.array(sorted(range(len(names)), key=lambda i: (-uses[i], hashed[i], names[i])), np.int64)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            for at in range(0, len(rows), ROW_DOCS):
                part, ids = spots[at:at + ROW_DOCS], [doc_id for doc_id, _ in rows[at:at + ROW_DOCS]]
                counts = np.array(list(map(len, part)), np.uint32)
                yield _batch([(chunk, None, "text", len(ids), _pack(
                    np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(),
                    _planes(counts), _planes(rank[np.concatenate(part)])))], _PACKETS)
            parts: list[tuple[list, list]] = [([], []) for _ in range(ranges)]
            for place, old in enumerate(order.tolist()):
                part = parts[hashed[old]]
                part[0].append(place)
                part[1].append(names[old])
            out = [(chunk, n, "words", len(mine), _pack(_planes(np.diff(mine, prepend=0)), b" ".join(words)))
                   for n, (mine, words) in enumerate(parts) if mine]
            if out:
                yield _batch(out, _PACKETS)

    return run


def _encode(path: str):
    """Ids of the words in each packet; rows come sorted by range, and a word met again is not encoded again."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        now, known = None, {}
        for batch in batches:
            for chunk, part, n, payload in zip(*[batch.column(c).to_pylist() for c in ("chunk", "range", "words", "payload")]):
                if part != now:
                    now, known = part, {}
                data = _unpack(payload)
                words = data[4 * n:].split(b" ")
                new = [w for w in words if w not in known]
                for word, got in zip(new, tokenizer.encode_batch([w.decode() for w in new], add_special_tokens=False)):
                    known[word] = np.array(got.ids, np.uint32)
                ids = [known[w] for w in words]
                counts = np.fromiter(map(len, ids), np.uint32, n)
                yield _batch([(chunk, None, "ids", n, _pack(
                    data[:4 * n], _planes(counts), _planes(np.concatenate(ids))))], _PACKETS)

    return run


def _words(path: str, rows: list[dict]) -> tuple[list[np.ndarray], list[str]]:
    """By position, the ids of a chunk's words and their pieces joined by blanks."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    pieces = dict(zip(vocabulary.values(), vocabulary))
    total = sum(row["words"] for row in rows if row["kind"] == "ids")
    ids, decoded = [None] * total, [None] * total
    for row in rows:
        if row["kind"] == "ids":
            n, data = row["words"], _unpack(row["payload"])
            ends, flat = np.cumsum(_numbers(data, n, 4 * n)).tolist(), _numbers(data, len(data) // 4 - 2 * n, 8 * n).tolist()
            names, start = [pieces[i] for i in flat], 0
            for place, end in zip(np.cumsum(_numbers(data, n)).tolist(), ends):
                ids[place], decoded[place] = flat[start:end], " ".join(names[start:end])
                start = end
    return ids, decoded


def _texts(rows: list[dict]):
    """(doc_id, positions) of each document."""
    for row in rows:
        if row["kind"] == "text":
            n, data = row["words"], _unpack(row["payload"])
            ids, none = np.frombuffer(data, np.int64, n).tolist(), np.frombuffer(data, np.uint8, n, 8 * n).tolist()
            ends = np.cumsum(_numbers(data, n, 9 * n))
            spots = _numbers(data, (len(data) - 13 * n) // 4, 13 * n)
            for doc_id, missing, part in zip(ids, none, np.split(spots, ends[:-1])):
                yield None if missing else doc_id, part.tolist()


def _tokens(path: str):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids, decoded = _words(path, rows)
        doc_ids, all_ids, texts = [], [], []
        for doc_id, spots in _texts(rows):
            doc_ids.append(doc_id)
            all_ids.append([i for s in spots for i in ids[s]])
            texts.append(" ".join([decoded[s] for s in spots if ids[s]]))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(all_ids, pa.list_(pa.int32())),
                         "decoded": pa.array(texts, pa.string())})

    return run


def _digests(path: str):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids, decoded = _words(path, rows)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        numbers = [" ".join(map(str, got)).encode() for got in ids]
        pieces = [text.encode() for text in decoded]
        out = [[], [], [], []]
        for doc_id, spots in _texts(rows):
            n = counts[spots]
            if not n.all():  # a word may have no ids
                spots = [s for s in spots if ids[s]]
            out[0].append(doc_id)
            out[1].append(int(n.sum()))
            for part, words in ((2, numbers), (3, pieces)):
                out[part].append(hashlib.sha256(b" ".join([words[s] for s in spots])).hexdigest())
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_tokens": pa.array(out[1], pa.int64()),
                         "ids_sha256": pa.array(out[2], pa.string()), "decoded_sha256": pa.array(out[3], pa.string())})

    return run


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, chunk_bytes: int, finish, schema: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(16, -(-size // RANGE_BYTES))
    coded = kept(rows.mapInArrow(_code(chunk_bytes, ranges), PACKET), "coded")
    words = coded.filter(F.col("kind") == "words")
    ids = words.repartition("range").sortWithinPartitions("range", "chunk").mapInArrow(_encode(path), PACKET)
    return coded.filter(F.col("kind") == "text").union(ids).groupBy("chunk").applyInArrow(finish(path), schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, ids, decoded for every row, as the tokenizers library encodes whole texts without special
    tokens of its own and decodes with special tokens kept. `path` names the tokenizer's file.

    A null text counts as empty: no ids, empty decoded text. Rows with equal or null doc_id are answered
    each for itself. Extra columns are ignored; an empty table gives an empty result.
    """
    return _run(docs, path, id_col, text_col, chunk_bytes, _tokens, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """As `encode`, with n_tokens and the SHA-256 of the ids (decimal, joined by blanks) and of the decoded text."""
    return _run(docs, path, id_col, text_col, chunk_bytes, _digests,
                "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
