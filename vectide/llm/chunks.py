"""Documents in chunks of bounded text, so that per-word results can meet their documents again by chunk."""

from __future__ import annotations

from pyspark import TaskContext

# Bytes of text in a chunk. One text that is longer is a chunk of its own.
CHUNK_BYTES = 16 << 20


def chunked(batches, columns: list[str], text: str, limit: int = CHUNK_BYTES):
    """(chunk number, rows as tuples) with at most `limit` bytes of text each.

    The number is the input partition and a counter, so a task that runs again gives the same one.
    """
    part, count, rows, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        at = columns.index(text)
        for row in zip(*[batch.column(c).to_pylist() for c in columns]):
            length = len(row[at] or b"")
            if rows and size + length > limit:
                yield part << 32 | count, rows
                count, rows, size = count + 1, [], 0
            rows.append(row)
            size += length
    if rows:
        yield part << 32 | count, rows
