"""Key formats and key parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vectide.functions.vectors import float32_bytes

# Key prefixes and the hash length used in keys.
ENTRY_PREFIX = "emb:"
METADATA_PREFIX = "meta:"
TEXT_PREFIX = "embedding:"
INDEX_PREFIX = "index_embedding:"
CONTENT_PREFIX = "similarity:"
HASH_LENGTH = 16


def text_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(text, 256), 1, HASH_LENGTH)


def cache_key(model: Column | str, text: Column | str) -> Column:
    """Key of a text under a model: prefix, model and hash of the whole text."""
    return F.concat(F.lit(TEXT_PREFIX), model, F.lit(":"), text_hash(text))


def prefixed(prefix: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(prefix), key.cast("string"))


def strip_namespace(key: Column | str) -> Column:
    """The id behind the first colon; further colons belong to the id."""
    return F.regexp_replace(key, "^[^:]*:", "")


def content_hash(vector: Column | str) -> Column:
    """Key of the set of entries whose float32 bytes are the same."""
    return F.concat(F.lit(CONTENT_PREFIX), F.substring(F.sha2(float32_bytes(vector), 256), 1, HASH_LENGTH))


def _class_end(pattern: str, start: int) -> int | None:
    """Place of the bracket that closes the class opened at `start`; a backslash takes the next character in."""
    i = start + 1 + (pattern[start + 1:start + 2] == "^")
    first = i
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "]" and i > first:
            return i
        i += 1
    return None


def glob_to_regex(pattern: str) -> str:
    """Key glob (`*`, `?`, `[...]`, `[^...]`, backslash escape) as an anchored regular expression."""
    out, i = [], 0
    special = set(r"\.^$|()[]{}*+?")
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (close := _class_end(pattern, i)):
            negated = pattern[i + 1] == "^"
            body, j = "", i + 1 + negated
            while j < close:
                escaped = pattern[j] == "\\" and j + 1 < close
                j += escaped
                body += "\\" + pattern[j] if pattern[j] in "\\[]^&" or escaped and pattern[j] == "-" else pattern[j]
                j += 1
            out.append(f"[{'^' if negated else ''}{body}]")
            i = close
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i] if pattern[i] in special else pattern[i])
        else:
            out.append("\\" + c if c in special else c)
        i += 1
    return "(?s)^" + "".join(out) + r"\z"
