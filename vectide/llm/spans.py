"""Spans found in texts, and their digest."""

from __future__ import annotations

import hashlib


def joined(spans: list[tuple[str, int, int]], kinds: list[str]) -> str:
    """kind:start:end by start, then in the order of `kinds`, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
