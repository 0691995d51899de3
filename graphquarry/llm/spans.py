"""Helpers for operators that report spans of code points in texts."""

from __future__ import annotations

import hashlib


def joined(spans: list[tuple[str, int, int]], order: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed in ``order``, comma-joined."""
    rank = {k: i for i, k in enumerate(order)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
