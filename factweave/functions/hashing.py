"""Canonical JSON, digests and ids of values on the driver; their column forms are in text."""

from __future__ import annotations

import hashlib
import json


def canonical(value) -> str:
    """JSON without white space, keys sorted, nulls kept."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def stable_id(kind: str, value) -> str:
    return f"{kind}:v1:{digest(value)}"
