"""Fingerprints of configurations: SHA-256 of canonical JSON."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping


def canonical(config: Mapping) -> str:
    """Sorted keys, no blanks, ASCII only; numbers that are not finite are refused."""
    return json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def fingerprint(config: Mapping) -> str:
    return hashlib.sha256(canonical(config).encode()).hexdigest()
