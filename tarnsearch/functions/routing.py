"""Placement of URLs on shards: FNV-1a with an avalanche step, then jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public algorithms: FNV-1a 64, the murmur finaliser, and Lamping and Veach's generator.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x00000100000001B3
MIX_A, MIX_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
JUMP = 2862933555777941757


def hash_urls(urls: list[str | None]) -> np.ndarray:
    """64-bit hash of each URL; all strings advance together, one byte position per step."""
    data = [u.encode() if u is not None else b"" for u in urls]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-sizes, kind="stable")
    table = np.zeros((len(data), int(sizes.max()) if len(data) else 0), np.uint8)
    for row, i in enumerate(order):
        table[row, : sizes[i]] = np.frombuffer(data[i], np.uint8)
    h = np.full(len(data), FNV_OFFSET, np.uint64)
    live = np.searchsorted(-sizes[order], -np.arange(1, table.shape[1] + 1), side="right")
    with np.errstate(over="ignore"):
        for j, n in enumerate(live):
            h[:n] = (h[:n] ^ table[:n, j]) * np.uint64(FNV_PRIME)
        for m in (MIX_A, MIX_B):
            h ^= h >> np.uint64(33)
            h *= np.uint64(m)
        h ^= h >> np.uint64(33)
    out = np.empty_like(h)
    out[order] = h
    return out


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key; 0 when there are none."""
    b, j = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    if buckets <= 0:
        return b
    key, active = keys.copy(), np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        while active.any():
            b[active] = j[active]
            key[active] = key[active] * np.uint64(JUMP) + np.uint64(1)
            step = (b[active] + 1) * (float(1 << 31) / ((key[active] >> np.uint64(33)).astype(np.float64) + 1))
            j[active] = np.minimum(step, 2**62).astype(np.int64)
            active[active] = j[active] < buckets
    return b


def shard_for(url: Column, shards: int) -> Column:
    """Shard of a URL as INT; a null URL has no shard."""

    @F.pandas_udf("int")
    def place(s: pd.Series) -> pd.Series:
        out = pd.Series(jump_hash(hash_urls(s.tolist()), shards), index=s.index, dtype="Int32")
        return out.mask(s.isna())

    return place(url)


def content_digest(*cols: Column) -> Column:
    """Order-free digest of a row set when aggregated with ``bit_xor``."""
    return F.xxhash64(*cols)


def human_bytes(n: int) -> str:
    """A size for people, in steps of 1024 up to TiB."""
    power = min(4, max(0, (int(n).bit_length() - 1) // 10))
    return f"{n / 1024**power:.1f} {'KMGT'[power - 1]}iB" if power else f"{n} B"
