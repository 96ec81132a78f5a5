"""Sorted hash tables with vectorised lookup, cut into shards that are broadcast one by one."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
from pyspark import SparkContext

from heddle.llm.common import register_cache

_BITS = 14


class Shard:
    """Sorted 64-bit keys with values; a lookup goes to the key's bucket and steps through it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.starts = np.searchsorted(self.keys, np.arange(1 << _BITS, dtype=np.uint64) << np.uint64(64 - _BITS))

    def get(self, h: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(h), default, self.values.dtype)
        if not len(self.keys):
            return out
        at = self.starts[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
        left = np.arange(len(h))
        while len(left):
            inside = at < len(self.keys)
            left, at = left[inside], at[inside]
            key, want = self.keys[at], h[left]
            hit = key == want
            out[left[hit]] = self.values[at[hit]]
            more = key < want
            left, at = left[more], at[more] + 1
        return out


class Table:
    """A table of bounded size as broadcast shards, told apart by shard_of(key)."""

    def __init__(self, sc: SparkContext, parts: Iterable[tuple[np.ndarray, np.ndarray]]):
        self.name = uuid.uuid4().hex
        self.shards = [sc.broadcast(p) for p in parts]

    def get(self, h: np.ndarray, default: float = 0.0) -> np.ndarray:
        """Join hashes with the table, shard by shard."""
        open_ = opened(self.name, self.shards)
        own = shard_of(h, len(open_))
        order = np.argsort(own, kind="stable")
        edge = np.searchsorted(own[order], np.arange(len(open_) + 1))
        out = np.full(len(h), default, open_[0].values.dtype)
        for k, shard in enumerate(open_):
            mine = order[edge[k] : edge[k + 1]]
            out[mine] = shard.get(h[mine], default)
        return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)


_opened: dict[str, list[Shard]] = {}
register_cache("heddle.llm.kneser_ney", _opened.clear)


def opened(name: str, shards: list) -> list[Shard]:
    """The shards of a table, built once in each worker, which holds one table at a time.

    The broadcast values themselves are let go; they can be read again from their files.
    """
    if name not in _opened:
        _opened.clear()
        out = []
        for b in shards:
            out.append(Shard(*b.value))
            b.__dict__.pop("_value", None)
        _opened[name] = out
    return _opened[name]
