"""Helpers shared by the training-data operators.

Texts are cut to words as bytes and hashed to 64 bits with a per-worker cache, so everything after
that is numpy over flat arrays.  Results that later passes look up (counts, repeated windows, document
sets) are kept as sorted arrays in files of the shared folder and memory-mapped by the workers, one
file for each hash shard: nothing of that kind goes through the driver or is broadcast, and a file
that is written again after a lost executor has the same content.
"""

from __future__ import annotations

import mmap
import os
import sys
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tessera.shared import shared_dir, unused, written  # noqa: F401 - used by the operators under this name

U64 = np.uint64
#: Multiplier of the polynomial hash (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CACHE_WORDS = 300_000
CHUNK_BYTES = 4 << 20
#: Bytes to what the word pattern of the contamination check sees: A-Z lower, other ASCII but 0-9 a-z blank.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shards(spark: SparkSession) -> int:
    """Hash shards of an exchange; follows spark.sql.shuffle.partitions, which is sized for the data."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Actions in here drop their shuffle files when they end: for results that are written and read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def put(uri: str, parts: Iterable[bytes]) -> None:
    """Write a file of the shared folder, with the same content whenever a task is repeated.

    Local files appear in one step; those of a remote store when the stream is closed, as stores do it.
    """
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(tmp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            for x in parts:
                f.write(x)
        os.replace(tmp, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as f:
        for x in parts:
            f.write(x)


class Appender:
    """A file of the shared folder that a task writes bit by bit, under a number that no other attempt has.

    A repeated attempt writes a file of its own, so rows that name the file and a place in it stay true whichever
    attempt's rows are kept.
    """

    def __init__(self, folder: str):
        self.number = uuid.uuid4().int >> 65
        self.uri, self._file = f"{folder}/{self.number:016x}", None

    def write(self, part: bytes) -> None:
        if self._file is None:
            if path := _local(self.uri):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                self._file = open(path, "wb", buffering=1 << 20)  # noqa: SIM115 - closed by close()
            else:
                from pyarrow import fs

                store, path = fs.FileSystem.from_uri(self.uri)
                self._file = store.open_output_stream(path)
        self._file.write(part)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


def mapped(uri: str) -> np.ndarray:
    """A file of the shared folder as memory-mapped bytes.

    Where it has no local path, a copy is mapped that has no name any more: its space is free when the map is closed.
    """
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:
            return _map(f)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(at) as f, tempfile.TemporaryFile() as g:
        while block := f.read(8 << 20):
            g.write(block)
        g.flush()
        return _map(g)


def _map(f) -> np.ndarray:
    """An open file's bytes; the map holds no file descriptor where Python can do without (from 3.13 on)."""
    if not os.fstat(f.fileno()).st_size:
        return np.empty(0, np.uint8)
    free = {"trackfd": False} if sys.version_info >= (3, 13) else {}
    return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **free), np.uint8)


class Words(dict):
    """word -> 8 bytes of its hash, forgotten when too many are kept."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        return got


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about CHUNK_BYTES of text (one row at least); null texts are empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        size = np.diff(_offsets(col))
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            total += n
            if total >= CHUNK_BYTES or i == len(size) - 1:
                part = batch.slice(start, i + 1 - start)
                raw = part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
                yield part, [x or b"" for x in raw]
                start, total = i + 1, 0


def _offsets(col: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    buf = col.buffers()[1]
    if buf is None or not len(col):
        return np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(buf, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A long column; null as the smallest long."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def hashed(split: list[list[bytes]], cache: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and the words of each text."""
    get = cache.__getitem__
    flat = np.frombuffer(b"".join([b"".join(map(get, w)) for w in split]), U64)
    return flat, np.fromiter(map(len, split), np.int64, len(split))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            x = np.full(n, U64(base))
            x[:1] = U64(1)
            _POWERS[key] = np.cumprod(x, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, whatever text they are in; shorter than k: none."""
    if len(h) < k:
        return np.empty(0, U64)
    up, down = _powers(len(h))
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up, dtype=U64, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1])


def inside(counts: np.ndarray, k: int) -> np.ndarray:
    """Mask over windows(): those that lie within one text."""
    total = int(counts.sum())
    if total < k:
        return np.zeros(0, bool)
    ends = np.repeat(np.cumsum(counts), counts)
    return (np.arange(total) + k <= ends)[: total - k + 1]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, and the place of every given key among them.

    Sorts the keys with their places in the low bits, so keys that differ there alone may change places and come
    more than once: fit for look-ups, not for counts.
    """
    n = len(keys)
    low = U64((1 << max(1, (n - 1).bit_length())) - 1)
    order = (np.sort((keys & ~low) | np.arange(n, dtype=U64)) & low).astype(np.int64)
    inside = keys[order]
    new = np.r_[True, inside[1:] != inside[:-1]] if n else np.empty(0, bool)
    back = np.empty(n, np.int64)
    back[order] = np.cumsum(new) - 1
    return inside[new], back


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)


PAYLOAD = "shard int, payload binary"


def payload(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "payload"])


def cut(keys: np.ndarray, n: int, pack) -> list[tuple[int, bytes]]:
    """One payload for each shard that has some of these sorted keys; pack(a, b) makes it from that range."""
    at = np.searchsorted(shard_of(keys, n), np.arange(n + 1))
    return [(s, pack(at[s], at[s + 1])) for s in range(n) if at[s + 1] > at[s]]


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
    """What came for each of a task's shards; a shard is a bounded part of the key space."""
    out: dict[int, list[bytes]] = {}
    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out.setdefault(s, []).append(x)
    return out


class Maps:
    """Memory maps of a folder's files; the least recently used are closed when too many are open.

    Linux gives a process 65,530 maps unless told otherwise; maps that hold no descriptor have no other bound.
    """

    def __init__(self, folder: str, most: int = 30_000 if sys.version_info >= (3, 13) else 2048):
        self.folder, self.most = folder, most
        self._open: OrderedDict[str, np.ndarray] = OrderedDict()

    def __getstate__(self):
        return self.__dict__ | {"_open": OrderedDict()}

    def get(self, name: str) -> np.ndarray:
        if name not in self._open:
            if len(self._open) >= self.most:
                self._open.popitem(last=False)
            self._open[name] = mapped(f"{self.folder}/{name}")
        self._open.move_to_end(name)
        return self._open[name]


def by_shard(where: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of each shard that occurs; those below 0 are left out."""
    if n < 1 << 15:
        where = where.astype(np.int16)  # sorted by digits
    if len(where) < 2 or (where[1:] >= where[:-1]).all():
        order = np.arange(len(where))
    else:
        order = np.argsort(where, kind="stable")
    at = np.searchsorted(where[order], np.arange(n + 1))
    for s in np.flatnonzero(np.diff(at)).tolist():
        yield s, order[at[s] : at[s + 1]]


class Lookup:
    """Sorted arrays in the shared folder, one file for each shard, found by binary search.

    A file holds n keys (8 bytes) and then each of the value columns; sizes has n for each shard.
    """

    def __init__(self, folder: str, sizes: dict[int, int], n_shards: int, columns: dict[str, str]):
        self.maps, self.sizes, self.n, self.columns = Maps(folder), sizes, n_shards, columns
        self.base = np.cumsum(np.r_[0, [sizes.get(s, 0) for s in range(n_shards)]])
        self.total, self.back = 0, False

    @staticmethod
    def save(folder: str, shard: int, keys: np.ndarray, *values: np.ndarray) -> None:
        put(f"{folder}/{shard:06d}", [keys.tobytes(), *(v.tobytes() for v in values)])

    def shard(self, s: int) -> dict[str, np.ndarray]:
        raw, n, at, got = self.maps.get(f"{s:06d}"), self.sizes[s], 0, {}
        for name, kind in {"key": "u8", **self.columns}.items():
            width = np.dtype(kind).itemsize * n
            got[name] = raw[at : at + width].view(kind)
            at += width
        return got

    def find(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """For each key whether it is there (found), its rank among all keys and its values (0 where it isn't).

        Keys in order are found much faster.
        """
        out = {"found": np.zeros(len(keys), bool), "rank": np.zeros(len(keys), np.int64)} | {c: np.zeros(len(keys), k) for c, k in self.columns.items()}
        # every other time from the last shard to the first: what is still mapped comes first
        parts, self.back = list(by_shard(shard_of(keys, self.n), self.n)), not self.back
        for s, part in parts if self.back else reversed(parts):
            if not self.sizes.get(s):
                continue
            own, q = self.shard(s), keys[part]
            pos = np.searchsorted(own["key"], q)
            pos[pos == len(own["key"])] = 0
            hit = own["key"][pos] == q
            part, pos = part[hit], pos[hit]
            out["found"][part] = True
            out["rank"][part] = self.base[s] + pos
            for c in self.columns:
                out[c][part] = own[c][pos]
        return out


class Pending:
    """Counted keys of a task, put together over several chunks before they are dealt out."""

    def __init__(self, n_shards: int, first: int = 0, most: int = 3_000_000):
        self.n, self.first, self.most = n_shards, first, most
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> list[tuple[int, bytes]]:
        self.parts.append(tally(keys, counts))
        return self.flush() if sum(len(k) for k, _ in self.parts) > self.most else []

    def flush(self) -> list[tuple[int, bytes]]:
        keys, counts = (np.concatenate([np.empty(0, t), *x]) for t, x in zip((U64, np.int64), zip(*self.parts, strict=True) if self.parts else ([], []), strict=True))
        self.parts = []
        keys, counts = tally(keys.astype(U64), counts)
        return [(s + self.first, x) for s, x in cut(keys, self.n, lambda a, b: keys[a:b].tobytes() + counts[a:b].astype("<u4").tobytes())]


def merged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and total counts of one shard's payloads."""
    keys = np.concatenate([np.frombuffer(x, U64, len(x) // 12) for x in parts])
    counts = np.concatenate([np.frombuffer(x, "<u4", len(x) // 12, len(x) // 12 * 8) for x in parts])
    return tally(keys, counts.astype(np.int64))


def kept_counts(mapped_rows: DataFrame, folder: str, n_shards: int, least: int) -> Lookup:
    """Add up counted keys by shard; those with a total of ``least`` or more become a Lookup with column c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = []
        for s, parts in gathered(batches).items():
            keys, counts = merged(parts)
            some = counts >= least
            Lookup.save(folder, s, keys[some], np.minimum(counts[some], 0xFFFFFFFF).astype("<u4"))
            sizes.append((s, int(some.sum()), int(counts[some].sum())))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in sizes], pa.int64()) for j in range(3)], ["shard", "n", "total"])

    # one small row for each shard
    rows = mapped_rows.repartitionById(n_shards, "shard").mapInArrow(run, "shard long, n long, total long").collect()
    out = Lookup(folder, {r.shard: r.n for r in rows}, n_shards, {"c": "<u4"})
    out.total = sum(r.total for r in rows)
    return out
