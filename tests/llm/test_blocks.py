"""Memory maps of many shards: each file is opened once, or, beyond the bound, fewer times than it is asked for."""

import os

import numpy as np
import pytest

from tessera.llm import blocks


@pytest.mark.parametrize("most, opens", [(None, 3000), (2048, 3000 + 4 * (3000 - 2048))])
def test_opens_of_many_shards(tmp_path, monkeypatch, most, opens):
    n, folder = 3000, f"file://{tmp_path}"
    keys = (np.arange(n, dtype=np.uint64) << np.uint64(32)) * np.uint64((1 << 32) // n) + np.uint64(1 << 40)
    where = blocks.shard_of(keys, n)
    for s in np.unique(where).tolist():
        own = np.sort(keys[where == s])
        blocks.Lookup.save(folder, s, own, np.arange(len(own), dtype="<u4"))
    sizes = dict(zip(*(x.tolist() for x in np.unique(where, return_counts=True)), strict=True))
    lookup, seen, plain = blocks.Lookup(folder, sizes, n, {"c": "<u4"}), [], blocks.mapped
    if most:
        lookup.maps.most = most
    monkeypatch.setattr(blocks, "mapped", lambda uri: seen.append(uri) or plain(uri))
    before = len(os.listdir("/proc/self/fd"))
    for _ in range(5):
        assert lookup.find(keys)["found"].all()
    assert len(seen) <= opens
    assert len(os.listdir("/proc/self/fd")) < before + 50  # maps hold no descriptors


def test_empty_and_missing_files(tmp_path):
    (tmp_path / "a").write_bytes(b"")
    assert len(blocks.mapped(f"file://{tmp_path}/a")) == 0
    with pytest.raises(FileNotFoundError):
        blocks.mapped(f"file://{tmp_path}/b")
