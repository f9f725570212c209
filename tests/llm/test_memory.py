"""Memory of the steps that run in an executor's Python workers."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quarry.llm import common, substring


def peak_of(run) -> int:
    """Most bytes that Python and NumPy hold at once, above those held before."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_merged_windows_are_held_once():
    """An executor has a few hundred MB for the workers that merge ranges: joining and finding sources stays below 80 bytes a window."""
    rng, n = np.random.default_rng(1), 25_000

    def piece(block):
        hashes = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        docs = rng.integers(0, 500, n).astype(np.uint32)
        return substring.Run(hashes, docs, rng.integers(0, 400, n).astype(np.uint32), np.arange(500) + 500 * block, np.full(500, block), np.arange(500) * 400)

    held = [piece(block) for block in range(20)]
    old = piece(99)
    old.keys -= 10**6
    held[3].hashes[:100] = old.hashes[:100]
    held[3].hashes.sort()
    got = []
    assert peak_of(lambda: got.extend(substring.sources(substring.Run.joined(held), [old]))) < 80 * 20 * n
    assert len(got[0]) >= 100 and set(got[0].tolist()) == {99} and set(got[2].tolist()) == {3}


def test_a_blocks_windows_take_little_memory(tmp_path):
    """Likewise for the windows of a block: below 52 bytes a window besides the block itself."""
    rng, n = np.random.default_rng(2), 600
    texts = [" ".join(map(str, rng.integers(0, 10**6, 1000))) for _ in range(n)]
    table = pa.table({"_key": pa.array(range(n), pa.int64()), "text": texts})
    with pa.OSFile(str(tmp_path / f"block-{7:016x}"), "wb") as f, pa.ipc.new_file(f, table.schema) as out:
        out.write_table(table)
    index = substring.WindowIndex.__new__(substring.WindowIndex)
    index.folder, index.parts, index.window, index.bits, index.pieces = str(tmp_path), 50, 13, 64, 1
    of_block = index._windows("_key", "text")
    assert peak_of(lambda: sum(r.nbytes for r in of_block(iter([substring.row(substring.BLOCK, 7)])))) < 52 * 988 * n


def test_workers_give_memory_back(monkeypatch):
    """A step of the index ends by returning what the C library holds."""
    called = []

    class Library:
        def malloc_trim(self, pad):
            called.append(pad)

    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: Library())
    assert list(common.releasing(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3]
    assert called == [0]
