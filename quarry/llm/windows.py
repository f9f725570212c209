"""Hashes of word sequences, and sorted blocks of hashes for exchange and storage."""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

from quarry.llm.common import mix

#: An odd multiplier for sequences of word hashes.
MULTIPLIER = 0x9E3779B97F4A7C15
U64 = np.uint64


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))


def sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on, for the places that have as many."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out *= U64(MULTIPLIER)
        out += hashes[j : j + n]
    return mix(out + U64(k))


def windows(split: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside each word list, in order, and how many each list has."""
    counts = np.array([len(s) for s in split], dtype=np.int64)
    hashes = sequence_hashes(word_hashes([w for s in split for w in s]), k)
    per = np.maximum(counts - k + 1, 0)
    ends = np.cumsum(counts)
    inside = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int64)
    np.add.at(inside, ends - counts, (per > 0).astype(np.int64))
    np.add.at(inside, ends - counts + per, -(per > 0).astype(np.int64))
    return hashes[np.cumsum(inside)[: len(hashes)] > 0], per


def shingles(split: list[list[bytes]], k: int) -> list[np.ndarray]:
    """The distinct hashes, ascending, of the k-word shingles of each word list; a shorter list is one shingle, an empty one has none."""
    hashes, per = windows(split, k)
    ends = np.cumsum(per)
    out = []
    for words, start, end in zip(split, ends - per, ends, strict=True):
        if end > start:
            out.append(np.unique(hashes[start:end]))
        else:
            out.append(sequence_hashes(word_hashes(words), len(words)) if words else np.zeros(0, dtype=U64))
    return out


def part_cuts(n: int) -> np.ndarray:
    """The least hash of each of n equal ranges of hashes."""
    return np.array([(i << 64) // n for i in range(n)], dtype=U64)


_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def squeeze(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed: small values cost what they hold."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    used = planes[: max((i + 1 for i in range(len(planes)) if planes[i].any()), default=0)]
    return bytes([len(used), planes.shape[0]]) + len(values).to_bytes(6, "little") + _PACK.compress(used.reshape(-1).data if used.size else b"")


def expand(data: bytes, kind: type) -> np.ndarray:
    used, width, n = data[0], data[1], int.from_bytes(data[2:8], "little")
    planes = np.zeros((width, n), dtype=np.uint8)
    planes[:used] = np.frombuffer(_UNPACK.decompress(data[8:], max_output_size=max(1, used * n)), dtype=np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeeze_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences."""
    return squeeze(np.diff(values, prepend=U64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, U64), dtype=U64)
