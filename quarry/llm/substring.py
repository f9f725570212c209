"""Incremental removal of repeated word windows (operator 2).

A log-structured index holds the hashes of all windows of past documents.

* A batch's rows are parked in *blocks*: files of some megabytes of text.  All
  that follows is computed from these files, so a lost executor changes nothing.
* Inside a block equal windows are compared word by word with the first of
  them; only that one goes on, so no window gathers more than a row a block.
* The windows go to ranges of their hash.  A range is sorted piece by piece and
  merge-joined with its *runs*: immutable files of past batches, sorted by hash,
  one for each range and batch.  It is then written as a run itself.
* A window's source is the next smaller document with the same hash, not the
  first one, so each window vouches for one other at most: no source is hot.
  Sources and hits that follow each other become spans.
* Every hit is verified: the source's block sends the words of the span to the
  hit's block, where they are compared.  Only equal words are removed.
* Once a range has ``TIER`` runs they are compacted to one, with the least
  document of each window.

Batches must come in ascending order of the document id.

A window is found by 64 bits of hash and removed by its words.  Two different
windows of one hash are never taken for each other; the larger may then miss
its source (among n windows, n * n / 2**65 such pairs are to be expected), and
a passage longer than a window loses nothing by that, as its other windows
cover the same words.

Blocks, runs and tables lie in a folder that driver and executors share.  Files
carry names of their own; tables name those of the attempts that succeeded.
Blocks stay for as long as the index is used, as later batches are verified
against them.

Defined cases: null or empty texts have no words and no windows; texts with
fewer words than a window lose nothing; rows with a null id are neither indexed
nor changed; rows that share an id never remove each other's words; extra
columns are kept unless named like an output column, in any case of letters; an
empty table gives none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.blocks import park, read_block
from quarry.llm.common import MOST_RANGES, free, open_fs, partitions, range_bounds, releasing, shared_dir, size_of, slices, stored, without
from quarry.llm.windows import U64, expand, expand_sorted, part_cuts, squeeze, squeeze_sorted, windows

WINDOW = 13
#: Bytes of text (as the planner estimates them) whose windows a range sorts at a time.
PIECE_BYTES = 16 << 20
#: Runs of a range that are compacted to one.
TIER = 2
#: Windows that are looked up in a run at a time.
MERGED = 1 << 16
SIGN = U64(1 << 63)
ADDED = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept": T.StringType(), "removed": T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))}
#: Rows between the steps: kind (0 block, 1 windows, 2 local hits, 3 hits, 4 run, 5 words), the block or range that it belongs to, and what it holds.
ROW = "kind int, to long, a binary, b binary, c binary, d binary"
BLOCK, WINDOWS, LOCAL, HITS, RUN, WORDS = range(6)


def row(kind: int, to: int, *data: bytes) -> pa.RecordBatch:
    filled = [*data, *[b""] * (4 - len(data))]
    return pa.RecordBatch.from_arrays([pa.array([kind], type=pa.int32()), pa.array([to], type=pa.int64()), *(pa.array([x], type=pa.binary()) for x in filled)], names=["kind", "to", "a", "b", "c", "d"])


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(j)[i].as_py() for j in range(6))


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it, in ordered columns; the first row always does."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], reduce(np.logical_or, (c[1:] != c[:-1] for c in columns)))))


def between(first: np.ndarray, n: int) -> list[tuple[int, int]]:
    """From each start to the next one, or to the end."""
    return list(zip(first.tolist(), [*first[1:].tolist(), n], strict=False))


def spans_of(at: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the longest runs in which all columns go up by one, or (boolean ones) do not break."""
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    step = np.arange(len(at))
    first = starts_of(*(x.astype(np.int64) - step if x.dtype != np.bool_ else np.cumsum(x) for x in (at, *others)))
    return first, np.diff(np.append(first, len(at)))


def equal_windows(a: list[bytes], b: list[bytes], k: int) -> np.ndarray:
    """Which windows of k words are the same in two word lists of one length."""
    if a == b:
        return np.ones(max(0, len(a) - k + 1), dtype=bool)
    same = np.concatenate(([0], np.cumsum([x == y for x, y in zip(a, b, strict=True)])))
    return same[k:] - same[:-k] == k


class Block:
    """A block's documents; windows are numbered through all of them, in their order."""

    def __init__(self, folder: str, name: int, key: str, text: str, k: int) -> None:
        self.table, self.k = read_block(folder, name), k
        keys = self.table.column(key).combine_chunks()
        self.keys, self.known = np.asarray(keys.fill_null(0), dtype=np.int64), np.asarray(keys.is_valid())
        self.texts = self.table.column(text).combine_chunks().cast(pa.binary())
        self.recent: dict[int, list[bytes]] = {}

    def words(self, doc: int) -> list[bytes]:
        if (known := self.recent.get(doc)) is None:
            if len(self.recent) >= 64:
                self.recent.clear()
            known = self.recent[doc] = (self.texts[doc].as_py() or b"").split()
        return known

    def count(self) -> None:
        """The first window of each document."""
        words = np.array([len((t.as_py() or b"").split()) for t in self.texts], dtype=np.int64)
        self.place(np.maximum(words - self.k + 1, 0) * self.known)

    def place(self, per: np.ndarray) -> None:
        self.per, self.base = per, np.concatenate(([0], np.cumsum(per)))

    def hashes(self, bits: int) -> np.ndarray:
        out, per = [], []
        batch = pa.RecordBatch.from_arrays([self.texts], names=["t"])
        seen = 0
        for _, texts in slices(iter([batch]), "t"):
            got, counts = windows([t.split() if t and known else [] for t, known in zip(texts, self.known[seen : seen + len(texts)].tolist(), strict=True)], self.k)
            out.append(got), per.append(counts)
            seen += len(texts)
        self.place(np.concatenate(per) if per else np.zeros(0, dtype=np.int64))
        found = np.concatenate(out) if out else np.zeros(0, dtype=U64)
        return found if bits == 64 else found & (~U64(0) << U64(64 - bits))

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, at, side="right") - 1

    def same(self, at: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Which windows have the words of their sources in the same block."""
        out = np.zeros(len(at), dtype=bool)
        docs, others = self.doc_of(at), self.doc_of(source)
        first, lengths = spans_of(at, source, np.append(False, docs[1:] != docs[:-1]), np.append(False, others[1:] != others[:-1]))
        for i, n in zip(first.tolist(), lengths.tolist(), strict=True):
            a, b = docs[i], others[i]
            x, y = int(at[i] - self.base[a]), int(source[i] - self.base[b])
            out[i : i + n] = equal_windows(self.words(int(a))[x : x + n + self.k - 1], self.words(int(b))[y : y + n + self.k - 1], self.k)
        return out


class Run:
    """A sorted piece of windows: hash, and the document (its id, block and first window) and place (both in 32 bits) of the least one that has it."""

    def __init__(self, hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, keys: np.ndarray, blocks: np.ndarray, bases: np.ndarray) -> None:
        self.hashes, self.docs, self.places, self.keys, self.blocks, self.bases = hashes, docs, places, keys, blocks, bases

    @staticmethod
    def joined(runs: list[Run]) -> Run:
        """All windows in one run; the list is emptied on the way, so that the windows are held once."""
        if not runs:
            none = np.zeros(0, dtype=np.int64)
            return Run(none.view(U64), none.astype(np.uint32), none.astype(np.uint32), none, none, none)
        shift = np.cumsum([0, *(len(r.keys) for r in runs)])
        keys, blocks, bases = (np.concatenate(x) for x in zip(*((r.keys, r.blocks, r.bases) for r in runs), strict=True))
        rank = np.empty(len(keys), dtype=np.uint32)
        rank[np.lexsort((bases, blocks, keys))] = np.arange(len(keys), dtype=np.uint32)
        n = sum(len(r.hashes) for r in runs)
        hashes, docs, places = np.empty(n, dtype=U64), np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
        while runs:
            r = runs.pop()
            at = slice(n - len(r.hashes), n)
            hashes[at], places[at] = r.hashes, r.places
            np.add(r.docs, np.uint32(shift[len(runs)]), out=docs[at])
            n = at.start
        order = np.lexsort((places, rank[docs], hashes)).astype(np.uint32 if len(hashes) < 1 << 32 else np.int64)
        hashes = hashes[order]
        docs = docs[order]
        places = places[order]
        return Run(hashes, docs, places, keys, blocks, bases)

    def at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks and windows of some rows."""
        docs = self.docs[rows]
        return self.blocks[docs], self.bases[docs] + self.places[rows]

    def least(self) -> Run:
        first = starts_of(self.hashes)
        return Run(self.hashes[first], self.docs[first], self.places[first], self.keys, self.blocks, self.bases)

    def dump(self) -> bytes:
        named = np.zeros(len(self.keys), dtype=bool)
        named[self.docs] = True
        used, number = np.flatnonzero(named), np.cumsum(named, dtype=np.uint32) - np.uint32(1)
        parts = [squeeze_sorted(self.hashes), squeeze(number[self.docs]), squeeze(self.places), squeeze(self.keys[used]), squeeze(self.blocks[used]), squeeze(self.bases[used])]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @staticmethod
    def load(data: bytes) -> Run:
        parts, at = [], 0
        while at < len(data):
            size = int.from_bytes(data[at : at + 8], "little")
            parts.append(data[at + 8 : at + 8 + size])
            at += 8 + size
        return Run(expand_sorted(parts[0]), expand(parts[1], np.uint32), expand(parts[2], np.uint32), *(expand(p, np.int64) for p in parts[3:]))


class RunWriter:
    """A run file: the pieces of a range in order, then their ends and the number of pieces."""

    def __init__(self, folder: str, part: int) -> None:
        fs, base = open_fs(folder)
        self.name, self.ends, self.pieces = f"run-{part:06d}-{uuid.uuid4().hex}", [0], []
        self.file = fs.open_output_stream(f"{base}/{self.name}")

    def put(self, piece: int, run: Run) -> None:
        data = run.dump()
        self.file.write(data)
        self.ends.append(self.ends[-1] + len(data))
        self.pieces.append(piece)

    def close(self) -> str:
        self.file.write(np.array([*self.ends, *self.pieces, len(self.pieces)], dtype="<i8").tobytes())
        self.file.close()
        return self.name


class RunReader:
    def __init__(self, folder: str, name: str) -> None:
        fs, base = open_fs(folder)
        path = f"{base}/{name}"
        self.file = fs.open_input_file(path)
        size = fs.get_file_info(path).size
        n = int.from_bytes(self.file.read_at(8, size - 8), "little")
        tail = np.frombuffer(self.file.read_at(8 * (2 * n + 1), size - 8 * (2 * n + 2)), dtype="<i8").tolist()
        self.at = {p: (a, b) for p, a, b in zip(tail[n + 1 :], tail, tail[1 : n + 1], strict=False)}

    def get(self, piece: int) -> Run:
        if piece not in self.at:
            return Run.joined([])
        a, b = self.at[piece]
        return Run.load(self.file.read_at(b - a, a))

    def close(self) -> None:
        self.file.close()


def sent(hashes: np.ndarray, at: np.ndarray, block: Block) -> tuple[bytes, bytes, bytes, bytes]:
    """Windows of a block, ascending by hash, for an exchange."""
    used, docs = np.unique(block.doc_of(at), return_inverse=True)
    return squeeze_sorted(hashes), squeeze(docs.astype(np.uint32)), squeeze((at - block.base[used][docs]).astype(np.uint32)), b"".join(len(x).to_bytes(8, "little") + x for x in (squeeze_sorted(block.base[used].view(U64)), squeeze_sorted(block.keys[used].view(U64) ^ SIGN)))


def received(name: int, a: bytes, b: bytes, c: bytes, d: bytes) -> Run:
    size = int.from_bytes(d[:8], "little")
    bases, keys = expand_sorted(d[8 : 8 + size]).view(np.int64), (expand_sorted(d[16 + size :]) ^ SIGN).view(np.int64)
    return Run(expand_sorted(a), expand(b, np.uint32), expand(c, np.uint32), keys, np.full(len(keys), name), bases)


def sources(new: Run, history: list[Run]) -> tuple[np.ndarray, ...]:
    """Hits of a sorted run: source block and window, hit block and window; the source is the next smaller document, or else one of the history."""
    first = starts_of(new.hashes)
    times = np.diff(np.append(first, len(new.hashes)))
    again = np.repeat(first[times > 1], times[times > 1])  # of the rows of a hash that has several, the first one
    rows = np.flatnonzero(np.repeat(times > 1, times))
    keys = new.keys[new.docs[rows]]
    own = starts_of(again, keys)
    before = np.repeat(rows[own] - 1, np.diff(np.append(own, len(rows))))  # the row before a document's rows of a hash
    near = before >= again
    hits, (block, place) = [rows[near]], ([x] for x in new.at(before[near]))
    found = np.zeros(len(new.hashes), dtype=bool)
    found[hits[0]] = True
    for old in history:  # sorted runs, merged one after another
        if not len(old.hashes):
            continue
        for start in range(0, len(found), MERGED):
            some = new.hashes[start : start + MERGED]
            j = np.minimum(np.searchsorted(old.hashes, some), len(old.hashes) - 1)
            more = np.flatnonzero(~found[start : start + MERGED] & (old.hashes[j] == some))
            more = more[old.keys[old.docs[j[more]]] < new.keys[new.docs[start + more]]]
            found[start + more] = True
            hits.append(start + more)
            for out, x in zip((block, place), old.at(j[more]), strict=True):
                out.append(x)
    return np.concatenate(block), np.concatenate(place), *new.at(np.concatenate(hits))


def by_source(source: np.ndarray, place: np.ndarray, hit: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Hits as a row for each source block."""
    order = np.lexsort((at, hit, source))
    source, place, hit, at = source[order], place[order], hit[order], at[order]
    first = starts_of(source)
    for i, j in between(first, len(source)):
        own = starts_of(hit[i:j])
        yield row(HITS, int(source[i]), hit[i:j][own].tobytes(), squeeze(np.diff(np.append(own, j - i)).astype(np.uint32)), squeeze(np.diff(at[i:j], prepend=0)), squeeze(np.diff(place[i:j] - at[i:j], prepend=0)))


class WindowIndex:
    """An index in a shared folder.  The number of ranges and pieces, the window length and the bits of a hash in use are fixed for its life."""

    def __init__(self, spark: SparkSession, folder: str, parts: int, window: int = WINDOW, pieces: int = 1, bits: int = 64) -> None:
        self.spark, self.folder, self.parts, self.window, self.pieces, self.bits = spark, folder, parts, window, pieces, bits
        self.runs: list[dict[int, str]] = []  # the run file of each range; at most MOST_RANGES names a run
        open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)

    def _windows(self, key: str, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Of each block, its windows by range, one of each hash, and the hits inside it."""
        folder, parts, k, bits = self.folder, self.parts, self.window, self.bits
        cuts = part_cuts(parts * self.pieces)[:: self.pieces]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, name, *_ in rows_of(batches):
                block = Block(folder, name, key, text, k)
                hashes = block.hashes(bits)
                order = np.argsort(hashes, kind="stable")  # documents are in order of their ids
                hashes = hashes[order]
                first = starts_of(hashes)
                other = np.ones(len(order), dtype=bool)
                other[first] = False
                other = np.flatnonzero(other)
                at, source = order[other], order[first[np.searchsorted(first, other, side="right") - 1]]
                by = np.argsort(at)
                at, source = at[by], source[by]
                equal = block.same(at, source)
                at, source = at[equal], source[equal]
                more = block.keys[block.doc_of(at)] > block.keys[block.doc_of(source)]
                begin, lengths = spans_of(at[more])
                yield row(LOCAL, name, squeeze(at[more][begin]), squeeze(lengths), squeeze(at[~more]), squeeze(source[~more]))
                hashes = hashes[first]
                order = order[first]
                del first, other, by, equal, at, source, more, begin, lengths
                ends = np.append(np.searchsorted(hashes, cuts), len(hashes))
                for p in np.flatnonzero(np.diff(ends)).tolist():
                    a, b = ends[p], ends[p + 1]
                    whole = sent(hashes[a:b], order[a:b], block)
                    yield row(WINDOWS, p, np.int64(name).tobytes() + whole[0], *whole[1:])

        return run

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
        """Indexes a batch of greater ids than before (unless not to ``keep``); its rows with n_words, n_removed, kept (the kept words joined by one space) and removed (word spans)."""
        spark, folder, k, parts, pieces = self.spark, self.folder, self.window, self.parts, self.pieces
        fields = without(docs.schema.fields, ADDED)
        (name_of_key,) = free([f.name for f in fields], "_key")
        n = partitions(spark, docs)
        blocks = park(spark, docs.select(*(f.name for f in fields), F.col(key).cast("long").alias(name_of_key)), folder, name_of_key, text)
        none = F.lit(b"").cast("binary")
        parked = blocks.select(F.lit(BLOCK).alias("kind"), F.col("block").alias("to"), *(none.alias(c) for c in "abcd"))
        of_block = self._windows(name_of_key, text)
        dealt = lambda df, m, to: df.repartitionById(m, F.pmod(to, F.lit(m)).cast("int"))
        spread = dealt(dealt(parked, n, F.col("to")).mapInArrow(releasing(of_block), ROW), parts, F.col("to"))
        if pieces > 1:
            spread = spread.mapInArrow(releasing(recut(parts, pieces)), f"{ROW}, piece int").sortWithinPartitions("piece")
        else:
            spread = spread.withColumn("piece", F.lit(0))
        history = list(self.runs)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files: list[RunReader] = []
            out: RunWriter | None = None
            part = now = -1
            held: list[Run] = []

            def done() -> Iterator[pa.RecordBatch]:
                new = Run.joined(held)
                yield from by_source(*sources(new, [f.get(now) for f in files]))
                if out is not None:
                    new = new.least()
                    out.put(now, new)

            for batch in batches:
                for (kind, to, a, b, c, d), at in zip(rows_of([batch]), batch.column(6).to_pylist(), strict=True):
                    if kind != WINDOWS:
                        yield row(kind, to, a, b, c, d)
                        continue
                    if (to, at) != (part, now):
                        if held:
                            yield from done()
                        if part < 0:  # a task has one range
                            files = [RunReader(folder, r[to]) for r in history if to in r]
                            out = RunWriter(folder, to) if keep else None
                        part, now = to, at
                    held.append(received(int(np.frombuffer(a[:8], dtype=np.int64)[0]), a[8:], b, c, d))
            if held:
                yield from done()
            for f in files:
                f.close()
            if out is not None:
                yield row(RUN, part, out.close().encode())

        merged = spread.mapInArrow(releasing(merge), ROW)
        answered = stored(spark, dealt(merged, n, F.col("to")).sortWithinPartitions("to").mapInArrow(releasing(answers(folder, name_of_key, text, k)), ROW), f"{folder}/found-{uuid.uuid4().hex}")
        if keep:
            self.runs.append({r["to"]: bytes(r["a"]).decode() for r in answered.where(f"kind = {RUN}").select("to", "a").collect()})  # one for each range
            if len(self.runs) >= TIER:
                self.compact()
        rows = parked.unionAll(answered.where(f"kind <> {RUN}"))
        return dealt(rows, n, F.col("to")).sortWithinPartitions("to", "kind").mapInArrow(releasing(finish(folder, name_of_key, text, k, [f.name for f in fields])), T.StructType([*fields, *(T.StructField(c, t) for c, t in ADDED.items())]))

    def compact(self) -> None:
        """Merges all runs to one file for each range, with the least document of each window, and deletes the merged ones."""
        spark, folder, runs, pieces, n = self.spark, self.folder, list(self.runs), self.pieces, self.parts

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    files = [RunReader(folder, r[part]) for r in runs if part in r]
                    if not files:
                        continue
                    out = RunWriter(folder, part)
                    for p in range(pieces):
                        whole = Run.joined([f.get(p) for f in files])
                        if len(whole.hashes):
                            whole = whole.least()
                            out.put(p, whole)
                    for f in files:
                        f.close()
                    yield row(RUN, part, out.close().encode())

        table = stored(spark, spark.range(0, n, 1, n).mapInArrow(releasing(merge), ROW), f"{folder}/level-{uuid.uuid4().hex}")
        self.runs = [{r["to"]: bytes(r["a"]).decode() for r in table.select("to", "a").collect()}]  # one for each range
        fs, base = open_fs(folder)
        for name in (x for r in runs for x in r.values()):
            fs.delete_file(f"{base}/{name}")


def recut(parts: int, pieces: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts the windows of a range into its pieces, some blocks at a time, so that a range of any size is sorted piece by piece."""
    cuts = part_cuts(parts * pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tagged(batch: pa.RecordBatch, piece: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([piece] * batch.num_rows, type=pa.int32())], names=[*batch.schema.names, "piece"])

        for kind, to, a, b, c, d in rows_of(batches):
            if kind != WINDOWS:
                yield tagged(row(kind, to, a, b, c, d), -1)
                continue
            name, own = a[:8], received(0, a[8:], b, c, d)
            own_cuts = cuts[to * pieces : (to + 1) * pieces]
            ends = np.append(np.searchsorted(own.hashes, own_cuts), len(own.hashes))
            for p in np.flatnonzero(np.diff(ends)).tolist():
                i, j = ends[p], ends[p + 1]
                used, docs = np.unique(own.docs[i:j], return_inverse=True)
                tables = b"".join(len(x).to_bytes(8, "little") + x for x in (squeeze_sorted(own.bases[used].view(U64)), squeeze_sorted(own.keys[used].view(U64) ^ SIGN)))
                yield tagged(row(WINDOWS, to, name + squeeze_sorted(own.hashes[i:j]), squeeze(docs.astype(np.uint32)), squeeze(own.places[i:j].astype(np.uint32)), tables), p)

    return run


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes, bytes, bytes, bytes]]]]:
    """Rows of one block or range, which come one after another."""
    held: list[tuple[int, int, bytes, bytes, bytes, bytes]] = []
    for r in rows_of(batches):
        if held and held[0][1] != r[1]:
            yield held[0][1], held
            held = []
        held.append(r)
    if held:
        yield held[0][1], held


def answers(folder: str, key: str, text: str, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of the sources, for the blocks of their hits; other rows go on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in groups(batches):
            yield from (row(*r) for r in rows if r[0] != HITS)
            asked = [r for r in rows if r[0] == HITS]
            if not asked:
                continue
            hits, ats, places = [], [], []
            for _, _, a, b, c, d in asked:
                times = expand(b, np.uint32)
                at = np.cumsum(expand(c, np.int64))
                hits.append(np.repeat(np.frombuffer(a, dtype=np.int64), times)), ats.append(at), places.append(at + np.cumsum(expand(d, np.int64)))
            hit, at, place = np.concatenate(hits), np.concatenate(ats), np.concatenate(places)
            order = np.lexsort((at, hit))
            hit, at, place = hit[order], at[order], place[order]
            block = Block(folder, name, key, text, k)
            block.count()
            docs = block.doc_of(place)
            first, lengths = spans_of(at, place, np.append(False, docs[1:] != docs[:-1]), np.append(False, hit[1:] != hit[:-1]))
            own = starts_of(hit[first])
            for i, j in between(own, len(first)):
                words = []
                for s, n in zip(first[i:j].tolist(), lengths[i:j].tolist(), strict=True):
                    x = int(place[s] - block.base[docs[s]])
                    words.append(b" ".join(block.words(int(docs[s]))[x : x + n + k - 1]))
                yield row(WORDS, int(hit[first[i]]), squeeze(at[first[i:j]]), squeeze(lengths[i:j]), b"\n".join(words))

    return run


def finish(folder: str, key: str, text: str, k: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Verifies the hits of each block and removes the words that they cover."""

    def verified(block: Block, rows: list[tuple[int, int, bytes, bytes, bytes, bytes]]) -> np.ndarray:
        hit = np.zeros(int(block.base[-1]), dtype=bool)
        for kind, _, a, b, c, _ in rows:
            if kind != WORDS:
                continue
            for at, n, words in zip(expand(a, np.int64).tolist(), expand(b, np.int64).tolist(), c.split(b"\n"), strict=True):
                source, start = words.split(b" "), at
                while start < at + n:  # the hits of a span may lie in several documents
                    doc = int(block.doc_of(np.array([start]))[0])
                    stop = min(at + n, int(block.base[doc + 1]))
                    x = start - int(block.base[doc])
                    hit[start:stop] = equal_windows(block.words(doc)[x : x + stop - start + k - 1], source[start - at : stop - at + k - 1], k)
                    start = stop
        for kind, _, a, b, c, d in rows:
            if kind == LOCAL:
                same, source = expand(c, np.int64), expand(d, np.int64)
                hit[same] |= hit[source]
                for at, n in zip(expand(a, np.int64).tolist(), expand(b, np.int64).tolist(), strict=True):
                    hit[at : at + n] = True
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in groups(batches):
            block = Block(folder, name, key, text, k)
            block.count()
            hit = verified(block, rows)
            doc = 0
            for whole in block.table.to_batches():
                for batch, texts in slices(iter([whole]), text):
                    words, gone, kept, spans = [], [], [], []
                    for t in texts:
                        split = t.split() if t else []
                        own = hit[block.base[doc] : block.base[doc + 1]]
                        doc += 1
                        words.append(len(split))
                        if not own.any():
                            gone.append(0), kept.append(b" ".join(split)), spans.append([])
                            continue
                        edge = np.zeros(len(split) + 1, dtype=np.int64)
                        edge[: len(own)] += own
                        edge[k : k + len(own)] -= own
                        out = np.cumsum(edge)[:-1] > 0
                        edges = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
                        gone.append(int(out.sum()))
                        kept.append(b" ".join([w for w, o in zip(split, out.tolist(), strict=True) if not o]))
                        spans.append([{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()])
                    columns = [pa.array(words, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(kept, type=pa.binary()).cast(pa.string()), pa.array(spans, type=pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, *ADDED])

    return run


def dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", batches: int = 3, bits: int = 64) -> DataFrame:
    """A whole table through the index, in batches of ascending ids: the last with half of the rows, those before it with what is left in equal parts; see ``WindowIndex.add`` for the columns."""
    parts = min(partitions(spark, docs), MOST_RANGES)
    index = WindowIndex(spark, shared_dir(spark, "windows"), parts, window, max(1, -(-size_of(docs) // (PIECE_BYTES * parts))), bits)
    bounds = range_bounds(docs, key, 2 * (batches - 1)) if batches > 1 else []
    cuts = bounds[1:batches]
    out: DataFrame | None = None
    for i in range(len(cuts) + 1):
        low = F.col(key) >= cuts[i - 1] if i else F.lit(True)
        high = F.col(key) < cuts[i] if i < len(cuts) else F.lit(True)
        batch = docs.where(low & high if i else high | F.col(key).isNull())
        found = index.add(batch, key, text, keep=i < len(cuts))
        out = found if out is None else out.unionAll(found)
    return out
