"""Token files: fixed-width bit packing with block offsets (operator 5).

A file holds the ids of consecutive documents, each id in the fewest bits that
hold the vocabulary.  Ids lie in blocks of ``BLOCK`` ids; a table of block
offsets gives random access, and a block is unpacked at once with numpy.

Layout, all numbers little-endian:

    8 bytes   magic b"QTOKENS1"
    4 x u32   bits per id, ids per block, documents, blocks
    u64       ids
    i64[]     doc_id of each document
    u64[]     end of each document, in ids of this file
    u64[]     start of each block, in bytes after the header, and the end of the last
    bytes     the blocks

Writing.  Texts are encoded where they are read; the packed ids are then dealt
to ranges of ``doc_id`` and sorted there, and each range is streamed into files
of at most ``FILE_IDS`` ids (or one document).  Each attempt of a task writes
files of its own names; a manifest table names the files of the attempts that
succeeded, so a lost executor or a second attempt does no harm.

Defined cases: null text is the empty text (it still gets its end id); rows
with a null ``doc_id`` come first, under id -2**63; rows with equal ids follow
each other by the number of their tokens, then by their packed ids (rows that
are equal in these too are stored alike); an empty table gives no files and an empty manifest.
Columns other than the id and the text are not stored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import WORD_END, Memo
from quarry.llm.common import open_fs, partitions, ragged, range_bounds, shared_dir, slices, stored

MAGIC = b"QTOKENS1"
BLOCK = 4096
FILE_IDS = 4 << 20
#: Words that may part others which are encoded together.
MARKS = "0123456789"
NULL_ID = -(1 << 63)


def width_of(size: int) -> int:
    """The fewest bits that hold ids below a vocabulary size."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, lowest bit first, in whole bytes at the end."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | np.ndarray, count: int, bits: int) -> np.ndarray:
    """The first ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return spread @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def dump(doc_ids: list[int], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """A whole file."""
    blocks = [pack(ids[k : k + BLOCK], bits) for k in range(0, len(ids), BLOCK)]
    head = MAGIC + np.array([bits, BLOCK, len(doc_ids), len(blocks)], dtype="<u4").tobytes() + np.array([len(ids)], dtype="<u8").tobytes()
    tables = np.array(doc_ids, dtype="<i8").tobytes() + np.cumsum(lengths, dtype=np.uint64).astype("<u8").tobytes() + np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes()
    return head + tables + b"".join(blocks)


class TokenFile:
    """Random access to a file's documents and ids; reads only what is asked for."""

    def __init__(self, path: str) -> None:
        fs, at = open_fs(path)
        self.file = fs.open_input_file(at)
        head = self.file.read_at(32, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.bits, self.block, n, blocks = np.frombuffer(head, dtype="<u4", count=4, offset=8).tolist()
        self.n_ids = int(np.frombuffer(head, dtype="<u8", count=1, offset=24)[0])
        tables = self.file.read_at(8 * (2 * n + blocks + 1), 32)
        self.doc_ids = np.frombuffer(tables, dtype="<i8", count=n)
        self.ends = np.frombuffer(tables, dtype="<u8", count=n, offset=8 * n).astype(np.int64)
        self.offsets = np.frombuffer(tables, dtype="<u8", count=blocks + 1, offset=16 * n).astype(np.int64)
        self.data = 32 + len(tables)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from one place to another."""
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        raw = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), self.data + int(self.offsets[first]))
        if self.block * self.bits % 8 == 0:  # blocks lie back to back
            got = unpack(raw, min((last + 1) * self.block, self.n_ids) - first * self.block, self.bits)
        else:
            cuts = self.offsets[first : last + 2] - self.offsets[first]
            got = np.concatenate([unpack(raw[a:b], min(self.block, self.n_ids - (first + i) * self.block), self.bits) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
        return got[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        """Ids of the document at a place in the file."""
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def close(self) -> None:
        self.file.close()


@lru_cache(maxsize=2)
def library(path: str):  # noqa: ANN201
    """The tokenizer of the tokenizers library, with truncation and padding off."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def memo(path: str) -> Memo:
    """Ids by the tokenizers library, for pieces between ASCII white space, which its pattern never joins.

    Pieces go through the library many at a time.  A piece of letters alone is
    one word there, so the tokens that end words part such pieces.  Others are
    parted by a digit that none of them holds and that is one token.
    """
    t = library(path)
    ends_word = np.zeros(t.get_vocab_size(with_added_tokens=True) + 1, dtype=bool)
    for token, i in t.get_vocab(with_added_tokens=False).items():
        ends_word[i] = token.endswith(WORD_END)
    marks = {d: ids[0] for d in MARKS if len(ids := t.encode(d, add_special_tokens=False).ids) == 1}

    def letters(group: list[str], ids: np.ndarray) -> np.ndarray | None:
        last = np.flatnonzero(ends_word[ids]) + 1
        return np.diff(last, prepend=0) if len(last) == len(group) and (not len(ids) or last[-1] == len(ids)) else None

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        counts = np.zeros(len(texts), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # places of pieces, their ids one after another
        todo = {"": [i for i, w in enumerate(texts) if w.isalpha()]}
        rest = [i for i, w in enumerate(texts) if not w.isalpha()]

        def run(mark: str, places: list[int]) -> list[int]:
            """Encodes pieces; those that could not be parted are returned."""
            failed: list[int] = []
            groups = [places[k : k + 256] for k in range(0, len(places), 256)]
            for group, e in zip(groups, t.encode_batch_fast([f" {mark} ".join([texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=np.int32)
                if mark:
                    cut = np.flatnonzero(ids == marks[mark])
                    sizes = np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1 if len(cut) == len(group) - 1 else None
                    ids = np.delete(ids, cut)
                else:
                    sizes = letters(group, ids)
                if sizes is None:
                    failed += group
                else:
                    counts[group] = sizes
                    found.append((np.array(group), ids))
            return failed

        rest += run("", todo[""])
        for mark in marks:
            rest = [i for i in rest if mark in texts[i]] + run(mark, [i for i in rest if mark not in texts[i]]) if rest else rest
        for i, e in zip(rest, t.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            counts[i] = len(e.ids)
            found.append((np.array([i]), np.array(e.ids, dtype=np.int32)))
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        for places, ids in found:
            out[ragged((ends - counts)[places], counts[places])] = ids
        return out, counts

    return Memo(encode, 800_000)


def write(spark: SparkSession, df: DataFrame, tokenizer: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes a table's texts as token files in ascending order of the key; the files' manifest, with ``start``: ids before each file.

    Columns: path, range, seq, n_docs, n_ids, n_bytes, start.
    """
    n = partitions(spark, df)
    bounds = range_bounds(df, key, n)
    firsts = np.array(bounds, dtype=np.int64)
    bits = width_of(max(end_id + 1, library(tokenizer).get_vocab_size(with_added_tokens=True)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            ids, ends = memo(tokenizer).lookup(texts)
            at = np.concatenate(([0], ends))
            packed = [pack(np.append(ids[a:b], end_id), bits) for a, b in zip(at, at[1:], strict=False)]
            where = np.maximum(0, np.searchsorted(firsts, np.asarray(batch.column(0).fill_null(NULL_ID)), side="right") - 1)
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), batch.column(0), pa.array(np.diff(at) + 1, type=pa.int64()), pa.array(packed, type=pa.binary())], names=["at", "key", "n", "packed"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        docs: list[int] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        seq = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            name = f"{where:06d}-{seq:05d}-{uuid.uuid4().hex}.tokens"
            data = dump(docs, lengths, np.concatenate(parts), bits)
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            row = pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "range": where, "seq": seq, "n_docs": len(docs), "n_ids": held, "n_bytes": len(data)}], schema=pa.schema([("path", pa.string()), ("range", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))
            seq, held = seq + 1, 0
            docs.clear(), lengths.clear(), parts.clear()
            return row

        where = -1
        for batch in batches:
            for at, doc, count, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if docs and (at != where or held + count > FILE_IDS):
                    yield flush()
                where = at
                docs.append(NULL_ID if doc is None else doc)
                lengths.append(count)
                parts.append(unpack(packed, count, bits))
                held += count
        if docs:
            yield flush()

    open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dealt = rows.mapInArrow(encode, "at int, key long, n long, packed binary").repartitionById(len(bounds), "at").sortWithinPartitions(F.asc_nulls_first("key"), "n", "packed")
    files = stored(spark, dealt.mapInArrow(save, "path string, range int, seq int, n_docs long, n_ids long, n_bytes long"), f"{folder}/manifest")
    before = (
        files.groupBy(F.col("range").alias("_range")).agg(F.sum("n_ids").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("_inner", inner).join(before, F.col("range") == F.col("_range")).select(*files.columns, (F.col("_before") + F.col("_inner")).alias("start"))


def read(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of token files: key, start (ids before it), n_tokens, ids_crc32 (of its ids as little-endian u32) and the ids themselves."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(path)
                for low in range(0, len(f.ends), 512):
                    ends = f.ends[low : low + 512]
                    first = int(f.ends[low - 1]) if low else 0
                    ids = f.ids(first, int(ends[-1])).astype("<u4")
                    starts = np.concatenate(([first], ends[:-1]))
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts - first, ends - first, strict=True)]
                    keys = f.doc_ids[low : low + 512]
                    columns = [pa.array(keys, mask=keys == NULL_ID, type=pa.int64()), pa.array(starts + start, type=pa.int64()), pa.array(ends - starts, type=pa.int64()), pa.array(crc, type=pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]) - first, type=pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                f.close()

    fields = "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return manifest.select("path", "start").repartition(partitions(spark, manifest), "path").mapInArrow(load, fields)


def folder(spark: SparkSession) -> str:
    return shared_dir(spark, "tokens")
