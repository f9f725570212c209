"""Media columns: content-defined chunks of payloads, stored once (operator 7).

* A payload is cut where a rolling gear hash of the last 32 bytes has its
  upper bits zero, between ``LEAST`` and ``MOST`` bytes after the last cut, so
  equal passages give equal chunks wherever they stand.
* A task appends chunks that are new to it to *packs*: files of compressed
  chunks in the shared folder.  An aggregation then picks one place for each
  chunk digest over all packs; the other copies are dead, and ``compact``
  rewrites the packs that have many of them and deletes the old ones.
* A medium is an ordered list of chunk digests.  Media that were written one
  after another are read by one task: it asks once for each digest of all of
  them (so that a chunk in most media is no hot key), a Spark join gives the
  places, and places that lie near each other in a pack are fetched in one read.
  Each chunk is checked against its digest, and each medium against the digest
  that was taken when it was written.

The stored form of a medium, which ``media_bytes`` and ``media_sha256``
describe, is its container: magic, counts, the table of chunk lengths and
SHA-256 digests, and the chunks in order, before compression and sharing.

Pack files are named by task attempt; only those named in tables that
succeeded are read.

Defined cases: null payload text counts as empty and is one block of padding;
equal texts give equal values; repeated rows and ids are stored once and read
for each row; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import open_fs, partitions, shared_dir, slices, stored

BLOCK = 192
PAD = b" "
LEAST, MOST = 512, 8192
#: Upper bits of the gear hash that are zero at a cut: one place in 2048.
CUT_BITS = 11
PACK_BYTES = 8 << 20
#: Media, and bytes of them, that are read together.
READ_ROWS, READ_BYTES = 1024, 8 << 20
#: Places at most so far apart are fetched in one read.
GAP = 64 << 10
#: A pack is worth rewriting if this share of it is dead copies.
DEAD = 0.1
MAGIC = b"QMEDIA01"
SEED = 20_011
_GEAR = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload(text: bytes | None) -> bytes:
    """The text's bytes, padded to a positive multiple of the block."""
    raw = text or b""
    return raw + PAD * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 32 bytes that end at each place, by doubling the window."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h = nxt
    return h


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each payload."""
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    marks = np.flatnonzero((gear(data) >> np.uint32(32 - CUT_BITS)) == 0) + 1 if len(data) > 32 else np.zeros(0, dtype=np.int64)
    out, start = [], 0
    for p in payloads:
        low, high = np.searchsorted(marks, [start, start + len(p)])
        own = (marks[low:high] - start).tolist()
        ends, last = [], 0
        for m in own:
            while m - last > MOST:
                last += MOST
                ends.append(last)
            if m - last >= LEAST:
                last = m
                ends.append(last)
        while len(p) - last > MOST:
            last += MOST
            ends.append(last)
        if last < len(p):
            ends.append(len(p))
        out.append(ends)
        start += len(p)
    return out


def container(digests: list[bytes], chunks: list[bytes]) -> bytes:
    """The stored form of a medium."""
    head = MAGIC + np.array([len(chunks), sum(map(len, chunks))], dtype="<u8").tobytes()
    return head + np.array([len(c) for c in chunks], dtype="<u4").tobytes() + b"".join(digests) + b"".join(chunks)


def features(data: bytes) -> str:
    """Mean, deviation, entropy, crossings of the mean and the commonest sample of 8-bit samples."""
    x = np.frombuffer(data, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    above = x > x.mean()
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};crossings={int((above[1:] != above[:-1]).sum())};mode={int(counts.argmax())}"


def write(spark: SparkSession, df: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stores a table's payloads; the media (key, n_bytes, media_sha256, near, chunks) and the places of their chunks (digest, pack, at, size). Media of one ``near`` are read together."""
    open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        squeeze = zstandard.ZstdCompressor(level=3)
        blobs: list[bytes] = []
        known: dict[bytes, tuple[str, int, int]] = {}
        size, pack = 0, uuid.uuid4().hex
        near, rows_near, bytes_near = uuid.uuid4().int >> 65, 0, 0

        def flush() -> None:
            nonlocal size, pack
            with fs.open_output_stream(f"{base}/{pack}.pack") as f:
                for b in blobs:
                    f.write(b)
            blobs.clear(), known.clear()
            size, pack = 0, uuid.uuid4().hex

        for batch, texts in slices(batches, "text"):
            rows = []
            payloads = [payload(t) for t in texts]
            for doc, t, p, ends in zip(batch.column(0).to_pylist(), texts, payloads, cuts(payloads), strict=True):
                chunks = [p[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                digests = [hashlib.sha256(c).digest() for c in chunks]
                refs = []
                for d, c in zip(digests, chunks, strict=True):
                    if (place := known.get(d)) is None:
                        blob = squeeze.compress(c)
                        place = known[d] = (pack, size, len(blob))
                        blobs.append(blob)
                        size += len(blob)
                    refs.append({"digest": d, "pack": place[0], "at": place[1], "size": place[2]})
                if rows_near >= READ_ROWS or rows_near and bytes_near + len(p) > READ_BYTES:
                    near, rows_near, bytes_near = uuid.uuid4().int >> 65, 0, 0
                rows_near, bytes_near = rows_near + 1, bytes_near + len(p)
                rows.append({"key": doc, "n_bytes": len(t or b""), "media_sha256": hashlib.sha256(container(digests, chunks)).hexdigest(), "near": near, "chunks": refs})
                if size >= PACK_BYTES:
                    flush()
            ref = pa.struct([("digest", pa.binary()), ("pack", pa.string()), ("at", pa.int64()), ("size", pa.int32())])
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.string()), ("near", pa.int64()), ("chunks", pa.list_(ref))]))
        if blobs:
            flush()

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    media = stored(spark, rows.mapInArrow(run, "key long, n_bytes long, media_sha256 string, near long, chunks array<struct<digest:binary,pack:string,at:long,size:int>>"), f"{folder}/media")
    places = media.select(F.explode("chunks").alias("c")).groupBy("c.digest").agg(F.min(F.struct("c.pack", "c.at", "c.size")).alias("place")).select("digest", "place.*")
    return media, places


def read(spark: SparkSession, media: DataFrame, places: DataFrame, folder: str, described: bool = False) -> DataFrame:
    """Rebuilds and verifies every medium: key, n_bytes, media_sha256, media_bytes and payload.

    With ``described``, digests and features of the payload as read back stand
    in its place: payload_bytes, payload_sha256, tail_crc32 and feature.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = {(near, d): None for near, digests in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for d in digests}
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in wanted], type=pa.int64()), pa.array([d for _, d in wanted], type=pa.binary())], names=["near", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        grow = zstandard.ZstdDecompressor()
        blobs: dict[bytes, bytes] = {}
        places: dict[bytes, tuple[str, int, int]] = {}
        now: int | None = None

        def fetch() -> None:
            """The chunks of a group, in as few reads as their places allow."""
            blobs.clear()
            todo = sorted((pack, at, size, digest) for digest, (pack, at, size) in places.items())
            i = 0
            while i < len(todo):
                pack, start, _, _ = todo[i]
                j, stop = i, start
                while j < len(todo) and todo[j][0] == pack and todo[j][1] <= stop + GAP:
                    stop = todo[j][1] + todo[j][2]
                    j += 1
                with fs.open_input_file(f"{base}/{pack}.pack") as f:
                    data = f.read_at(stop - start, start)
                for _, at, size, digest in todo[i:j]:
                    blobs[digest] = data[at - start : at - start + size]
                i = j

        def rebuilt(rows: list[tuple]) -> pa.RecordBatch:
            data, sizes = [], []
            for *_, stated, digests in rows:
                chunks = [grow.decompress(blobs[d], max_output_size=MOST) for d in digests]
                whole = container(digests, chunks)
                if [hashlib.sha256(c).digest() for c in chunks] != digests or hashlib.sha256(whole).hexdigest() != stated:
                    raise ValueError("a stored medium does not match its digests")
                data.append(b"".join(chunks))
                sizes.append(len(whole))
            columns = {"key": pa.array([r[0] for r in rows], type=pa.int64()), "n_bytes": pa.array([r[1] for r in rows], type=pa.int64()), "media_sha256": pa.array([r[2] for r in rows], type=pa.string()), "media_bytes": pa.array(sizes, type=pa.int64())}
            if described:
                columns["payload_bytes"] = pa.array([len(p) for p in data], type=pa.int64())
                columns["payload_sha256"] = pa.array([hashlib.sha256(p).hexdigest() for p in data], type=pa.string())
                columns["tail_crc32"] = pa.array([zlib.crc32(p[-16:]) for p in data], type=pa.int64())
                columns["feature"] = pa.array([features(p) for p in data], type=pa.string())
            else:
                columns["payload"] = pa.array(data, type=pa.binary())
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            held: list[tuple] = []
            for near, key, n_bytes, stated, digests, pack, at, size in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if near != now or held and (pack is not None or len(held) >= 64):
                    if held:
                        yield rebuilt(held)
                        held = []
                if near != now:
                    now = near
                    places.clear(), blobs.clear()
                if pack is not None:
                    places[digests[0]] = (pack, at, size)
                    continue
                if not blobs:
                    fetch()
                held.append((key, n_bytes, stated, digests))
            if held:
                yield rebuilt(held)

    lists = media.select("near", "key", "n_bytes", "media_sha256", F.transform("chunks", lambda c: c["digest"]).alias("digests"))
    found = lists.select("near", "digests").mapInArrow(ask, "near long, digest binary").join(places, "digest")
    place = found.select("near", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("string").alias("media_sha256"), F.array("digest").alias("digests"), "pack", "at", "size")
    asked = lists.select("*", F.lit(None).cast("string").alias("pack"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("size"))
    # the places of a group come before its media
    ordered = place.unionAll(asked).repartition(partitions(spark, media), "near").sortWithinPartitions("near", F.asc_nulls_last("pack"))
    shown = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string" if described else "payload binary"
    return ordered.mapInArrow(run, "key long, n_bytes long, media_sha256 string, media_bytes long, " + shown)


def compact(spark: SparkSession, media: DataFrame, places: DataFrame, folder: str, dead: float = DEAD) -> DataFrame:
    """Rewrites the packs of which at least such a share is dead copies, with live chunks only, and deletes the old ones; the new places, which alone are valid from then on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        for batch in batches:
            for old, refs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new, at, rows = uuid.uuid4().hex, 0, []
                with fs.open_input_file(f"{base}/{old}.pack") as f:
                    src = f.read()  # not much over ``PACK_BYTES``, unless one text is longer
                with fs.open_output_stream(f"{base}/{new}.pack") as out:
                    for r in sorted(refs, key=lambda r: r["at"]):
                        out.write(src[r["at"] : r["at"] + r["size"]])
                        rows.append({"digest": r["digest"], "pack": new, "at": at, "size": r["size"]})
                        at += r["size"]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("digest", pa.binary()), ("pack", pa.string()), ("at", pa.int64()), ("size", pa.int32())]))

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        for batch in batches:
            for old in batch.column(0).to_pylist():
                if fs.get_file_info(f"{base}/{old}.pack").type == pafs.FileType.File:  # not yet deleted by another attempt
                    fs.delete_file(f"{base}/{old}.pack")
            yield batch

    size = media.select(F.explode("chunks").alias("c")).groupBy(F.col("c.pack").alias("pack")).agg(F.max(F.col("c.at") + F.col("c.size")).alias("whole"))
    live = places.groupBy("pack").agg(F.sum("size").alias("live"), F.collect_list(F.struct("digest", "at", "size")).alias("refs"))
    wasted = F.col("whole") - F.coalesce("live", F.lit(0))
    chosen = stored(spark, size.join(live, "pack", "left").where((wasted > 0) & (wasted >= dead * F.col("whole"))).select("pack", "refs"), f"{folder}/chosen-{uuid.uuid4().hex}")
    moved = chosen.where("refs is not null").mapInArrow(run, "digest binary, pack string, at long, size int")
    out = stored(spark, places.join(chosen.select("pack"), "pack", "left_anti").select("digest", "pack", "at", "size").unionAll(moved), f"{folder}/places-{uuid.uuid4().hex}")
    chosen.select("pack").mapInArrow(delete, "pack string").count()
    return out


def folder(spark: SparkSession) -> str:
    return shared_dir(spark, "media")
