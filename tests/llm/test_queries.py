import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import fingerprint, media, packing, queries, tokenfile

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(db.sql(queries.ORACLE_SQL[name]).select(", ".join(columns)).fetchall())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def test_op3_is_brute_force(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op3_fingerprints"](spark, FOLDER).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        a, b, r = texts[i], texts[j], got[i]
        half = len(a) // 2
        edit = a[: len(a) - half] + b[:half]
        p = fingerprint.fingerprints([x.encode() for x in (a, edit, b)])
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(a), hashlib.sha256(edit.encode()).hexdigest(), *fingerprint.shown(p[:2]))
        assert r.near_edited == (p[0] == p[1]).mean() and r.near_next == (p[0] == p[2]).mean()


def test_op4_covers_every_document(spark, texts):
    got = queries.QUERIES["op4_toxicity"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(0 <= p <= 1 for r in got for p in (r.p_low_quality, r.p_toxic))


def test_op5_is_brute_force(spark, texts):
    library = tokenfile.library(queries.tokenizer_path())
    start, want = 0, []
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = queries.QUERIES["op5_token_files"](spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_op7_is_brute_force(spark, texts):
    got = queries.QUERIES["op7_media_chunks"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        data = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        ends = media.cuts([data])[0]
        chunks = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        whole = media.container([hashlib.sha256(c).digest() for c in chunks], chunks)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(whole), hashlib.sha256(whole).hexdigest(), media.features(data))


def test_op8_is_brute_force(spark, texts):
    got = sorted(queries.QUERIES["op8_shards"](spark, FOLDER).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.size, r.text_crc32, r.law) for r in got] == [(i, len(texts[i].encode()) + 1, zlib.crc32(texts[i].encode()), "key") for i in sorted(texts)]
    slots = {}
    for r in got:
        assert r.slot == slots.get(r.shard, 0) and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        slots[r.shard] = r.slot + 1


def test_op9_is_brute_force(spark, texts):
    got = queries.QUERIES["op9_packing"](spark, FOLDER).collect()
    lengths = {i: len(t.encode().split()) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in got} == lengths
    histogram = Counter(lengths.values())
    sizes = sorted(histogram)
    best = [[0] + [1 << 60] * len(sizes)]  # least padding of the first j lengths, by number of buckets
    for _ in range(packing.BUCKETS):
        row = [0]
        for j in range(1, len(sizes) + 1):
            cost, least = 0, 1 << 60
            for i in range(j - 1, -1, -1):
                cost += histogram[sizes[i]] * (sizes[j - 1] - sizes[i])
                least = min(least, best[-1][i] + cost)
            row.append(least)
        best.append(row)
    assert sum(r.padding for r in got) == min(b[-1] for b in best[1:])
    place = {}
    for r in sorted(got, key=lambda r: (r.bucket, r.doc_id)):
        assert r.padding == r.bucket_length - r.n_tokens >= 0
        rows = max(1, packing.BUDGET // max(1, r.bucket_length))
        at = place.get(r.bucket, 0)
        assert (r.batch, r.place) == divmod(at, rows)
        place[r.bucket] = at + 1
