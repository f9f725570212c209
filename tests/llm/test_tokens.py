import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from quarry.llm import bpe, token_counts, tokenfile  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = list("abcdefghijklmnopqrstuvwxyzABC '’s’tre ll\t\n  .,;:!?<|>endoftextÉéüßñçèêΣσςİǅıſ😀👍🏽中文日本語한국어0123²Ⅷ½́̈​\x1c\x85\xa0 　")


@pytest.fixture(scope="module")
def library():
    return tokenfile.library(PATH)


def fuzz(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choices(LETTERS, k=r.randint(0, 50))) for _ in range(n)] + ["", "a<|endoftext|>b <|startoftext|>", "<|endoftext", "0123456789 a1234567890b", "x" * 3000]


@pytest.mark.parametrize("memo", [bpe.memo, tokenfile.memo])
def test_ids_are_those_of_the_library(memo, library):
    texts = fuzz(1500)
    ids, ends = memo(PATH).lookup([t.encode() for t in texts])
    starts = [0, *ends[:-1]]
    for t, a, b in zip(texts, starts, ends, strict=True):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_decoding_is_that_of_the_library(library):
    texts = fuzz(300, 2)
    ids, ends = bpe.memo(PATH).lookup([t.encode() for t in texts])
    data, stops = bpe.vocabulary(PATH).decode(ids, ends)
    data = data.tobytes()
    for a, b, c, d in zip([0, *ends[:-1]], ends, [0, *stops[:-1]], stops, strict=True):
        assert data[c:d].decode() == library.decode(ids[a:b].tolist(), skip_special_tokens=False)
    with pytest.raises(IndexError):
        bpe.vocabulary(PATH).decode(np.array([10**6]), np.array([1]))


def test_every_token_encodes_to_itself():
    v = bpe.vocabulary(PATH)
    r = random.Random(4)
    for s in r.sample(v.text, 2000):
        parts = [v.rank[c] for c in s]
        while len(parts) > 1:
            best = min((v.merge.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        assert parts == [v.rank[s]]


def test_memo_starts_afresh_when_full():
    m = bpe.Memo(lambda words: (np.array([len(w) for w in words], dtype=np.int32), np.ones(len(words), dtype=np.int64)), most=3)
    for text in (b"a bb ccc", b"dddd a", b"e ff ggg hhhh iiiii"):
        ids, ends = m.lookup([text, None])
        assert ids.tolist() == [len(w) for w in text.split()] and ends.tolist() == [len(ids), len(ids)]


def test_columns_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Hello world", "kept"), (2, None, None), (2, "", "x")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert [(r.doc_id, len(r.ids), r.decoded) for r in out.collect()] == [(1, 2, "hello</w> world</w>"), (2, 0, ""), (2, 0, "")]
    assert bpe.encode(df.limit(0), PATH).count() == 0
    assert bpe.decode(bpe.encode(df.withColumnsRenamed({"ids": "Ids"}).withColumn("DECODED", F.lit(1)), PATH), PATH).columns == ["doc_id", "text", "ids", "decoded"]


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_packing_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint32)
    data = tokenfile.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (tokenfile.unpack(data, 1001, bits) == ids).all()


@pytest.mark.parametrize("bits", [16, 17])
def test_random_access(tmp_path, bits):
    ids = np.random.default_rng(1).integers(0, 1 << 16, 10_000, dtype=np.uint32)
    lengths = [0, 4096, 1, 903, 5000]
    (tmp_path / "f").write_bytes(tokenfile.dump([5, 6, 7, 8, 9], lengths, ids, bits))
    f = tokenfile.TokenFile(str(tmp_path / "f"))
    ends = np.cumsum(lengths)
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        assert (f.document(k) == ids[a:b]).all()
    assert (f.ids(4000, 9000) == ids[4000:9000]).all()


def test_token_files_round_trip(spark, library):
    texts = fuzz(200, 6)
    data = [(i * 7, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, None)]
    data += [(14, "tie one"), (14, "tie two words")]
    random.Random(1).shuffle(data)
    order = lambda x: (x[0] is not None, x[0] or 0, len(library.encode(x[1] or "", add_special_tokens=False).ids))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = tokenfile.read(spark, tokenfile.write(spark, df, PATH, 1, tokenfile.folder(spark))).collect()
    start = 0
    for r, (k, t) in zip(sorted(got, key=lambda r: r.start), sorted(data, key=order), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.key, r.start, r.n_tokens, r.ids) == (k, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert tokenfile.read(spark, tokenfile.write(spark, df.limit(0), PATH, 1, tokenfile.folder(spark))).count() == 0


def heights(t):
    if t is None or t.left is None:
        return 0
    a, b = heights(t.left), heights(t.right)
    assert abs(a - b) <= 1 and t.height == 1 + max(a, b)
    return t.height


@pytest.mark.parametrize("letters", ["ab c\n.d'é ", "ab.c'd9sé<|", "一二。三,é", LETTERS])
def test_edits_count_as_a_fresh_encoding(library, letters):
    count = token_counts.counter(PATH)
    r = random.Random(8)
    for _ in range(60):
        text = "".join(r.choices(letters, k=r.choice([0, 3, 300, 1500])))
        assert b"".join(token_counts.leaves_of(text.encode())) == text.encode()
        tree = token_counts.TokenTree.fresh(text.encode(), count)
        for k in range(8):
            a = r.randint(0, len(text))
            b = r.choice([a, min(len(text), a + r.randint(0, 60)), r.randint(a, len(text)), len(text)])
            new = "".join(r.choices([*letters, "<|endoftext|>", "<", "\u0301", "'s"], k=r.choice([0, 1, 12, 700])))
            tree.replace(a, b, new.encode())
            text = text[:a] + new + text[b:]
            assert tree.text() == text.encode()
            assert tree.total == len(library.encode(text, add_special_tokens=False).ids)
            assert tree.root is None or tree.root.chars == len(text)
            heights(tree.root)
            if k == 4:
                tree = token_counts.TokenTree.kept(text.encode(), tree.table(), count)


def test_long_texts_are_cut_in_linear_time():
    count = token_counts.counter(PATH)
    for text in (b" " * 1_000_000, b"x" * 1_000_000, b"ab1!" * 250_000, b"<" * 1_000_000, "。五".encode() * 150_000):
        start = time.perf_counter()
        pieces = token_counts.leaves_of(text)
        assert time.perf_counter() - start < 1 and b"".join(pieces) == text
        assert len(pieces) > 1000 or text[:1] in b"x<"
    tree = token_counts.TokenTree.fresh(b"one two three " * 5000, count)
    tree.replace(35_000, 35_000, b"many more words " * 10_000)
    assert max(t.bytes for t in tree.leaves()) < 3 * token_counts.LEAF
    done = tree.encoded
    start = time.perf_counter()
    for k in range(200):
        tree.replace(1000 * k, 1000 * k + 1, b"y")
    assert tree.encoded - done <= 600 and time.perf_counter() - start < 1


def test_kept_trees_are_not_encoded_again(spark):
    df = spark.createDataFrame([(1, "one two three " * 200), (2, None), (3, "")], "doc_id long, text string").withColumn("TREE", F.lit("clash"))
    kept = token_counts.trees(df, PATH)
    assert kept.columns == ["doc_id", "text", "n_tokens", "tree"]
    for r in kept.collect():
        def count(pieces):
            raise AssertionError

        tree = token_counts.TokenTree.kept((r.text or "").encode(), bytes(r.tree), count)
        assert tree.total == r.n_tokens and tree.text() == (r.text or "").encode()
    edits = kept.withColumn("edits", token_counts.trial_edits("text"))
    one = token_counts.edited_counts(edits, PATH, tree="tree").drop("tree").collect()
    assert one == token_counts.edited_counts(edits, PATH).drop("tree").collect()
    last = token_counts.edited_counts(edits, PATH, tree="tree", last=True)
    assert last.columns == ["doc_id", "n_tokens", "n_tokens_edited", "n_pieces", "n_encoded", "edited"]
    assert [tuple(r) for r in last.collect()] == [(r.doc_id, r.n_tokens, r.n_tokens_edited, r.n_pieces, r.n_encoded, r.edited) for r in one]
    again = token_counts.edited_counts(edits, PATH, tree="tree").select("doc_id", F.col("edited").alias("text"), F.col("edited_tree").alias("tree")).withColumn("edits", token_counts.trial_edits("text"))
    for r in token_counts.edited_counts(again, PATH, tree="tree").collect():
        assert r.n_tokens_edited == token_counts.TokenTree.fresh(r.edited.encode(), token_counts.counter(PATH)).total


def test_edit_column(spark, library):
    df = spark.createDataFrame([(1, "one two three " * 20), (2, None), (3, "")], "doc_id long, text string").withColumn("edits", token_counts.trial_edits("text"))
    for r in token_counts.edited_counts(df, PATH).collect():
        text = r.text or ""
        for e in r.edits:
            a, b = min(e["start"], len(text)), min(max(e["start"], e["stop"]), len(text))
            text = text[:a] + e["insert"] + text[b:]
        assert r.edited == text
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_tokens_edited == len(library.encode(text, add_special_tokens=False).ids)
    none = df.withColumn("edits", F.lit(None).cast("array<struct<start:int,stop:int,insert:string>>"))
    assert all(r.n_tokens == r.n_tokens_edited and r.n_encoded == 0 for r in token_counts.edited_counts(none, PATH).collect())


def test_query_digests(spark, library):
    from quarry.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op1_bpe_roundtrip(spark, folder).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    counts = dict(map(tuple, queries.op10_token_counts(spark, folder).select("doc_id", "n_tokens").collect()))
    assert counts == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
