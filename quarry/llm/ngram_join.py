"""Exact n-gram Jaccard self-join by token-combination prefixes (operator 6).

A document's set holds the distinct shingles of five words.  Documents with
equal sets form one class; classes are joined, documents follow their class.
A class is named by 64 bits of its set, and a second, independent 64 bits are
compared for all documents of a name; sets that share a name but not the second
half are named by that one.  So sets are told apart by 128 bits.

1. Documents are parked in blocks.  A block sends each of its shingles once, as
   a 64-bit hash with the number of its classes that have it, to a range of
   hashes, so that a shingle of all documents is a row a block.  There the
   numbers are summed up, and the block is told which of its shingles occur
   again, and how often (copies of a class in several blocks count as often).
   A shingle that no other document has can be in no intersection; only its
   number matters.  Each class is then worked on in one block that has it.
2. Tokens of a set are ordered by count, ties by hash.  Two sets of a
   similarity of 0.8 share t = ceil(0.8 n) tokens of either set of n tokens.
   Rare tokens are indexed alone; frequent ones (in over ``FREQUENT`` classes)
   fall into groups by hash and are indexed in pairs of one group.  There are
   ``SUBCLASSES`` groups, and for large sets a power of two that grows with the
   prefix, so that its pairs grow no faster than the prefix; a set uses the
   numbers of groups of all sizes that may be similar to it.  The prefix is
   extended until its rare tokens, plus for each group
   one less than the group's tokens, reach n - t + 1.  Then two similar sets
   share a rare token or two frequent ones of a group within the shorter
   prefix, so they meet under some signature.  Sets too small to reach that
   sum, and those that may be similar to such, also index single tokens of the
   plain prefix.
3. A signature's hub is found by an aggregation, and joined back in ``SALTS``
   parts, so that a signature of many sets is not one task's.  Sets under one
   signature are compared with their hub, the set with the most
   frequent tokens, if their sizes and the numbers of tokens after the
   signature allow the similarity.  Sets that are linked by then are not
   compared again.  Every other pair under a signature is, unless a bound rules
   it out: two sets share at most the lesser of what each shares with the hub,
   plus the lesser of their other tokens that any set shares.  They also share
   no more than a set's tokens less the bits that only its bitmap has; bitmaps
   have ``BITS`` places, so they rule out little between very large sets.  That
   settles copies which lie just below the similarity without comparing all of
   them, and no link between components is lost.

Intersections are counted on the shared tokens of both sets, which is exact up
to collisions of 64-bit hashes.

Defined cases: null or empty texts have the empty set, which is linked with
nothing; texts with fewer words than a shingle have one token, their whole
sequence; rows with equal texts and repeated ids are linked; rows with a null
id are counted but get a null component unless another row of it has an id;
extra columns are kept by ``component_filter``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.blocks import park, read_block
from quarry.llm.common import MOST_RANGES, free, mix, partitions, released, releasing, shared_dir, size_of, slices, stored
from quarry.llm.windows import U64, expand, expand_sorted, part_cuts, shingles, squeeze, squeeze_sorted

Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

SHINGLE = 5
#: Least similarity, as a share of 100.
PERCENT = 80
FREQUENT = 64
SUBCLASSES = 8
#: Sets of at most so many tokens may not reach the sum of rule 2; with those that may be similar to them, they index single tokens too. See ``small_size`` for lower similarities.
SMALL = 14
#: Places of the bitmap of a set's tokens; a multiple of 64.
BITS = 512
#: Parts of the sets under a signature.
SALTS = 8
#: Bytes of text (as the planner estimates them) whose tokens a range counts at a time.
PIECE_BYTES = 16 << 20
#: Rows between the steps: kind, the block or range that it belongs to, its piece, and what it holds.
ROW = "kind int, to long, at long, a binary, b binary, c binary, d binary, e binary"
MEMBERS, TOKENS, ANSWERS, OWNED = range(4)


def needed(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n shares with any set that is similar to it."""
    return -(-percent * n // 100)


def small_size(percent: int = PERCENT, subclasses: int = SUBCLASSES) -> int:
    """``SMALL``, or the size of the largest partner of the largest set that needs no more shared tokens than there are subclasses."""
    return max(SMALL, 100 * (100 * subclasses // max(1, percent)) // max(1, percent))


def subclasses_of(n: int, percent: int = PERCENT) -> int:
    """How many groups the frequent tokens of a set of n fall into: about a quarter of the tokens that its partners may lack."""
    return max(SUBCLASSES, 1 << max(0, ((n - needed(n, percent) + 1) // 4).bit_length() - 1))


def systems_of(n: int, percent: int = PERCENT) -> list[int]:
    """The numbers of groups of all sizes that may be similar to n."""
    low, high = subclasses_of(needed(n, percent), percent), subclasses_of(max(n, 100 * n // max(1, percent)), percent)
    return [low << i for i in range((high // low).bit_length())]


def _digest(tokens: np.ndarray, salt: int) -> int:
    return int(mix(mix(tokens ^ U64(salt)).sum(dtype=U64, keepdims=True) + U64(len(tokens))).view(np.int64)[0])


def check_of(tokens: np.ndarray) -> int:
    """The second half of a set's name."""
    return _digest(tokens, 0x2545F4914F6CDD1D)


def class_of(tokens: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """A 64-bit name of a set: equal for equal sets; the second half where different sets share the first."""
    name = _digest(tokens, 0x5851F42D4C957F2D)
    return check_of(tokens) if name in shared else name


def _sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    return shingles([t.lower().split() if t else [] for t in texts], k)


def _row(kind: int, to: int, at: int, *data: bytes) -> pa.RecordBatch:
    filled = [*data, *[b""] * (5 - len(data))]
    return pa.RecordBatch.from_arrays([pa.array([kind], type=pa.int32()), pa.array([to], type=pa.int64()), pa.array([at], type=pa.int64()), *(pa.array([x], type=pa.binary()) for x in filled)], names=["kind", "to", "at", "a", "b", "c", "d", "e"])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _block_sets(folder: str, name: int, k: int) -> tuple[pa.Table, list[np.ndarray]]:
    table = read_block(folder, name)
    batch = pa.RecordBatch.from_arrays([table.column("text").combine_chunks()], names=["text"])
    return table, [s for _, texts in slices(iter([batch]), "text") for s in _sets(texts, k)]


def _block_tokens(sets: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a block's different sets, ascending, and in how many of them each is; sets of fewer than ``least`` tokens do not count."""
    each = {(class_of(s), check_of(s)): s for s in sets if len(s) >= least}
    if not each:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    return np.unique(np.concatenate(list(each.values())), return_counts=True)


def least_size(percent: int) -> int:
    """Tokens of the smallest set that another one may be similar to."""
    return 2 if percent > 50 else 1


class Sets:
    """The sets of a table of documents: their members, and the tokens that occur in several."""

    def __init__(self, spark: SparkSession, docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> None:
        self.spark, self.folder, self.k, self.least = spark, folder, k, least_size(percent)
        self.n = partitions(spark, docs)
        ranges = min(self.n, MOST_RANGES)
        pieces = max(1, -(-size_of(docs) // (PIECE_BYTES * ranges)))
        cuts, least = part_cuts(ranges * pieces), self.least
        blocks = park(spark, docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), folder, "key", "text")

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    table, sets = _block_sets(folder, name, k)
                    keys = table.column("key").combine_chunks()
                    names, checks = (np.array([of(s) if len(s) else 0 for s in sets], dtype=np.int64) for of in (class_of, check_of))
                    yield _row(MEMBERS, name, 0, np.asarray(keys.fill_null(0), dtype=np.int64).tobytes(), np.asarray(keys.is_valid()).tobytes(), np.array([len(s) for s in sets], dtype=np.int64).tobytes(), names.tobytes(), checks.tobytes())
                    tokens, counts = _block_tokens(sets, least)
                    ends = np.append(np.searchsorted(tokens, cuts[::pieces]), len(tokens))
                    for p in np.flatnonzero(np.diff(ends)).tolist():
                        a, b = ends[p], ends[p + 1]
                        yield _row(TOKENS, p, 0, np.int64(name).tobytes(), squeeze_sorted(tokens[a:b]), squeeze(counts[a:b].astype(np.uint32)))

        def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Tokens of a range by its pieces, so that a range of any size is counted piece by piece."""
            for kind, to, at, *data in _rows(batches):
                if kind != TOKENS:
                    yield _row(kind, to, -1, *data)
                    continue
                tokens, counts = expand_sorted(data[1]), expand(data[2], np.uint32)
                ends = np.append(np.searchsorted(tokens, cuts[to * pieces : (to + 1) * pieces]), len(tokens))
                for p in np.flatnonzero(np.diff(ends)).tolist():
                    a, b = ends[p], ends[p + 1]
                    yield _row(TOKENS, to, p, data[0], squeeze_sorted(tokens[a:b]), squeeze(counts[a:b]))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[bytes, np.ndarray, np.ndarray]] = []
            now = (-1, -1)

            def answers() -> Iterator[pa.RecordBatch]:
                tokens, counts = (np.concatenate([h[i] for h in held]) for i in (1, 2))
                order = np.argsort(tokens)
                first = np.flatnonzero(np.concatenate(([True], tokens[order][1:] != tokens[order][:-1])))
                total = np.empty(len(tokens), dtype=np.int64)
                total[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), first), np.diff(np.append(first, len(tokens))))
                ends = np.cumsum([0, *(len(h[1]) for h in held)])
                for (name, *_), a, b in zip(held, ends, ends[1:], strict=False):
                    again = total[a:b] > 1
                    yield _row(ANSWERS, int(np.frombuffer(name, dtype=np.int64)[0]), now[0] * pieces + now[1], np.packbits(again).tobytes(), squeeze(total[a:b][again]), int(b - a).to_bytes(8, "little"))
                held.clear()

            for kind, to, at, *data in _rows(batches):
                if kind != TOKENS:
                    yield _row(kind, to, at, *data)
                    continue
                if (to, at) != now and held:
                    yield from answers()
                now = (to, at)
                held.append((data[0], expand_sorted(data[1]), expand(data[2], np.uint32)))
            if held:
                yield from answers()

        dealt = blocks.repartitionById(self.n, F.pmod("block", F.lit(self.n)).cast("int")).mapInArrow(releasing(spread), ROW)
        ranged = dealt.repartitionById(ranges, F.pmod("to", F.lit(ranges)).cast("int"))
        if pieces > 1:
            ranged = ranged.mapInArrow(releasing(recut), ROW).sortWithinPartitions("at")
        self.told = stored(spark, ranged.mapInArrow(releasing(count), ROW), f"{folder}/told")
        listed = stored(spark, self.told.where(f"kind = {MEMBERS}").mapInArrow(_listed, "key long, n_shingles long, class long, check long, block long"), f"{folder}/members")
        shared = shared_names(listed)
        name = F.when(F.col("class").isin(list(shared)), F.col("check")).otherwise(F.col("class")) if shared else F.col("class")
        #: key, n_shingles, class (null for the empty set), check and block of each document.
        self.members = listed.select("key", "n_shingles", name.alias("class"), "check", "block")
        self.shared = shared

    def tokens(self, then: Mapper | None = None, schema: str = "class long, n long, tokens binary, counts binary") -> DataFrame:
        """Tokens that occur again, a row for each class: class, n (size of its set), tokens, counts (arrays as bytes, by count and token); or what is made of these rows in the same task."""
        folder, k, least, shared = self.folder, self.k, self.least, self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, owned = -1, np.zeros(0, dtype=np.int64)
            masks: list[np.ndarray] = []
            totals: list[np.ndarray] = []

            def done() -> Iterator[pa.RecordBatch]:
                if not len(owned) or not masks:
                    return
                _, sets = _block_sets(folder, name, k)
                tokens, _ = _block_tokens(sets, least)
                count = np.ones(len(tokens), dtype=np.int64)
                count[np.concatenate(masks)] = np.concatenate(totals)
                todo = set(owned.tolist())
                own: dict[int, np.ndarray] = {}
                for s in sets:
                    if len(s) >= least and (c := class_of(s, shared)) in todo and c not in own:
                        own[c] = s
                if own:
                    yield from _by_class(own, tokens, count)

            for kind, to, _, a, b, c, *_ in _rows(batches):
                if to != name:
                    yield from done()
                    name, owned = to, np.zeros(0, dtype=np.int64)
                    masks.clear(), totals.clear()
                if kind == OWNED:
                    owned = np.frombuffer(a, dtype=np.int64)
                else:
                    masks.append(np.unpackbits(np.frombuffer(a, dtype=np.uint8), count=int.from_bytes(c, "little")).astype(bool))
                    totals.append(expand(b, np.int64))
            yield from done()

        owner = self.members.where("class is not null").groupBy("class").agg(F.min("block").alias("block"))
        owned = owner.repartition(self.n, "block").sortWithinPartitions("block").select("block", "class").mapInArrow(_owned, ROW)
        rows = self.told.where(f"kind = {ANSWERS}").unionAll(owned)
        dealt = rows.repartitionById(self.n, F.pmod("to", F.lit(self.n)).cast("int")).sortWithinPartitions("to", "at", "kind")
        return dealt.mapInArrow(releasing((lambda batches: then(released(run(batches)))) if then else run), schema)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, name, _, keys, known, sizes, names, checks in _rows(batches):
        n = np.frombuffer(sizes, dtype=np.int64)
        columns = [pa.array(np.frombuffer(keys, dtype=np.int64), mask=~np.frombuffer(known, dtype=bool)), pa.array(n), *(pa.array(np.frombuffer(x, dtype=np.int64), mask=n == 0) for x in (names, checks)), pa.array(np.full(len(n), name))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "n_shingles", "class", "check", "block"])


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of each block, which come one after another, as a row."""
    now, held = None, []
    for batch in batches:
        for block, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if block != now and held:
                yield _row(OWNED, now, -1, np.array(held, dtype=np.int64).tobytes())
                held = []
            now = block
            held.append(name)
    if held:
        yield _row(OWNED, now, -1, np.array(held, dtype=np.int64).tobytes())


def shared_names(of: DataFrame) -> frozenset[int]:
    """Names that different sets have; of n sets, n * n / 2**65 are to be expected (270 of 10**11)."""
    return frozenset(r["class"] for r in of.groupBy("class").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("class").collect())


def _by_class(own: dict[int, np.ndarray], known: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each class: its tokens that occur again, by (count, token)."""
    lengths = np.array([len(s) for s in own.values()], dtype=np.int64)
    names = np.fromiter(own, dtype=np.int64, count=len(own))
    tokens, name = np.concatenate(list(own.values())), np.repeat(np.arange(len(own)), lengths)
    counts = count[np.searchsorted(known, tokens)]
    again = counts > 1
    tokens, name, counts = tokens[again], name[again], counts[again]
    order = np.lexsort((tokens, counts, name))
    tokens, name, counts = tokens[order], name[order], counts[order]
    ends = np.append(np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1]))), len(name)) if len(name) else np.zeros(1, dtype=np.int64)
    for j in range(0, len(ends) - 1, 1024):
        cut = ends[j : j + 1025]
        offsets = pa.py_buffer(((cut - cut[0]) * 8).astype(np.int32))
        binary = [pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, offsets, pa.py_buffer(x[cut[0] : cut[-1]].tobytes())]) for x in (tokens, counts)]
        which = name[cut[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(names[which]), pa.array(lengths[which]), *binary], names=["class", "n", "tokens", "counts"])


def signatures(n: int, tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of n tokens, and how many tokens a partner can share at most if that signature is the first in common.

    Given are the tokens that others have too, in ascending order of (count,
    token), with their counts; the others come before them in the order.
    """
    sum_needed = n - needed(n, percent) + 1
    alone = n - len(tokens)
    small = n <= small_size(percent)
    if alone >= sum_needed and not small:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    rare = int(np.searchsorted(counts, frequent, side="right"))
    left = len(tokens) - np.arange(len(tokens))
    single = max(0, min(rare, sum_needed - alone))
    out, rest = [mix(tokens[:single])], [left[:single]]
    have = alone + min(rare, max(0, sum_needed - alone))
    for groups in systems_of(n, percent) if have < sum_needed else ():
        group = (mix(tokens[rare:]) % U64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        first = np.concatenate(([True], group[order][1:] != group[order][:-1])) if len(order) else np.zeros(0, dtype=bool)
        later = np.ones(len(order), dtype=np.int64)
        later[order[first]] = 0  # all tokens of a group but its first count
        stop = int(np.searchsorted(np.cumsum(later), sum_needed - have)) + 1
        for own in np.split(order, np.flatnonzero(first)[1:]):
            own = own[own < stop] + rare
            if len(own) > 1:
                i, j = np.triu_indices(len(own), 1)
                out.append(mix(tokens[own[i]] * U64(3) + mix(tokens[own[j]]) + U64(groups - SUBCLASSES)))
                rest.append(left[own[i]] + groups)  # before it, one token of each group may be shared
    if small:
        first = max(0, sum_needed - alone)
        out.append(mix(tokens[:first] + U64(1)))
        rest.append(left[:first])
    found, place = np.unique(np.concatenate(out), return_index=True)
    return found, np.concatenate(rest)[place]


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The places that a set's tokens fall on, as ``BITS / 64`` integers. Each place that only one of two sets has stands for a token that the other lacks."""
    there = np.zeros(BITS, dtype=np.uint8)
    there[(mix(tokens + U64(2)) % U64(BITS)).astype(np.int64)] = 1
    return np.packbits(there).view(np.int64)


CANDIDATES = "class long, n long, weight double, tokens binary, bits array<long>, signatures array<struct<sig:long,left:int>>"


def candidates(percent: int = PERCENT, frequent: int = FREQUENT) -> Mapper:
    """Of classes with their tokens, those that may be similar to others: class, n, weight, tokens (shared ones, ascending), bits (their bitmap), signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            sigs: list[np.ndarray] = []
            lefts: list[np.ndarray] = []
            for name, n, shared, each in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tokens, counts = np.frombuffer(shared, dtype=U64), np.frombuffer(each, dtype=np.int64)
                found, left = signatures(n, tokens, counts, percent, frequent)
                if len(found):
                    rows.append((name, n, float(np.log2(counts).sum()), np.sort(tokens).tobytes(), bitmap(tokens)))
                    sigs.append(found.view(np.int64)), lefts.append(left.astype(np.int32))
            if rows:
                names, sizes, weights, tokens_of, bits = zip(*rows, strict=True)
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(lefts))], names=["sig", "left"])
                ends = pa.array(np.cumsum([0, *map(len, sigs)]), type=pa.int32())
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (BITS // 64), type=pa.int32()), pa.array(np.concatenate(bits)))
                columns = [pa.array(names, type=pa.int64()), pa.array(sizes, type=pa.int64()), pa.array(weights), pa.array(tokens_of, type=pa.binary()), words, pa.ListArray.from_arrays(ends, pairs)]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "n", "weight", "tokens", "bits", "signatures"])

    return run


def compared(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b) of classes, the number of tokens that they share, and whether they are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, ta, tb = (batch.column(i).to_pylist() for i in range(2, 6))
            both = [len(np.intersect1d(np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64), assume_unique=True)) for x, y in zip(ta, tb, strict=True)]
            similar = [100 * s >= percent * (m + n - s) for s, m, n in zip(both, na, nb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, type=pa.int64()), pa.array(similar, type=pa.bool_())], names=["a", "b", "shared", "similar"])

    one, two = (sets.select(F.col("class").alias(s), F.col("n").alias(f"n{s}"), F.col("tokens").alias(f"t{s}")) for s in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(releasing(run), "a long, b long, shared long, similar boolean")


def labels(edges: DataFrame) -> DataFrame:
    """node, root: the least node within two links. Equal roots mean one component, different ones mean nothing."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    two = both.join(one.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("m"))
    return two.select(F.col("a").alias("node"), F.least("a", "m").alias("root"))


def components(spark: SparkSession, edges: DataFrame, folder: str) -> DataFrame:
    """node, root: the least node of each node's component, by alternating large and small stars; edges have columns a, b. Roots themselves are not listed."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    mark = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)))
    seen, step = None, 0
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = stored(spark, small, f"{folder}/{step}")
        step += 1
        got = now.agg(mark).first()
        if got == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = got


def by_signature(rows: DataFrame, *found: Column) -> tuple[DataFrame, DataFrame]:
    """What an aggregation over each signature finds, to be joined back on (sig, part) in ``SALTS`` parts: a signature of many sets is no task's alone."""
    whole = rows.groupBy("sig").agg(*found).withColumn("part", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("part", F.pmod(F.hash("class"), F.lit(SALTS))), whole


def links(spark: SparkSession, all_sets: Sets, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """Links (a, b, shared) between similar classes, enough of them to join their components."""
    folder = all_sets.folder
    found = stored(spark, all_sets.tokens(candidates(percent, frequent), CANDIDATES), f"{folder}/candidates")
    sets = found.select("class", "n", "tokens")
    rows = found.select(F.explode("signatures").alias("s"), "class", "n", "weight", (F.octet_length("tokens") / 8).cast("int").alias("own")).select("s.sig", "s.left", "class", "n", "weight", "own")
    pair = (F.least("class", "class2").alias("a"), F.greatest("class", "class2").alias("b"))
    # sizes, and what is left of both sets, allow the similarity
    enough = lambda x: f"{100 + percent} * {x} >= {percent} * (n + n2)"
    near = f"100 * least(n, n2) >= {percent} * greatest(n, n2) and {enough('least(left, left2)')}"
    rows, hubs = by_signature(rows, F.count("*").alias("met"), F.min(F.struct((-F.col("weight")).alias("w"), "class", "n", "left")).alias("hub"))
    met = rows.join(hubs.where("met > 1"), ["sig", "part"])
    rows = stored(spark, met.select("sig", "left", "class", "n", "own", F.col("hub.class").alias("class2"), F.col("hub.n").alias("n2"), F.col("hub.left").alias("left2")).where("class <> class2"), f"{folder}/signatures")
    first = stored(spark, compared(rows.where(near).select(*pair).distinct(), sets, percent), f"{folder}/hubs")
    known = stored(spark, labels(first.where("similar")), f"{folder}/labels")
    # two sets share at most what either shares with their hub, and of the rest at most the lesser
    shared = first.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("shared").alias("both"))
    rows = rows.join(shared, (F.least("class", "class2") == F.col("_a")) & (F.greatest("class", "class2") == F.col("_b")), "left").select("sig", "left", "class", "n", "own", "both")
    rows = rows.join(known, F.col("class") == F.col("node"), "left").select("sig", "left", "class", "n", "own", "both", F.coalesce("root", "class").alias("root"))
    rows, roots = by_signature(rows, F.min("root").alias("low"), F.max("root").alias("high"))
    split = rows.join(roots.where("low <> high"), ["sig", "part"]).drop("part", "low", "high")
    open_ = stored(spark, split.join(found.select("class", "bits"), "class"), f"{folder}/open")
    other = open_.select("sig", *(F.col(c).alias(f"{c}2") for c in ("class", "n", "left", "own", "both", "root", "bits")))
    bound = f"(both is null or both2 is null or {enough('(least(both, both2) + least(own - both, own2 - both2))')})"
    lacking = lambda x, y: " + ".join(f"bit_count({x}[{i}] & ~{y}[{i}])" for i in range(BITS // 64))
    bitwise = enough(f"least(own - ({lacking('bits', 'bits2')}), own2 - ({lacking('bits2', 'bits')}))")
    pairs = open_.join(other, "sig").where(f"class < class2 and root <> root2 and {near} and {bound} and {bitwise}").select(*pair).distinct()
    rest = stored(spark, compared(pairs, sets, percent), f"{folder}/rest")
    edges = first.unionAll(rest).where("similar").select("a", "b", "shared")
    return edges


def _rooted(spark: SparkSession, docs: DataFrame, key: str, text: str, k: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """key, n_shingles, class, root (a name of the class's component), component_id of each document."""
    folder = shared_dir(spark, "ngrams")
    sets = Sets(spark, docs, folder, key, text, k, percent)
    of = sets.members
    roots = components(spark, links(spark, sets, percent, frequent), f"{folder}/components")
    least = of.where("class is not null").groupBy("class").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    rooted = least.join(roots, F.col("class") == F.col("node"), "left").select("class", "first", "copies", F.coalesce("root", "class").alias("root"), F.col("root").isNotNull().alias("linked"))
    # only classes with copies or links need a look-up
    several = rooted.where("copies > 1 or linked").unionAll(rooted.join(roots.select(F.col("root").alias("class")).distinct(), "class", "left_semi")).distinct()
    by_root = several.groupBy("root").agg(F.min("first").alias("component"))
    look = several.select("class", "root").distinct().join(by_root, "root").select(F.col("class").alias("_class"), "root", "component")
    return of.join(look, F.col("class") == F.col("_class"), "left").select(F.col("key").alias(key), "n_shingles", "class", "check", F.coalesce("root", "class").alias("root"), F.coalesce("component", "key").alias("component_id"))


def join(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """One row for each document: key, n_shingles, class, component_id (the least key reachable by links)."""
    return _rooted(spark, docs, key, text, k, percent, frequent).drop("root", "check")


def _with_check(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the second half of the name of each row's set; null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            classes = pa.array([check_of(s) if len(s) else None for s in _sets(texts, SHINGLE)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, classes], names=[*batch.schema.names, name])

    return docs.mapInArrow(releasing(run), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def component_filter(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that are linked to one with a smaller key; of linked rows of one key the one with the least name stays, unlinked ones all stay, and so do rows with a null key.

    Rows of a repeated key are told apart by the second half of their set's name, those with the empty set by their text.
    """
    name, mark, empty, own = free(docs.columns, "_gone", "_mark", "_empty", "_check")
    of = stored(spark, _rooted(spark, docs, key, text).where(F.col(key).isNotNull()), f"{shared_dir(spark, 'ngrams')}/rooted")
    several = of.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias(name))
    gone = of.where(F.col("component_id") < F.col(key)).select(F.col(key).alias(name)).distinct()
    kept = docs.join(gone.unionAll(several).distinct(), F.col(key) == F.col(name), "left_anti")  # rows with a null key too
    stay = of.where(F.col("component_id") == F.col(key)).groupBy(key, "root").agg(F.min("check").alias(mark)).select(F.col(key).alias(name), mark)
    rows = _with_check(docs.join(several, F.col(key) == F.col(name), "left_semi"), text, own)
    rows = rows.join(stay, (F.col(key) == F.col(name)) & F.col(own).eqNullSafe(F.col(mark)), "left_semi")
    rows = rows.withColumn(empty, F.when(F.col(own).isNull(), F.col(text))).dropDuplicates([key, own, empty])
    return kept.unionAll(rows.select(docs.columns))
