"""Edit-aware token counts (operator 10).

A document's text is cut into leaves of some hundred bytes, at places where a
pre-token ends whatever stands on either side; token counts of leaves add up.
A balanced segment tree over the leaves holds the sums of bytes, code points
and tokens.  An edit descends to the leaves that it touches, takes neighbours
in where what is next to a border has become one pre-token, encodes only these
anew, cuts them into leaves again, and updates the sums on their paths: its
cost grows with the logarithm of the text's length and the size of the edit.

Trees are kept: ``trees`` gives a column with the leaves' bytes, code points and
tokens (12 bytes a leaf), and ``edited_counts`` starts from it without encoding
the text again, and gives the tree after the edits, from which later ones start.

A border is safe beside ASCII white space; between a letter, digit or mark of
ASCII and one of another kind (no letter after an apostrophe, as that may be a
contraction); and between some signs of Chinese punctuation and an ideograph.
Texts in which a special token may start are cut at white space only.  A word
without such a place is one leaf, however long.

Counts are those of the exact byte-pair encoder of operator 1.

Defined cases: null text is empty and has no tokens; edits apply one after
another, each to the text that the ones before left; starts and stops are code
points, cut to the text's length; a null insertion is empty and a null list of
edits is no edit; a null tree is made from the text; extra columns are kept
unless named like an output column, in any case of letters; rows are
independent, so ties and repeated rows do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.bpe import vocabulary
from quarry.llm.common import slices, without

#: Bytes of a leaf; it ends at the first safe border beyond.
LEAF = 256
SPACE = re.compile(rb"[ \t-\r]")
#: Borders inside words: letter, then sign or digit; digit, then any; sign, then digit; sign but apostrophe, then letter; ideographic sign, then ideograph.
BORDER = re.compile(
    rb"(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-~])|(?<=[!-/:-@\[-`{-~])(?=[0-9])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z])"
    rb"|(?<=\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x9f])(?=\xe4[\xb8-\xbf]|[\xe5-\xe8])"
)
#: Special tokens start with it.
OPENING = b"<"
#: Longest word whose count is kept.
KEPT_WORD = 64


def leaves_of(text: bytes) -> list[bytes]:
    """Leaves that end at safe borders; their concatenation is the text. Each byte is looked at a bounded number of times."""
    out, at, n = [], 0, len(text)
    space = -1  # the next white space, as far as known
    special = text.find(OPENING)
    while n - at > LEAF:
        low = at + LEAF
        if space < low:
            found = SPACE.search(text, low)
            space = found.start() if found else n
        stop = min(n, space + 1)
        if 0 <= special < at:
            special = text.find(OPENING, at)
        if space - low > LEAF and not at <= special < space and (found := BORDER.search(text, low, space)):
            stop = found.start()
        out.append(text[at:stop])
        at = stop
    if at < n:
        out.append(text[at:])
    return out


def safe(left: bytes, right: bytes) -> bool:
    """Whether counts of two neighbours add up."""
    if not left or not right or SPACE.match(left[-1:]) or SPACE.match(right[:1]):
        return True
    return OPENING not in left and OPENING not in right and BORDER.match(left[-3:] + right[:2], len(left[-3:])) is not None


class Node:
    """A leaf with its text, or an inner node with two sides; both hold sums."""

    __slots__ = ("left", "right", "data", "height", "bytes", "chars", "tokens", "leaves")

    def __init__(self, left: Node | None, right: Node | None, data: bytes = b"", tokens: int = 0, chars: int | None = None) -> None:
        self.left, self.right, self.data = left, right, data
        if left is None:
            self.height, self.leaves, self.bytes, self.tokens = 0, 1, len(data), tokens
            self.chars = chars if chars is not None else len(data) if data.isascii() else len(data.decode("utf-8", "replace"))
        else:
            self.height = 1 + max(left.height, right.height)
            self.bytes, self.chars, self.tokens, self.leaves = left.bytes + right.bytes, left.chars + right.chars, left.tokens + right.tokens, left.leaves + right.leaves


def _balanced(a: Node, b: Node) -> Node:
    """A node over two sides whose heights differ by two at most, with rotations where they do."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Node(a.left, Node(a.right, b))
        return Node(Node(a.left, a.right.left), Node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Node(Node(a, b.left), b.right)
        return Node(Node(a, b.left.left), Node(b.left.right, b.right))
    return Node(a, b)


def joined(a: Node | None, b: Node | None) -> Node | None:
    """Two trees one after another, in time of the difference of their heights."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return _balanced(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return _balanced(joined(a, b.left), b.right)
    return Node(a, b)


def built(nodes: list[Node]) -> Node | None:
    """A balanced tree over leaves."""
    if len(nodes) < 2:
        return nodes[0] if nodes else None
    half = len(nodes) // 2
    return Node(built(nodes[:half]), built(nodes[half:]))


def opened(t: Node, at: int) -> tuple[Node | None, Node, Node | None, int]:
    """The leaves before and after the one that holds a code point (past the end, the last), and the code point's place in it."""
    if t.left is None:
        return None, t, None, at
    if at < t.left.chars:
        before, leaf, after, place = opened(t.left, at)
        return before, leaf, joined(after, t.right), place
    before, leaf, after, place = opened(t.right, at - t.left.chars)
    return joined(t.left, before), leaf, after, place


def _bytes_before(data: bytes, chars: int) -> int:
    return min(chars, len(data)) if data.isascii() else len(data.decode("utf-8", "replace")[:chars].encode())


class TokenTree:
    """Sums of bytes, code points and tokens over the leaves of one text."""

    def __init__(self, leaves: list[Node], count: Callable[[list[bytes]], list[int]]) -> None:
        self.root, self.count = built(leaves), count
        self.encoded = 0  # leaves encoded again by edits

    @staticmethod
    def fresh(text: bytes, count: Callable[[list[bytes]], list[int]]) -> TokenTree:
        pieces = leaves_of(text)
        return TokenTree([Node(None, None, p, n) for p, n in zip(pieces, count(pieces), strict=True)], count)

    @staticmethod
    def kept(text: bytes, table: bytes, count: Callable[[list[bytes]], list[int]]) -> TokenTree:
        """From the text and the table that ``table`` gave; nothing is encoded."""
        at, leaves = 0, []
        for size, chars, tokens in np.frombuffer(table, dtype="<u4").reshape(-1, 3).tolist():
            leaves.append(Node(None, None, text[at : at + size], tokens, chars))
            at += size
        if at != len(text):
            raise ValueError("a kept tree is not one of its text")
        return TokenTree(leaves, count)

    def leaves(self) -> list[Node]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            t = todo.pop()
            if t.left is None:
                out.append(t)
            else:
                todo += [t.right, t.left]
        return out

    def table(self) -> bytes:
        return np.array([(t.bytes, t.chars, t.tokens) for t in self.leaves()], dtype="<u4").tobytes()

    @property
    def total(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def size(self) -> int:
        return self.root.leaves if self.root else 0

    def text(self) -> bytes:
        return b"".join(t.data for t in self.leaves())

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Puts new bytes in the place of the code points from start to stop (of the text as it is now)."""
        before = after = None
        data = new
        if self.root is not None:
            before, leaf, after, a = opened(self.root, start)
            b, last = a + stop - start, leaf
            if b > leaf.chars and after is not None:
                _, last, after, b = opened(after, b - leaf.chars)
            data = leaf.data[: _bytes_before(leaf.data, a)] + new + last.data[_bytes_before(last.data, b) :]
        small = len(data) < LEAF // 2
        while before is not None:
            rest, near, _, _ = opened(before, before.chars)
            if not small and safe(near.data, data):
                break
            before, data, small = rest, near.data + data, False
        small = len(data) < LEAF // 2
        while after is not None:
            _, near, rest, _ = opened(after, 0)
            if not small and safe(data, near.data):
                break
            after, data, small = rest, data + near.data, False
        pieces = leaves_of(data)
        self.encoded += len(pieces)
        self.root = joined(joined(before, built([Node(None, None, p, n) for p, n in zip(pieces, self.count(pieces), strict=True)])), after)


class Counts(dict):
    """Token counts of words between ASCII white space; a word of ``KEPT_WORD`` bytes or less is encoded once while it is kept, and beyond ``most`` words it starts afresh."""

    def __init__(self, encode: Callable[[bytes], list[int]], most: int = 1_000_000) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: bytes) -> int:
        n = len(self.encode(word))
        if len(word) <= KEPT_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counter(tokenizer: str) -> Callable[[list[bytes]], list[int]]:
    """Token counts of byte pieces, by the encoder of operator 1; no token crosses ASCII white space, so words add up."""
    known = Counts(vocabulary(tokenizer).encode_piece)
    return lambda pieces: [sum(map(known.__getitem__, p.split())) for p in pieces]


def _mapped(df: DataFrame, text: str, added: dict[str, T.DataType], of: Callable[[pa.RecordBatch, list[bytes | None]], dict[str, list]], used: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns; those that are ``used`` up do not come back."""
    fields = without(df.schema.fields, [*added, *used])
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            rows = of(batch, texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *(pa.array(rows[n], type=kinds[t]) for n, t in added.items())], names=[*(f.name for f in fields), *added])

    return df.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, t) for n, t in added.items())]))


def trees(df: DataFrame, tokenizer: str, text: str = "text", tree: str = "tree") -> DataFrame:
    """Adds n_tokens and each text's tree, to be kept with the text."""

    def of(batch: pa.RecordBatch, texts: list[bytes | None]) -> dict[str, list]:
        count = counter(tokenizer)
        cut = [leaves_of(t or b"") for t in texts]
        counts = iter(count([p for own in cut for p in own]))
        rows: dict[str, list] = {"n_tokens": [], tree: []}
        for own in cut:
            tokens = [next(counts) for _ in own]
            rows["n_tokens"].append(sum(tokens))
            rows[tree].append(np.array([(len(p), len(p) if p.isascii() else len(p.decode("utf-8", "replace")), n) for p, n in zip(own, tokens, strict=True)], dtype="<u4").tobytes())
        return rows

    return _mapped(df, text, {"n_tokens": T.LongType(), tree: T.BinaryType()}, of)


def edited_counts(df: DataFrame, tokenizer: str, edits: str = "edits", text: str = "text", tree: str | None = None, last: bool = False) -> DataFrame:
    """Adds n_tokens, n_tokens_edited, n_pieces (leaves), n_encoded (leaves encoded by edits), edited and edited_tree, given a column of edits: array<struct<start, stop, insert>>, and perhaps one of kept trees. If these are the ``last`` edits, the text, the edits and the trees do not come back."""
    added = {"n_tokens": T.LongType(), "n_tokens_edited": T.LongType(), "n_pieces": T.LongType(), "n_encoded": T.LongType(), "edited": T.StringType()} | ({} if last else {"edited_tree": T.BinaryType()})

    def of(batch: pa.RecordBatch, texts: list[bytes | None]) -> dict[str, list]:
        count = counter(tokenizer)
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
        rows: dict[str, list] = {n: [] for n in added}
        for t, kept, asked in zip(texts, column(tree) if tree else [None] * len(texts), column(edits), strict=True):
            own = TokenTree.fresh(t or b"", count) if kept is None else TokenTree.kept(t or b"", kept, count)
            rows["n_tokens"].append(own.total)
            rows["n_pieces"].append(own.size)
            for e in asked or ():
                chars = own.root.chars if own.root else 0
                a = min(max(0, e["start"] or 0), chars)
                own.replace(a, min(max(a, e["stop"] or 0), chars), (e["insert"] or "").encode())
            rows["n_tokens_edited"].append(own.total)
            rows["n_encoded"].append(own.encoded)
            rows["edited"].append(own.text().decode("utf-8", "replace"))
            if not last:
                rows["edited_tree"].append(own.table())
        return rows

    return _mapped(df, text, added, of, (text, edits, *([tree] if tree else [])) if last else ())


def trial_edits(text: str) -> Column:
    """Three edits that any text has: the first code points, a stretch in the middle, and the end."""
    n = F.coalesce(F.length(text), F.lit(0))
    edit = lambda a, b, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(new).alias("insert"))
    return F.array(edit(F.lit(0), F.lit(3), "Edited "), edit(F.floor(n / 2), F.floor(n / 2) + 12, "in the middle"), edit(n + 1000, n + 1000, "'s end"))
