"""Byte-pair encoding and decoding of whole texts (operator 1).

Encoding.  An Aho-Corasick automaton over the vocabulary finds the longest
token that starts at each place of a word.  The encoder takes longest tokens,
steps down to the next shorter prefix or back by one token where two
neighbours are not compatible, and never visits a place twice.  Two tokens are
compatible if merging their joint text by rank leaves exactly these two; a
sequence whose neighbours are all compatible is the one that the merges give,
so results are exact and the time is linear in the length of a word.

Decoding.  All token texts lie in one byte buffer with a table of offsets; the
bytes of a batch of id lists are gathered at once.

Defined cases: null text is encoded as the empty text; empty text has no ids
and decodes to the empty text; rows are independent, so ties and repeated rows
do not matter; extra columns are kept, but columns named like an output column
(in any case of letters) are replaced; ids out of the vocabulary raise ``IndexError`` when decoded.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import ragged, slices, without

#: The white space of the vocabulary's patterns (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
SPACES = regex.compile(rf"[{SPACE}]+")
WORD_END = "</w>"
#: ASCII punctuation that starts no contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    other = {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chr(b) if b in plain else other[b] for b in range(256)]


class Vocabulary:
    """The merges of a tokenizer file: automaton, split table, prefix table, pair table and offset table.

    Within, a token is a string of symbols: code b for byte b, code 256 + b for
    byte b at the end of a word.  Tokens are numbered by rank: first the
    symbols, then the merges in their order.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        code = {c: chr(b) for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            ends = token.endswith(WORD_END)
            s = "".join(map(code.__getitem__, token[: -len(WORD_END)] if ends else token))
            return s[:-1] + chr(256 + ord(s[-1])) if ends else s

        merged = ["".join(m) for m in merges]
        made = set(merged)
        base = [t for t in vocab if t not in made]
        self.ids = [vocab[t] for t in base + merged]
        self.text = [symbols(t) for t in base + merged]
        self.lengths = [len(s) for s in self.text]
        rank = {s: i for i, s in enumerate(self.text)}
        n = len(base)
        self.split = [(i, i) for i in range(n)] + [(rank[symbols(a)], rank[symbols(b)]) for a, b in merges]
        self.merge = {s: n + i for i, s in enumerate(self.split[n:])}
        self.rank = rank
        self.automaton = ahocorasick.Automaton()
        for s, i in rank.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.prefix = [next((rank[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in rank), -1) for s in self.text]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        shown = [b""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            shown[i] = t.encode()
        self.offsets = np.zeros(self.size + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in shown], out=self.offsets[1:])
        self.bytes = np.frombuffer(b" ".join(shown) + b" ", dtype=np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two tokens leaves them as they are."""
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= 1 << 19:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Undoes the merges of both sides, latest first; a merge across the border that comes before the undone one would have won."""
        limit = len(self.text)
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def encode_symbols(self, s: str) -> list[int]:
        """Ranks of the tokens of one word."""
        if (whole := self.rank.get(s)) is not None:
            return [whole]
        n = len(s)
        longest = [-1] * n
        for end, (token, length) in self.automaton.iter(s):
            longest[end - length + 1] = token
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token, lengths, prefix, known, compatible = 0, longest[0], self.lengths, self.prefix, self.pairs.get, self.compatible
        while at < n:
            end = at + lengths[token]
            fits = open_[end]
            if fits and out and (fits := known((out[-1], token))) is None:
                fits = compatible(out[-1], token)
            if fits:
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif prefix[token] >= 0:
                token = prefix[token]
            else:  # no token can follow here: give up this place
                open_[at] = 0
                token = out.pop()
                at -= lengths[token]
        return out

    @lru_cache(maxsize=1 << 17)  # noqa: B019  one vocabulary lives as long as its worker
    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one normalised word without white space."""
        b = word.encode()
        return tuple(self.ids[i] for i in self.encode_symbols(b[:-1].decode("latin-1") + chr(256 + b[-1])))

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of a text in UTF-8: special tokens are cut out, the rest is normalised, split into words and encoded."""
        text = piece.decode("utf-8", "replace")
        out: list[int] = []
        at = 0
        for m in self.cut.finditer(text) if self.cut and "<" in text else ():
            out += self._plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        low = text.lower()
        core = low.rstrip(MARKS)
        if core.isalpha():  # one word, and perhaps marks behind it: the pattern's parts without the pattern
            return [*self.encode_word(core), *(self.encode_word(low[len(core) :]) if len(core) < len(low) else ())]
        return [i for w in WORDS.findall(SPACES.sub(" ", low)) for i in self.encode_word(w)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and byte ends of the texts of id lists that end at these places: token texts joined by one space."""
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise IndexError("id out of the vocabulary")
        lengths = self.offsets[ids + 1] - self.offsets[ids]
        starts = np.concatenate(([0], ends[:-1]))
        last = ends[ends > starts] - 1
        lengths[last] -= 1
        total = np.concatenate(([0], np.cumsum(lengths)))
        return self.bytes[ragged(self.offsets[ids], lengths)], total[ends]


class Memo:
    """Id lists of pieces between ASCII white space, which no token crosses; they are encoded once while they are kept.

    ``encode`` gives the ids of many pieces, one after another, and how many
    each has.  At most ``most`` pieces are held, beyond that it starts afresh.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 500_000) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def lookup(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text ends."""
        split = [t.split() if t else [] for t in texts]
        words = [w for s in split for w in s]
        if new := list(set(words).difference(self.at)):
            if len(self.at) + len(new) > self.most:
                self.clear()
                new = list(set(words))
            got, counts = self.encode(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.ends.frombytes((np.cumsum(counts, dtype=np.int64) + len(self.ids)).tobytes())
            self.ids.frombytes(np.asarray(got, dtype=np.int32).tobytes())
        codes = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
        ends = np.frombuffer(self.ends, dtype=np.int64)
        starts, lengths = ends[codes], ends[codes + 1] - ends[codes]
        ids = np.frombuffer(self.ids, dtype=np.int32)[ragged(starts, lengths)] if len(words) else np.zeros(0, dtype=np.int32)
        done = np.concatenate(([0], np.cumsum(lengths)))
        return ids, done[np.cumsum([len(s) for s in split], dtype=np.int64)] if texts else np.zeros(0, dtype=np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def memo(path: str) -> Memo:
    v = vocabulary(path)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lists = [v.encode_piece(w) for w in words]
        return np.array([i for ids in lists for i in ids], dtype=np.int32), np.array([len(ids) for ids in lists], dtype=np.int64)

    return Memo(encode)


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    taken = {n.lower() for n in columns}
    kept = [n for n in batch.schema.names if n.lower() not in taken]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns.values()], names=[*kept, *columns])


def _extended(df: DataFrame, **types: T.DataType) -> T.StructType:
    return T.StructType([*without(df.schema.fields, types), *(T.StructField(n, t) for n, t in types.items())])


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the list of token ids of a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            values, ends = memo(tokenizer).lookup(texts)
            offsets = pa.array(np.concatenate(([0], ends)), type=pa.int32())
            yield _with(batch, **{ids: pa.ListArray.from_arrays(offsets, pa.array(values, type=pa.int32()))})

    return df.mapInArrow(run, _extended(df, **{ids: T.ArrayType(T.IntegerType())}))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of a column of id lists (null: no ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                lists = batch.column(batch.schema.get_field_index(ids))
                lengths = np.asarray(pa.compute.list_value_length(lists).fill_null(0), dtype=np.int64)
                data, ends = vocabulary(tokenizer).decode(np.asarray(lists.flatten()), np.cumsum(lengths))
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                yield _with(batch, **{text: pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))})

    return df.mapInArrow(run, _extended(df, **{text: T.StringType()}))
