"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding: the token t such that the encoding
of the prefix without t ends in a token that BPE would leave standing beside t. ``Prefixes`` stores that last token per
byte prefix, so an append continues from the stored prefixes and an edit recomputes from the edited byte on.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Memo, table, texts
from gleaner.llm.registry import query
from gleaner.llm.words import spaced_words

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Most entries of what a worker remembers; words longer than LONG are never remembered.
PAIRS, PIECES, WORDS, LONG = 300_000, 300_000, 600_000, 128


class Codec:
    """A rank file with its pattern; encodes and decodes without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.beside = Memo(self._beside, PAIRS)  # by left token * 2^32 + right token
        # by token, so these hold one entry a token at most
        self.last_merge = Memo(self._last_merge, PAIRS)
        self.ends = Memo(lambda token: self._edge(token, True), PAIRS)
        self.starts = Memo(lambda token: self._edge(token, False), PAIRS)
        self.alone = Memo(lambda token: self.merge(self.bytes_of[token]) == [token], PAIRS)
        # finds all tokens that end at each byte, longest first; bytes stand as Latin-1 letters
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.matcher.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matcher.make_automaton()
        self.longest = max(map(len, self.ranks))
        self.pieces = Memo(self._piece, PIECES)
        self.after_space = Memo(lambda word: self._word(" " + word), WORDS)

    def merge(self, data: bytes) -> list[int]:
        """BPE by its definition: join the neighbours of the lowest rank, leftmost first. For short data only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        self.join(parts, 1)
        return [self.ranks[p] for p in parts]

    def join(self, parts: list[bytes], least: int) -> None:
        """Carry out merges in place, down to ``least`` parts."""
        rank, none = self.ranks.get, 1 << 60
        joins = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while len(parts) > least and (low := min(joins)) != none:
            i = joins.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i:
                joins[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(joins):
                joins[i] = rank(parts[i] + parts[i + 1], none)

    def _edge(self, token: int, right: bool) -> tuple[tuple[bytes, int, float], ...] | None:
        """(bytes, rank, rank at which it is merged further) of what stands at one edge of a token while BPE makes it.

        From the whole token down to a byte; None if the merges that make it do not rise in rank.
        """
        data, steps = self.bytes_of[token], []
        until = math.inf
        while True:
            rank = self.ranks[data]
            steps.append((data, rank if len(data) > 1 else -1, until))
            if len(data) == 1:
                return tuple(steps)
            parts = self.last_merge[rank]
            if parts is None or max(self.ranks[p] if len(p) > 1 else -1 for p in parts) >= rank:
                return None
            until, data = rank, parts[right]

    def _last_merge(self, token: int) -> tuple[bytes, bytes] | None:
        """The two parts that BPE joins last to make a token; None if it does not make it."""
        parts = self.bytes_of[token]
        parts = [parts[i : i + 1] for i in range(len(parts))]
        self.join(parts, 2)
        return (parts[0], parts[1]) if len(parts) == 2 and parts[0] + parts[1] in self.ranks else None

    def _beside(self, pair: int) -> bool:
        """Whether BPE leaves two tokens standing side by side.

        Merges run in rising rank. Between what stands at the inner edges of the two at the same time, a merge of lower
        rank than the next own merges of either (of equal rank the left one is first) would have joined them. Where ranks
        do not rise, the merges are carried out.
        """
        left, right = pair >> 32, pair & 0xFFFFFFFF
        ends, starts = self.ends[left], self.starts[right]
        if ends is None or starts is None:
            return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        rank = self.ranks.get
        for a, made_a, until_a in ends:
            for b, made_b, until_b in starts:
                joined = rank(a + b)
                if joined is None:
                    continue
                if joined <= made_a or joined <= made_b:
                    return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
                if joined < until_a and joined <= until_b:
                    return False
        return True

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern: its own rank if it has one, else the last tokens read backwards."""
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        return Prefixes(self, data).ids()

    def _piece(self, piece: str) -> bytes:
        return array("i", self.piece(piece.encode())).tobytes()

    def _word(self, word: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] if len(p) <= LONG else self._piece(p) for p in self.pattern.findall(word)])

    def encode(self, text: str) -> bytes:
        """Little-endian int32 ids of a whole text: a series of words whose ids are remembered."""
        parts: list[bytes] = []
        for words in spaced_words(text):
            if not parts:
                parts.append(self._word(words.pop(0)))
            if words and max(map(len, words)) > LONG:
                parts.append(b"".join([self.after_space[w] if len(w) <= LONG else self._word(" " + w) for w in words]))
            else:
                parts.append(b"".join(map(self.after_space.__getitem__, words)))
        return b"".join(parts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """The encoding of a byte string that can be appended to and edited."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, bytearray(), []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the string; stored prefixes stay as they are, since a prefix does not depend on what follows."""
        self.data += more
        self._fill(len(self.last))

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace data[start:end]: prefixes up to ``start`` are kept, the rest is computed again."""
        self.data[start:end] = new
        del self.last[start:]
        self._fill(start)

    def _fill(self, at: int) -> None:
        own, last, beside = self.codec, self.last, self.codec.beside
        base = max(0, at + 1 - own.longest)  # a token that ends behind ``at`` starts behind this
        for end, (token, n) in own.matcher.iter(self.data[base:].decode("latin-1")):
            end += base + 1
            if len(last) >= end:
                continue
            if end > n:
                if beside[(last[end - n - 1] << 32) + token]:
                    last.append(token)
            elif own.alone[token]:
                last.append(token)

    def ids(self) -> list[int]:
        out, at = [], len(self.last)
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.codec.bytes_of[token])
        return out[::-1]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process, with what it remembers."""
    return Codec(path, pattern)


def encode_texts(
    text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
) -> Column:
    """array<int> of ids of the whole text; null and empty texts give an empty array. Nothing is shuffled."""
    place = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(place, pattern)
        for batch in batches:
            yield id_lists([own.encode(t) if t else b"" for t in texts(batch)])

    return encode(text)


def decode_ids(ids: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes that the ids stand for; null gives null, ids without a token end the job."""
    place = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(place, pattern)
        for batch in batches:
            rows = (batch[k].values for k in range(len(batch)))
            yield pa.array([None if r is None else own.decode(r.to_numpy(zero_copy_only=False).tolist()) for r in rows], pa.binary())

    return decode(ids)


def round_trip(text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """struct (ids, decoded): the ids of the text and the bytes they decode to, by one worker; null counts as empty."""
    place = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(place, pattern)
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                blobs = [own.encode(t) if t else b"" for t in texts(batch[at : at + 1_000])]
                decoded = [own.decode(array("i", b).tolist()) for b in blobs]
                yield pa.StructArray.from_arrays([id_lists(blobs), pa.array(decoded, pa.binary())], names=["ids", "decoded"])

    return both(text)


def id_lists(blobs: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(blobs) + 1, np.int32)
    np.cumsum([len(b) // 4 for b in blobs], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text: empty, so no ids and no bytes."""
    coded = table(spark, sf_dir, "documents").select("doc_id", round_trip(F.col("text")).alias("coded"))
    return coded.select(
        "doc_id", F.size("coded.ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("coded.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )
