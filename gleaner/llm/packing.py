"""Order-preserving packing by dynamic programming.

Documents stand one behind another in a stream of tokens. A sequence is a window of the stream, so order is kept and
nothing is dropped. Windows may end at a document's end (free), at a sentence's end (``sentence_cost`` tokens) or,
inside stretches without a sentence end, at a grid of tokens (``break_cost``). The cuts minimise the sum of padding and
of these penalties; the best earlier cut within reach is the front of a monotone queue, so a stream of n possible cuts
takes O(n) steps.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tiktoken import Encoding

from gleaner.llm.common import Memo, give_back, table, texts
from gleaner.llm.registry import query
from gleaner.llm.words import spaced_words

VOCABULARY = "byte_bpe_50k.json"
END_ID = 1
#: Most remembered words of a worker; longer words than LONG are never remembered.
WORDS, LONG = 300_000, 128
#: Tokens between the possible cuts of a stretch without a sentence end, and tokens solved at a time.
GRID, BLOCK = 16, 1 << 20
#: Sequences at the end of a block that are solved again with what follows.
TAIL = 8

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
DDL = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class Words:
    """Ids of texts, a word at a time: the pattern of the tokenizer starts anew at every safe single space.

    The vocabulary and pattern are those of the tokenizer file; ``tiktoken`` does the merges, since it gives the same ids
    (tests compare them with the tokenizer's own) at a fifth of the time. A text is split at the tokenizer's added tokens
    first: they get their own ids, and what lies between is encoded as a text of its own.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        vocabulary, added = stored["model"]["vocab"], stored.get("added_tokens") or []
        if unlike := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
            raise ValueError(f"added tokens with rules of their own are not supported: {unlike}")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest))) if longest else None
        bytes_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(bytes_of[c] for c in token): i for token, i in vocabulary.items()}
        own = Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = own.encode_ordinary
        self.after_space = Memo(lambda word: array("I", self.encode(" " + word)).tobytes(), WORDS)
        tokens = {i: token for token, i in ranks.items()} | {t["id"]: t["content"].encode() for t in added}
        order = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.ends = np.array([t[-1:] in (b".", b"!", b"?", b"\n") for t in order])
        self.starts = np.array([t[:1] in (b" ", b"\n", b"\t") for t in order])
        self.lines = np.array([t[-1:] == b"\n" for t in order])

    def ids(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            parts += [self.plain(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        parts.append(self.plain(text[at:] if at else text))
        return np.frombuffer(b"".join(parts), np.uint32)

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        known, parts = self.after_space, []
        for words in spaced_words(text):
            if not parts:
                parts.append(array("I", self.encode(words.pop(0))).tobytes())
            if words and max(map(len, words)) > LONG:
                parts += [known[w] if len(w) <= LONG else array("I", self.encode(" " + w)).tobytes() for w in words]
            else:
                parts.append(b"".join(map(known.__getitem__, words)))
        return b"".join(parts)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Offsets just behind a sentence: an end mark before white space, or a line feed."""
        if len(ids) < 2:
            return np.empty(0, np.int64)
        at = self.ends[ids[:-1]] & (self.starts[ids[1:]] | self.lines[ids[:-1]])
        return np.flatnonzero(at) + 1


def byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def best_cuts(places: list[int], costs: list[int], capacity: int) -> list[int]:
    """Indexes of the chosen places, first and last included; windows hold ``capacity`` tokens at most.

    total(j) = min over i within reach of total(i) + padding of the window (i, j) + cost(j). With key(i) = total(i) +
    place(i), the padding falls out and the minimum over a sliding window of keys is the front of a monotone queue.
    Of equal keys the earliest wins, which gives the fullest window.
    """
    keys, back = [0] * len(places), [0] * len(places)
    queue = deque([0])
    for j in range(1, len(places)):
        reach = places[j] - capacity
        while places[queue[0]] < reach:
            queue.popleft()
        i = queue[0]
        back[j] = i
        key = keys[j] = keys[i] + capacity + costs[j]
        while queue and keys[queue[-1]] > key:
            queue.pop()
        queue.append(j)
    chosen = [len(places) - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


class Packer:
    """Documents in, pieces out; holds about one block of tokens."""

    def __init__(self, capacity: int, sentence_cost: int, break_cost: int, first_sequence: int):
        self.capacity, self.sentence_cost, self.break_cost = capacity, sentence_cost, break_cost
        self.sequence = first_sequence
        self.grid = max(1, min(GRID, capacity))
        self.held: list[tuple] = []  # (doc_id, ids, offset of the first token still held, sentence ends)
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray, ends: np.ndarray) -> list[tuple]:
        self.held.append((doc_id, ids, 0, ends))
        self.tokens += len(ids)
        return self.solve(False) if self.tokens >= max(BLOCK, 4 * TAIL * self.capacity) else []

    def possible_cuts(self) -> tuple[list[int], list[int]]:
        places, costs, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, ids, start, ends in self.held:
            n = len(ids) - start
            own = ends[np.searchsorted(ends, start, "right") :] - start
            cost = np.full(len(own), self.sentence_cost)
            gaps = np.diff(np.concatenate([[0], own, [n]]))
            if gaps.max() > min(2 * self.grid, self.capacity):
                edges = np.concatenate([[0], own])
                more = np.concatenate([np.arange(e + self.grid, e + g, self.grid) for e, g in zip(edges, gaps) if g > min(2 * self.grid, self.capacity)])
                own, cost = np.concatenate([own, more]), np.concatenate([cost, np.full(len(more), self.break_cost)])
                order = np.argsort(own, kind="stable")
                own, cost = own[order], cost[order]
            places += [own + base, [base + n]]
            costs += [cost, [0]]
            base += n
        return np.concatenate(places).tolist(), np.concatenate(costs).tolist()

    def solve(self, last: bool) -> list[tuple]:
        """Pieces of all windows, or of all but the last few while more documents may come."""
        if not self.held:
            return []
        places, costs = self.possible_cuts()
        cuts = [places[k] for k in best_cuts(places, costs, self.capacity)]
        if not last:
            cuts = cuts[: max(1, len(cuts) - TAIL)]
        out, k = [], 0
        for begin, end in zip(cuts, cuts[1:]):
            offset = 0
            while begin + offset < end:
                doc_id, ids, start, _ = self.held[k]
                n = min(len(ids) - start, end - begin - offset)
                out.append((doc_id, start, n, ids[start : start + n].tobytes(), len(ids), self.sequence, offset))
                offset += n
                if start + n == len(ids):
                    k += 1
                else:
                    self.held[k] = (doc_id, ids, start + n, self.held[k][3])
            self.sequence += 1
        self.tokens -= cuts[-1]
        del self.held[:k]
        return out


def pack(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, sentence_cost: int = 8,
    break_cost: int = 32, path: str | None = None,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of sequences of ``capacity`` tokens at most.

    Each input partition is a stream of its own, in the order of ids (null first), equal ids by text: nothing is
    shuffled, and at most one sequence of a partition is left part-filled. Sequence ids start at partition number * 2^33.
    ``ids`` are little-endian unsigned 32-bit. A null or empty text is a document of the end id alone; repeated rows are
    packed as often as they come; an empty table gives no pieces. Other columns are not read.
    """
    place = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        words = words_of(place)
        packer = Packer(capacity, sentence_cost, break_cost, TaskContext.get().partitionId() << 33)
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids = words.ids(value) if value else end[:0]
                if made := packer.add(key, np.concatenate([ids, end]), words.sentence_ends(ids)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), SCHEMA.types)], schema=SCHEMA)
        if made := packer.solve(True):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), SCHEMA.types)], schema=SCHEMA)

    narrow = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return narrow.sortWithinPartitions("doc_id", "text").mapInArrow(run, DDL)


def pieces(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(pack(table(spark, sf_dir, "documents")))
