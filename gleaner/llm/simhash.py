"""SimHash near-duplicates with pigeonring filtering.

Two 64-bit fingerprints that differ in at most 3 bits, cut into a ring of 4 segments of 16 bits, have a start from which
every chain of consecutive segments stays within its share of the budget: 1 segment differs in 0 bits (3/4), 2 segments
in at most 1 (6/4), 3 in at most 2 (9/4), all 4 in at most 3. The first two links are the join key: a fingerprint is
filed under its exact segment pair and asks for the 17 pairs within the budget of the second. The longer chains are
checked before the full distance. Keys that hold very many fingerprints take in the third segment, which leaves 65,536
fingerprints a key at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import give_back, table, texts
from gleaner.llm.components import connected
from gleaner.llm.registry import query
from gleaner.llm.words import byte_words
from gleaner.session import cut_lineage

DISTANCE, SEGMENTS, BITS = 3, 4, 16
#: A key with more filed fingerprints takes in the third segment.
HOT_KEY = 50_000
ONE_FLIP = [0, *(1 << b for b in range(BITS))]
TWO_FLIPS = [*ONE_FLIP, *((1 << a) | (1 << b) for a, b in combinations(range(BITS), 2))]


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of the word shingles, repeats included; 0 without words. Holds one stretch of text at a time."""
    ones, n = np.zeros(64, np.int64), 0
    carried: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for words in byte_words(text, lower=True):
        words = carried + words
        if len(words) >= width:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(lengths)
            stops = ends[width - 1 :] - 1
            starts = ends[: len(stops)] - lengths[: len(stops)]
            hashes = np.fromiter(
                (digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(stops),
            )
            n += len(hashes)
            for at in range(0, len(hashes), 1 << 15):
                part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            carried = words[-(width - 1) :]
        else:
            carried = words
    if not n:
        return digest(b" ".join(carried), seed) if carried else 0
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, width: int = 3) -> Column:
    """The fingerprint as a signed long; null and blank texts have fingerprint 0."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in texts(batch)], np.uint64)
            yield pa.array(found.view(np.int64))

    return run(text)


def segment(i: int) -> Column:
    return F.shiftrightunsigned("fp", BITS * (i % SEGMENTS)).bitwiseAND((1 << BITS) - 1)


def key_of(start: int, second: Column) -> Column:
    return F.lit(start << 32).bitwiseOR(F.shiftleft(segment(start), BITS)).bitwiseOR(second)


def filed(fps: DataFrame) -> DataFrame:
    """(key, fp, filed=true) once per start of the ring, (key, fp, filed=false) for the pairs within the second's budget."""
    starts = range(SEGMENTS)
    own = F.explode(F.array(*[key_of(i, segment(i + 1)) for i in starts]))
    asked = F.explode(F.array(*[key_of(i, segment(i + 1).bitwiseXOR(flip)) for i in starts for flip in ONE_FLIP[1:]]))
    return fps.select(own.alias("key"), "fp", F.lit(True).alias("filed")).union(
        fps.select(asked.alias("key"), "fp", F.lit(False).alias("filed"))
    )


def deeper(rows: DataFrame) -> DataFrame:
    """The same rows under keys of three segments: at most two differing bits in the second and third together."""
    start = F.shiftrightunsigned("key", 32).cast("int")
    third = F.element_at(F.array(*[segment(i + 2) for i in range(SEGMENTS)]), start + 1)
    second = F.element_at(F.array(*[segment(i + 1) for i in range(SEGMENTS)]), start + 1)
    used = F.bit_count(second.bitwiseXOR(F.col("key").bitwiseAND((1 << BITS) - 1)))
    long = lambda flip: F.shiftleft("key", BITS).bitwiseOR(third.bitwiseXOR(flip)).bitwiseOR(F.lit(1 << 62))
    flips = F.when(used == 0, F.lit(np.array(TWO_FLIPS, np.int64).tolist())).otherwise(F.lit(ONE_FLIP).cast("array<bigint>"))
    asked = rows.select(F.explode(F.transform(flips, long)).alias("key"), "fp", F.lit(False).alias("filed"))
    own = rows.filter("filed").select(long(F.lit(0)).alias("key"), "fp", "filed")
    return own.union(asked)


def group_links(key_filed: np.ndarray, asked: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A forest of links within one key: as many as join what is linked, never all pairs.

    Each asking fingerprint meets the filed ones in blocks, so memory is bounded by the filed ones of one key.
    """
    nodes = np.unique(np.concatenate([key_filed, asked]))
    parent = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    base = np.unique(key_filed)
    place = np.searchsorted(nodes, base)
    step = max(1, (1 << 20) // max(1, len(base)))
    out = []
    for at in range(0, len(nodes), step):
        near = np.bitwise_count(nodes[at : at + step, None] ^ base[None, :]) <= distance
        for i, j in zip(*np.nonzero(near)):
            a, b = root(at + int(i)), root(int(place[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[at + int(i)]), int(base[j])))
    return out


def key_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every key of a partition that is sorted by key; what is alone under its key is passed over in bulk."""
    held: list[tuple[np.ndarray, ...]] = []

    def solve(keys: np.ndarray, fps: np.ndarray, filed_: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.flatnonzero(np.diff(keys)) + 1
        first, end = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(keys)]])
        links: list[tuple[int, int]] = []
        for a, b in zip(first, end):
            if b - a > 1 and filed_[a:b].any():
                links += group_links(fps[a:b][filed_[a:b]], fps[a:b])
        if links:
            pairs = np.array(links, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        columns = (
            batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False),
        )
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last or (held and held[0][0][0] != columns[0][0]):
            whole = [np.concatenate(c) for c in zip(*held, tuple(c[:last] for c in columns))]
            if len(whole[0]):
                yield from solve(*whole)
            held = []
        held.append(tuple(c[last:] for c in columns))
    if held:
        yield from solve(*[np.concatenate(c) for c in zip(*held)])


def near_links(fps: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b): links between distinct fingerprints at distance 1 to 3 that join all that are linked."""
    rows = filed(fps)
    hot = rows.filter("filed").groupBy("key").count().filter(F.col("count") > hot_key).select("key")
    hot = cut_lineage(hot)
    if hot.isEmpty():
        parts = rows
    else:
        parts = rows.join(hot, "key", "left_anti").union(deeper(rows.join(hot, "key", "left_semi")))
    sorted_ = parts.repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(key_links, "a bigint, b bigint").distinct()


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, hot_key: int = HOT_KEY,
) -> DataFrame:
    """(doc_id, fp, component_id) per row: the smallest id reachable over fingerprints at distance 3 or less.

    Equal fingerprints are one node, so copies never meet each other. Null and blank texts share fingerprint 0 and are
    linked like any other; fewer words than ``width`` are one shingle. Repeated rows come back as often as they came. A
    null id keeps its row, and is never the smallest unless its component has no other. Other columns are not read.
    """
    marked = cut_lineage(df.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), width).alias("fp")))
    heads = marked.groupBy("fp").agg(F.min("doc_id").alias("head"))
    heads = cut_lineage(heads)
    found = cut_lineage(near_links(heads.select("fp"), hot_key))
    joined = connected(found)  # over fingerprints
    groups = heads.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "head", F.coalesce("root", "fp").alias("root"),
    )
    least = groups.groupBy("root").agg(F.min("head").alias("component_id"))
    named = groups.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
