"""Substring dedup over prefix-partitioned suffix trees.

Every word position with ``window`` words behind it is a suffix. Suffixes are split by a variable-length word prefix so
that each group fits into memory: a prefix of one word where few suffixes start with it, else of 2, 4, 8 words, and for
prefixes that stay too frequent the whole window, whose groups split further by hash. A group is one subtree: its leaves,
sorted by path, meet in the internal nodes of depth ``window``; a node with leaves of two documents is a repeat, and
consecutive ones in a document make up its maximal repeats. A path is held as a 64-bit hash of its words inside its
prefix group, so about one in 2^64 / group size unequal pairs could be taken as equal.

Only the first leaf of a node in a batch of documents leaves its task (later documents of the batch are settled there),
so a passage that a third of all documents share sends one leaf a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Memo, give_back, table, texts
from gleaner.llm.registry import query
from gleaner.llm.words import byte_words

WINDOW = 13
CELL_BITS = 12
#: Suffixes of a group, suffixes a task holds before it sends them on, words a worker remembers.
GROUP, BATCH, REMEMBERED = 1_000_000, 500_000, 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def levels(window: int) -> list[int]:
    return sorted({1, 2, 4, 8, window} & {*range(1, window + 1)})


def multipliers(window: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(j), 13) | 1 for j in range(window)], np.uint64)


class Suffixes:
    """Word hashes of texts and the paths of their suffixes."""

    def __init__(self, window: int):
        self.window, self.levels, self.factors = window, levels(window), multipliers(window)
        self.memo = Memo(xxhash.xxh64_intdigest, REMEMBERED)

    def words(self, text: str | None) -> np.ndarray:
        parts = [np.fromiter(map(self.memo.__getitem__, w), np.uint64, len(w)) for w in byte_words(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def paths(self, words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hash of the window that starts at each word, and the cell of its prefix at each level."""
        n = len(words) - self.window + 1
        if n <= 0:
            return np.empty(0, np.uint64), [np.empty(0, np.int64) for _ in self.levels]
        path, cells = np.zeros(n, np.uint64), []
        for j in range(self.window):
            path += words[j : j + n] * self.factors[j]
            if j + 1 in self.levels:
                mixed = (path ^ (path >> np.uint64(29))) * MIX
                cells.append((mixed >> np.uint64(64 - CELL_BITS)).astype(np.int64))
        return path, cells


def count_cells(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        suffixes = Suffixes(window)
        counts = np.zeros((len(suffixes.levels), 1 << CELL_BITS), np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                for row, cells in zip(counts, suffixes.paths(suffixes.words(text))[1]):
                    row += np.bincount(cells, minlength=1 << CELL_BITS)
        level, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(cell), pa.array(counts[level, cell])], names=["level", "cell", "n"])

    return run


class Groups:
    """Which group a suffix belongs to; a table of one entry a level and cell, whatever the size of the input."""

    def __init__(self, counts: np.ndarray, group: int):
        self.first = np.full(counts.shape, -1, np.int64)
        self.parts = np.ones(counts.shape, np.int64)
        self.number, room = 0, 0
        last = len(counts) - 1
        for level in range(len(counts)):
            for cell in np.flatnonzero(counts[level]):
                n = int(counts[level, cell])
                if n > group and level < last:
                    continue
                if n > group:
                    self.parts[level, cell] = math.ceil(n / group)
                    self.first[level, cell] = self.number
                    self.number += int(self.parts[level, cell])
                    room = 0
                    continue
                if n > room:
                    self.number, room = self.number + 1, group
                room -= n
                self.first[level, cell] = self.number - 1

    def of(self, path: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(path), -1, np.int64)
        for level, cell in enumerate(cells):
            rest = np.flatnonzero(out < 0)
            if not len(rest):
                break
            found = self.first[level, cell[rest]]
            spread = (path[rest] >> np.uint64(7)) % self.parts[level, cell[rest]].astype(np.uint64)
            out[rest] = np.where(found >= 0, found + spread.astype(np.int64), -1)
        return out


def planes(values: np.ndarray, width: int) -> bytes:
    """Byte planes of unsigned values: high planes of small values are zeros, which the shuffle's codec takes out."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unplanes(data: memoryview, n: int, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(f"<u{width}").ravel()


def pack_leaves(docs: np.ndarray, checks: np.ndarray, owner: np.ndarray, at: np.ndarray, path: np.ndarray | None) -> bytes:
    """Leaves sorted by owner and place: the owners once each, gaps between places, and the paths if wanted."""
    used, first, each = np.unique(owner, return_index=True, return_counts=True)
    gaps = np.diff(at, prepend=0)
    gaps[first] = at[first]
    ids = np.diff(docs[used], prepend=0).view(np.uint64)
    return b"".join([
        np.array([len(used), len(at)], "<i8").tobytes(), planes(ids, 8), planes(checks[used], 2), planes(each, 4), planes(gaps, 4),
        b"" if path is None else path.astype("<u8").tobytes(),
    ])


def unpack_leaves(data: bytes, with_path: bool) -> tuple[np.ndarray, ...]:
    """(doc_id, check, place[, path]) per leaf."""
    view = memoryview(data)
    used, n = np.frombuffer(view, "<i8", 2).tolist()
    o = 16
    ids = np.cumsum(unplanes(view[o:], used, 8).view(np.int64))
    o += 8 * used
    checks = unplanes(view[o:], used, 2)
    o += 2 * used
    each = unplanes(view[o:], used, 4).astype(np.int64)
    o += 4 * used
    gaps = unplanes(view[o:], n, 4).astype(np.int64)
    o += 4 * n
    total = np.cumsum(gaps)
    first = np.cumsum(each) - each
    before = np.where(first > 0, total[first - 1], 0) if n else first
    place = total - np.repeat(before, each)
    leaves = np.repeat(ids, each), np.repeat(checks, each), place
    return (*leaves, np.frombuffer(view[o:], "<u8", n)) if with_path else leaves


def check_of(text: str) -> int:
    """Tells rows apart that share an id."""
    return xxhash.xxh32_intdigest(text) & 0xFFFF


def spread_repeats(docs: np.ndarray, checks: np.ndarray, owner: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Repeated windows as (bucket of the document, leaves)."""
    home = docs[owner] % buckets
    order = np.lexsort((at, owner, home))
    home, owner, at = home[order], owner[order], at[order]
    edges = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(home[a]), pack_leaves(docs, checks, owner[a:b], at[a:b], None)


def send_suffixes(window: int, groups: Groups, buckets: int):
    """(target, leaves): target >= 0 is a group, -1 - b are repeats of bucket b that are settled within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        suffixes = Suffixes(window)
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(held)), key=lambda i: held[i][0])
            rows = [held[i] for i in order]
            docs, checks = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint16)
            n = np.array([len(r[2]) for r in rows])
            path, group = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
            owner, at = np.repeat(np.arange(len(rows)), n), np.concatenate([np.arange(k) for k in n])
            by_path = np.argsort(path, kind="stable")
            sorted_path = path[by_path]
            new = np.concatenate([[True], sorted_path[1:] != sorted_path[:-1]])
            least = docs[owner[by_path]][np.flatnonzero(new)][np.cumsum(new) - 1]
            settled = np.zeros(len(path), bool)
            settled[by_path] = docs[owner[by_path]] > least
            del by_path, sorted_path, new, least  # as large as the batch, each
            made: list[tuple[int, bytes]] = [
                (-1 - b, data) for b, data in spread_repeats(docs, checks, owner[settled], at[settled], buckets)
            ]
            rest = np.flatnonzero(~settled)
            rest = rest[np.argsort(group[rest], kind="stable")]
            edges = [0, *(np.flatnonzero(np.diff(group[rest])) + 1).tolist(), len(rest)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    part = rest[a:b]
                    made.append((int(group[part[0]]), pack_leaves(docs, checks, owner[part], at[part], path[part])))
            for i in range(0, len(made), 64):
                part = made[i : i + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m[0] for m in part], pa.int64()), pa.array([m[1] for m in part], pa.binary())], names=["target", "data"],
                )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                path, cells = suffixes.paths(suffixes.words(text))
                if len(path) and doc_id is not None:
                    held.append((doc_id, check_of(text), path, groups.of(path, cells)))
                    size += len(path)
                if size >= BATCH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def subtree_repeats(parts: list[bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Repeats of one group: leaves below a node of full depth that has a leaf of a smaller document."""
    docs, checks, at, path = (np.concatenate(c) for c in zip(*(unpack_leaves(p, True) for p in parts)))
    order = np.argsort(path, kind="stable")
    sorted_path, sorted_docs = path[order], docs[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_path[1:] != sorted_path[:-1]]))
    least = np.repeat(np.minimum.reduceat(sorted_docs, starts), np.diff([*starts, len(path)]))
    again = order[sorted_docs > least]
    if len(again):
        # rows of one document are one owner; ``check`` tells rows apart that share an id
        keys = np.stack([docs[again], checks[again].astype(np.int64)])
        owners, owner = np.unique(keys, axis=1, return_inverse=True)
        yield from spread_repeats(owners[0], owners[1].astype(np.uint16), owner.ravel(), at[again], buckets)


def find_repeats(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        current, parts = None, []

        def rows(found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            for bucket, data in found:
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([data], pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for target, data in zip(batch.column(0).to_pylist(), (batch.column(1)[i].as_py() for i in range(len(batch)))):
                if target < 0:
                    yield from rows(iter([(-1 - target, data)]))
                    continue
                if target != current and parts:
                    yield from rows(subtree_repeats(parts, buckets))
                    parts = []
                current = target
                parts.append(data)
        if parts:
            yield from rows(subtree_repeats(parts, buckets))

    return run


def apply_repeats(window: int, id_at: int, text_at: int):
    """Rows come sorted by bucket, repeats before documents; id and text stand at these places of a document's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        bucket, repeats = None, {}
        for batch in batches:
            rows = batch.column("_row")
            ids, values = rows.field(id_at), rows.field(text_at)
            kept, n_words, n_removed, which = [], [], [], []
            for i, (home, is_doc) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("is_doc").to_pylist())):
                if home != bucket:
                    bucket, repeats = home, {}
                if not is_doc:
                    docs, checks, at = unpack_leaves(batch.column("data")[i].as_py(), False)
                    edges = [0, *(np.flatnonzero((np.diff(docs) != 0) | (np.diff(checks.astype(np.int64)) != 0)) + 1).tolist(), len(docs)]
                    for a, b in zip(edges, edges[1:]):
                        repeats.setdefault((int(docs[a]), int(checks[a])), []).append(at[a:b])
                    continue
                doc_id, text = ids[i].as_py(), values[i].as_py()
                places = repeats.get((doc_id, check_of(text))) if text and repeats and doc_id is not None else None
                words, total, removed = without(text, places, window)
                kept.append(words)
                n_words.append(total)
                n_removed.append(removed)
                which.append(i)
            if which:
                yield pa.RecordBatch.from_arrays(
                    [rows.take(pa.array(which)), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                    names=["_row", "kept", "n_words", "n_removed"],
                )

    return run


def without(text: str | None, places: list[np.ndarray] | None, window: int) -> tuple[str, int, int]:
    """(kept words joined by one space, words, removed words)."""
    mask, total, parts, removed = None, 0, [], 0
    if places:
        starts = np.unique(np.concatenate(places))
        edge = np.zeros(int(starts[-1]) + window + 1, np.int32)
        edge[starts] += 1
        np.add.at(edge, starts + window, -1)
        mask = np.cumsum(edge)[:-1] > 0
    for words in byte_words(text):
        n = len(words)
        if mask is not None and total < len(mask):
            gone = np.zeros(n, bool)
            own = mask[total : total + n]
            gone[: len(own)] = own
            removed += int(gone.sum())
            words = [words[i] for i in np.flatnonzero(~gone).tolist()]
        total += n
        if words:
            parts.append(b" ".join(words))
    return b" ".join(parts).decode(), total, removed


def drop_repeats(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "repeats", window: int = WINDOW, group: int = GROUP,
) -> DataFrame:
    """Add ``out``: struct (kept: the words left, one space between; n_words; n_removed).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id; windows are
    judged on the input. Within one document, repeats stay. Null and blank texts have no words; a row with a null id is
    kept whole and takes nothing from others; rows that share an id do not shorten each other. An empty table gives none.
    The columns of ``df`` come back as they are.
    """
    spark = df.sparkSession
    narrow = df.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    counted = narrow.select("_text").mapInArrow(count_cells(window), "level bigint, cell bigint, n bigint")
    counts = np.zeros((len(levels(window)), 1 << CELL_BITS), np.int64)
    for row in counted.groupBy("level", "cell").agg(F.sum("n").alias("n")).toLocalIterator():  # one row a cell at most
        counts[row.level, row.cell] = row.n
    groups = Groups(counts, group)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups.number)
    leaves = narrow.mapInArrow(send_suffixes(window, groups, buckets), "target bigint, data binary")
    dealt = leaves.repartition(max(1, groups.number), "target").sortWithinPartitions("target")
    repeats = dealt.mapInArrow(find_repeats(buckets), "bucket bigint, data binary")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    docs = df.select(
        F.coalesce(F.pmod(F.col(doc_id).cast("bigint"), F.lit(buckets)), F.pmod(F.xxhash64(text), F.lit(buckets))).alias("bucket"),
        F.lit(True).alias("is_doc"), F.lit(None).cast("binary").alias("data"),
        row.alias("_row"),
    )
    marks = repeats.select("bucket", F.lit(False).alias("is_doc"), "data", F.lit(None).cast(docs.schema["_row"].dataType).alias("_row"))
    both = docs.unionByName(marks).repartition(buckets, "bucket").sortWithinPartitions("bucket", "is_doc")
    kind = docs.schema["_row"].dataType.simpleString()
    run = apply_repeats(window, df.columns.index(doc_id), df.columns.index(text))
    found = both.mapInArrow(run, f"_row {kind}, kept string, n_words bigint, n_removed bigint")
    return found.select("_row.*", F.struct("kept", "n_words", "n_removed").alias(out))


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept", 256).alias("kept_sha256"))
