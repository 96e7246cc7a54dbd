"""Benchmark decontamination with suffix arrays of the documents' words.

Documents are cut into shards inside each task: runs of whole documents of about
SHARD_WORDS words. A shard's suffix array is built by prefix doubling, as deep as
the longest benchmark item reaches, and every suffix of every item is looked up by
binary search, word by word. That gives its longest verbatim match with a place,
and the interval of all places that repeat its first ``window`` words. Nothing is
shuffled; benchmark items travel in blocks of a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.words import LETTERS, word_slices

WINDOW = 10
SHARD_WORDS = 1_000_000
#: Text bytes of benchmark items in one block, but for a longer single item.
BLOCK_BYTES = 32_000_000


class SuffixArray:
    """Suffixes of word sequences, each ended by a mark that no word equals, in order to ``depth`` words."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, depth: int):
        counts = np.diff(offsets)
        self.vocabulary, ranks = np.unique(words, return_inverse=True)
        n = len(words) + len(counts)
        #: Word ranks from 1, and 0 after each document.
        self.seq = np.zeros(n, dtype=np.int64)
        self.document = np.repeat(np.arange(len(counts)), counts + 1)
        self.starts = offsets[:-1] + np.arange(len(counts))
        is_word = np.ones(n, dtype=bool)
        is_word[self.starts + counts] = False
        self.seq[is_word] = ranks + 1
        self.order, self.first = self._sorted(depth)

    def _sorted(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.seq)
        order = np.argsort(self.seq, kind="stable")
        first = np.searchsorted(self.seq[order], np.arange(len(self.vocabulary) + 2))
        head = first[self.seq]  # rank of a suffix: the first place of its group
        open_places = np.arange(n)
        length = 1
        while length < depth and len(open_places):
            at = order[open_places]
            group = head[at]
            same = np.zeros(len(at), dtype=bool)
            same[1:] = group[1:] == group[:-1]
            same[:-1] |= same[1:]
            open_places, at, group = open_places[same], at[same], group[same]
            if not len(at):
                break
            follow = np.where(at + length < n, head[np.minimum(at + length, n - 1)] + 1, 0)
            by = np.lexsort((follow, group))
            at, group, follow = at[by], group[by], follow[by]
            order[open_places] = at
            new = np.ones(len(at), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
            head[at] = open_places[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            length *= 2
        return order, first

    def _bound(self, low: np.ndarray, high: np.ndarray, step: int, word: np.ndarray, right: bool) -> np.ndarray:
        """Per query, the first place in [low, high) whose word at ``step`` is not below (right: above) ``word``."""
        low, high = low.copy(), high.copy()
        going = np.flatnonzero(low < high)
        while len(going):
            middle = (low[going] + high[going]) >> 1
            at = self.seq[np.minimum(self.order[middle] + step, len(self.seq) - 1)]
            up = at <= word[going] if right else at < word[going]
            low[going] = np.where(up, middle + 1, low[going])
            high[going] = np.where(up, high[going], middle)
            going = going[low[going] < high[going]]
        return low

    def search(self, test: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per test suffix: longest match, one place of it (-1: none), and the interval that repeats its window."""
        near = np.minimum(np.searchsorted(self.vocabulary, test.words), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[near] == test.words if len(self.vocabulary) else np.zeros(len(test.words), bool)
        rank = np.where(known, near + 1, -1)
        total = len(test.words)
        longest, place = np.zeros(total, np.int64), np.full(total, -1)
        low, high = np.zeros(total, np.int64), np.zeros(total, np.int64)
        active = np.flatnonzero(known)
        lo, hi = self.first[rank[active]], self.first[rank[active] + 1]
        step = 1
        while len(active):
            longest[active], place[active] = step, self.order[lo]
            whole = test.window[active] == step
            low[active[whole]], high[active[whole]] = lo[whole], hi[whole]
            on = test.left[active] > step
            active, lo, hi = active[on], lo[on], hi[on]
            word = rank[active + step]
            new = self._bound(lo, hi, step, word, right=False)
            hi = self._bound(new, hi, step, word, right=True)
            on = new < hi
            active, lo, hi = active[on], new[on], hi[on]
            step += 1
        return longest, place, low, high


class Suffixes:
    """All suffixes of the items of one block: words end to end, how many are left at each, and the window that starts there."""

    def __init__(self, rows, window: int):
        rows = [(item, np.frombuffer(words, dtype=np.uint64)) for item, words in rows]
        self.words = np.concatenate([w for _, w in rows]) if rows else np.zeros(0, np.uint64)
        self.item = np.concatenate([np.full(len(w), i) for i, (_, w) in enumerate(rows)]) if rows else np.zeros(0, np.int64)
        self.left = np.concatenate([np.arange(len(w), 0, -1) for _, w in rows]) if rows else np.zeros(0, np.int64)
        size = self.left + np.concatenate([np.arange(len(w)) for _, w in rows]) if rows else self.left
        #: 0 where fewer words are left than the window needs.
        self.window = np.where(self.left >= np.minimum(window, size), np.minimum(window, size), 0)
        self.ids = [item for item, _ in rows]


def item_words(items: DataFrame) -> DataFrame:
    """item_id as text and the item's word hashes, as bytes."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, hashes, offsets in word_slices(batch.column("text"), LETTERS):
                out += [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(out, pa.binary())], ["item_id", "words"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(words, "item_id string, words binary")


def blocks(items: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> tuple[list, int]:
    """Broadcasts of all items in blocks of about ``block_bytes``, and the longest item in words."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    words = item_words(items)
    sent, depth = [], 1
    for k in range(n):
        part = words.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k) if n > 1 else words
        block = Suffixes(sorted(((r[0], bytes(r[1])) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1])), window)
        depth = max(depth, int(block.left.max()) if len(block.left) else 1)
        sent.append(items.sparkSession.sparkContext.broadcast(block))
    return sent, depth


def _shards(batches: Iterator[pa.RecordBatch], columns: list[str], shard_words: int):
    """Rows with their words, in runs of about ``shard_words`` words: (columns, hashes, offsets)."""
    kept, words, offsets, count = [], [], [np.zeros(1, np.int64)], 0
    for batch in batches:
        for first, end, hashes, at in word_slices(batch.column("text"), LETTERS):
            kept.append(batch.slice(first, end - first).select(columns))
            words.append(hashes)
            offsets.append(at[1:] + count)
            count += len(hashes)
            if count >= shard_words:
                yield pa.Table.from_batches(kept), np.concatenate(words), np.concatenate(offsets)
                kept, words, offsets, count = [], [], [np.zeros(1, np.int64)], 0
    if kept:
        yield pa.Table.from_batches(kept), np.concatenate(words), np.concatenate(offsets)


def _occurrences(array: SuffixArray, test: Suffixes, low: np.ndarray, high: np.ndarray):
    """Hits per position of the shard as a difference array, and the (document, item number) pairs."""
    found = np.flatnonzero(low < high)
    # Equal windows of several items have one interval: it is followed once.
    keys = np.stack([low[found], test.window[found]], axis=1)
    distinct, which = np.unique(keys, axis=0, return_inverse=True)
    which = which.ravel()
    ends = np.zeros(len(distinct), np.int64)
    ends[which] = high[found]
    counts = ends - distinct[:, 0]
    interval = np.repeat(np.arange(len(distinct)), counts)
    places = array.order[distinct[interval, 0] + np.arange(len(interval)) - np.repeat(np.cumsum(counts) - counts, counts)]
    change = np.zeros(len(array.seq) + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + distinct[interval, 1], -1)
    pairs = np.unique(np.stack([array.document[places], interval], axis=1), axis=0)
    by_interval = np.unique(np.stack([which, test.item[found]], axis=1), axis=0)
    begin = np.searchsorted(by_interval[:, 0], pairs[:, 1])
    many = np.searchsorted(by_interval[:, 0], pairs[:, 1], side="right") - begin
    rows = np.repeat(np.arange(len(pairs)), many)
    items = by_interval[begin[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many), 1]
    return change, np.unique(np.stack([pairs[rows, 0], items], axis=1), axis=0)


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The columns ``keep`` (doc_id) with n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``.

    Words are runs of digits, letters and non-ASCII, A-Z lower-cased. A window is
    ``window`` consecutive words of an item, or all of a shorter one; words of a
    document inside any occurrence are hit. Null, empty or wordless texts have no
    words and are clean; such items are ignored. An item with a null id marks
    documents but is not counted or listed; rows that share an id are one item.
    Repeated and null doc_ids give a row each. No benchmark rows: everything is clean.
    """
    keep = keep or ["doc_id"]
    sent, depth = blocks(benchmark, window)
    added = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    schema = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string(added).fields)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, offsets in _shards(batches, keep, shard_words):
            n = rows.num_rows
            array = SuffixArray(words, offsets, depth)
            change, items = np.zeros(len(array.seq) + 1, np.int64), [set() for _ in range(n)]
            for block in sent:
                test = block.value
                if len(test.words):
                    _, _, low, high = array.search(test)
                    more, pairs = _occurrences(array, test, low, high)
                    change += more
                    for d, i in pairs:
                        items[d].add(test.ids[i])
            hit = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
            n_words = np.diff(offsets)
            n_hit = hit[array.starts + n_words] - hit[array.starts]
            listed = [sorted(i for i in s if i is not None) for s in items]
            yield from rows.combine_chunks().append_column("n_words", pa.array(n_words, pa.int64())).append_column(
                "n_hit", pa.array(n_hit, pa.int64())
            ).append_column("n_items", pa.array([len(x) for x in listed], pa.int64())).append_column(
                "items_sha256", pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed])
            ).append_column("contaminated", pa.array(n_hit > 0)).to_batches()

    return docs.select("text", *[c for c in keep if c != "text"]).mapInArrow(mark, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """item_id, item_word, length, doc_id, doc_word: each item suffix's longest verbatim match of ``least`` words or more in each shard."""
    sent, depth = blocks(benchmark, least)
    schema = T.StructType(
        T._parse_datatype_string("item_id string, item_word long, length long").fields + [docs.schema["doc_id"], T.StructField("doc_word", T.LongType())]
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, offsets in _shards(batches, ["doc_id"], shard_words):
            array = SuffixArray(words, offsets, depth)
            for block in sent:
                test = block.value
                longest, place, _, _ = array.search(test)
                found = np.flatnonzero(longest >= least)
                doc = array.document[place[found]]
                begins = np.flatnonzero(np.diff(test.item, prepend=-1))
                word = found - begins[np.searchsorted(begins, found, side="right") - 1] if len(found) else found
                yield from pa.table(
                    [
                        pa.array([test.ids[i] for i in test.item[found]], pa.string()),
                        pa.array(word, pa.int64()),
                        pa.array(longest[found], pa.int64()),
                        rows.column("doc_id").combine_chunks().take(pa.array(doc, pa.int64())),
                        pa.array(place[found] - array.starts[doc], pa.int64()),
                    ],
                    ["item_id", "item_word", "length", "doc_id", "doc_word"],
                ).to_batches()

    return docs.select("doc_id", "text").mapInArrow(match, schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, in its columns, that hold no window of the benchmark."""
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return overlaps(packed, benchmark, window, keep=["__row"]).where(~F.col("contaminated")).select("__row.*")
