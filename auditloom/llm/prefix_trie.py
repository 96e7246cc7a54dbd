"""The prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. Nodes stand in reverse level order, deepest
first, and pass their totals to their parents through a priority queue that hands a message
out when its parent's turn comes. Spark sorts the nodes externally; the queue spills. The trie
is cut into shards: nodes above which more than the square root of all conversations
stand are *heavy*, at most as many a level; below them hang *light* subtrees of at most
that many conversations, which are dealt over the tasks whole. Light shards are done first,
what their roots tell is summed by parent, and the heavy nodes above go last.
Very deep tries are also cut into bands of levels, done from the deepest up. So a hot first
turn, a crowd of equal conversations and a conversation without end are all split.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import SPACED_WORD, running_total
from auditloom.session import materialize

#: A rebuilt conversation borrows from the first one of its group, by crc32 of its id: 0 to SHARED - 1 turns.
GROUP, SHARED = 20, 4
#: Levels of a band: this many, or an eighth of all levels, so that bands are few.
BAND_LEVELS, MOST_BANDS = 1024, 8
#: Messages that a queue holds in memory, and runs that it keeps open, before it spills or merges.
QUEUE_ROWS, QUEUE_RUNS = 500_000, 32
#: Characters of ids that are put together before one task hashes a node's.
CHUNK_CHARS = 1 << 16
KEY = ["depth", "k1", "k2"]


class SpillingQueue:
    """A priority queue of tuples of five 64-bit integers, smallest first; what memory does not hold lies in sorted runs.

    Runs are unnamed scratch files of the task, as a sort's spills are: nothing else reads
    them, and a task that is lost starts again from its input.
    """

    _ROW = struct.Struct("<5q")

    def __init__(self, rows: int = QUEUE_ROWS):
        self.rows, self.heap, self.runs = rows, [], []

    def push(self, message: tuple[int, ...]) -> None:
        if len(self.heap) >= self.rows:
            self._spill()
        heapq.heappush(self.heap, message)

    def first(self) -> tuple[int, ...] | None:
        heads = [h[0] for h in (self.heap, self.runs) if h]
        return min(h if isinstance(h[0], int) else h[0] for h in heads) if heads else None

    def pop(self) -> tuple[int, ...]:
        if not self.runs or (self.heap and self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        message, number, rest = self.runs[0]
        following = next(rest, None)
        if following is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (following, number, rest))
        return message

    def _spill(self) -> None:
        run, self.heap = iter(sorted(self.heap)), []
        if len(self.runs) >= QUEUE_RUNS:
            run, self.runs = heapq.merge(run, *([m] for m, _, _ in self.runs), *(r for _, _, r in self.runs)), []
        stored = self._stored(run)
        message = next(stored)
        number = 1 + max((n for _, n, _ in self.runs), default=0)
        heapq.heappush(self.runs, (message, number, stored))

    def _stored(self, run: Iterator[tuple[int, ...]]) -> Iterator[tuple[int, ...]]:
        file = tempfile.TemporaryFile()  # noqa: SIM115  goes with the iterator
        for message in run:
            file.write(self._ROW.pack(*message))
        file.seek(0)
        return self._read(file)

    def _read(self, file) -> Iterator[tuple[int, ...]]:
        with file:
            while block := file.read(self._ROW.size * 4096):
                yield from self._ROW.iter_unpack(block)


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): the turns of each conversation, numbered from 0; digest tells role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(SPACED_WORD)).cast("long").alias("words"),
    )
    # Ranges of the whole order, so that a conversation of any length is numbered by many tasks.
    ranged = materialize(rows.repartitionByRange("conv_id", "turn", "digest").withColumn("range", F.spark_partition_id()))
    return materialize(running_total(ranged, ["conv_id"], "range", ["turn", "digest"], F.lit(1), "pos").select("conv_id", "pos", "digest", "words"))


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, length, depth from 1, digest, words) of the rebuilt conversations, and (conv_id, length) of all, turnless ones too."""
    heads = turns.where(F.col("pos") < SHARED - 1).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("heads"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.select("*", shared.cast("int").alias("shared"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    none = F.array().cast(heads.schema["heads"].dataType)
    taken = F.coalesce(F.slice("heads", F.lit(1), F.col("shared")), none)
    convs = convs.join(heads, "base", "left").select("conv_id", "n", "shared", taken.alias("heads"))
    own = F.greatest(F.col("n") - F.col("shared"), F.lit(0))
    convs = materialize(convs.select("conv_id", "shared", "heads", (F.size("heads") + own).cast("long").alias("length")))
    borrowed = convs.select("conv_id", "length", F.explode("heads").alias("t"))
    borrowed = borrowed.select("conv_id", "length", (F.col("t.pos") + 1).alias("depth"), "t.digest", "t.words")
    kept = turns.join(convs, "conv_id").where(F.col("pos") >= F.col("shared"))
    depth = F.col("pos") - F.col("shared") + F.size("heads") + 1
    kept = kept.select("conv_id", "length", depth.alias("depth"), "digest", "words")
    return borrowed.unionByName(kept), convs.select("conv_id", "length")


def _with_keys(rows: DataFrame, width: int) -> DataFrame:
    """Adds k1, k2, which tell the first ``depth`` turns, and p1, p2, those of the parent.

    The key of a sequence is the exclusive or of 128-bit hashes of its (place, turn) pairs, so
    ranges of ``width`` places are combined apart and a long conversation is split.
    """
    pairs = rows.withColumns({"x1": F.xxhash64("depth", "digest"), "x2": F.xxhash64("digest", "depth"), "part": F.floor(F.col("depth") / width)})
    sums = pairs.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv_id", "part", *(F.coalesce(F.bit_xor(s).over(ahead), F.lit(0).cast("long")).alias(s) for s in ("s1", "s2")))
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = pairs.join(starts, ["conv_id", "part"])
    keyed = keyed.withColumns({f"k{i}": F.col(f"s{i}").bitwiseXOR(F.bit_xor(f"x{i}").over(so_far)) for i in (1, 2)})
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)]
    return keyed.select("conv_id", "length", *KEY, *parents, "words")


def _ends(ending: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end.

    Ids are sorted over all tasks and written together in pieces, also where one node has
    very many; the task that hashes a node only passes its pieces on, in order.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node or size >= CHUNK_CHARS:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids, size = key, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield _rows(out, PIECES)
            out = []
        yield _rows([(*node, first, ",".join(ids))] if ids else [], PIECES)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield _rows(out, DIGESTS)
        yield _rows([(*node, state.hexdigest())] if node else [], DIGESTS)

    order = [*KEY, "conv_id"]
    told = ending.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, _ddl(PIECES))
    return told.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, _ddl(DIGESTS))


_KEYS = [("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())]
PIECES = pa.schema([*_KEYS, ("first", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([*_KEYS, ("ends_sha256", pa.string())])
TOTALS = pa.schema([*_KEYS, ("p1", pa.int64()), ("p2", pa.int64()), ("exits", pa.bool_()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def forward(batches: Iterator[pa.RecordBatch], rows: int = QUEUE_ROWS) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that come in reverse level order, by (depth descending, k1, k2).

    Columns: depth, k1, k2, p1, p2, exits (the parent is in another shard, so nothing is
    passed on), own (the node's own saved tokens), and what other shards' roots have told it:
    children, their leaves and saved tokens.
    """
    queue = SpillingQueue(rows)
    for batch in batches:
        out = []
        for depth, k1, k2, p1, p2, exits, own, n_children, n_leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            here = (-depth, k1, k2)
            while (message := queue.first()) and message[:3] <= here:
                if message[:3] != here:
                    raise RuntimeError(f"node {message[:3]} is missing among the shard's nodes")
                n_children, n_leaves, saved = n_children + 1, n_leaves + message[3], saved + message[4]
                queue.pop()
            n_leaves, saved = n_leaves if n_children else 1, saved + own
            if not exits:
                queue.push((1 - depth, p1, p2, n_leaves, saved))
            out.append((depth, k1, k2, p1, p2, exits, n_children, n_leaves, saved))
        yield _rows(out, TOTALS)
    if queue.first():
        raise RuntimeError(f"node {queue.first()[:3]} is missing among the shard's nodes")


def _told(totals: list[DataFrame]) -> DataFrame:
    """What the roots of finished shards tell their parents, one row a parent."""
    roots = totals[0]
    for more in totals[1:]:
        roots = roots.unionByName(more)
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    return roots.where("exits").groupBy(*parent).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )


def _totals(nodes: DataFrame, bands: int) -> DataFrame:
    """Totals of all nodes, band by band from the deepest: light shards side by side, then the heavy nodes over them."""
    done: list[DataFrame] = []
    for band in reversed(range(bands)):
        for heavy in (False, True):
            level = nodes.where((F.col("band") == band) & (F.col("heavy") == heavy))
            counts = ["n_children", "n_leaves", "saved_tokens"]
            if done:
                level = level.join(_told(done[-3:]), KEY, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
            else:
                level = level.withColumns({c: F.lit(0).cast("long") for c in counts})
            # A light unit is a subtree's part within the band; all heavy nodes of a band, at most the square root of the conversations a level, are one.
            shard = level.repartition("unit").sortWithinPartitions(F.desc("depth"), "k1", "k2")
            wanted = shard.select(*KEY, "p1", "p2", "exits", "own", *counts)
            done.append(materialize(wanted.mapInArrow(forward, _ddl(TOTALS))))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select(*KEY, "n_children", "n_leaves", "saved_tokens")


def _units(nodes: DataFrame, paths: DataFrame, convs: DataFrame, limit: int, band_levels: int) -> DataFrame:
    """Adds heavy, unit, band, exits and own to the nodes."""
    heavy = nodes.where((F.col("n_convs") > limit) & (F.col("depth") > 0)).select(*KEY)
    lowest = paths.join(heavy, KEY, "left_semi").groupBy("conv_id").agg(F.max("depth").alias("lowest"))
    top = convs.select("conv_id").join(lowest, "conv_id", "left").select("conv_id", (F.coalesce("lowest", F.lit(0)) + 1).alias("top"))
    light = paths.select("conv_id", "depth", "k1").join(top, "conv_id").where("depth = top").select("conv_id", "top", F.col("k1").alias("unit"))
    is_heavy = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    band = F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / band_levels)
    found = nodes.join(light, "conv_id", "left").withColumns({"heavy": is_heavy, "band": band})
    first_of_band = (F.col("depth") > 0) & ((F.col("depth") - 1) % band_levels == 0) & (F.col("band") > 0)
    return found.withColumns(
        {
            "unit": F.when(is_heavy, F.lit(0).cast("long")).otherwise(F.col("unit")),
            "exits": (F.col("depth") == 0) | first_of_band | (~is_heavy & (F.col("depth") == F.col("top"))),
            "own": (F.col("n_convs") - 1) * F.col("words"),
        }
    )


def prefix_trie(conversations: DataFrame, limit: int | None = None, band_levels: int | None = None) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text; other columns are not read. Turns are
    ordered by turn, null first; equal turns by a digest of role and text, so repeated rows
    stand beside each other and stay. Null role or text is empty; rows without a conv_id
    belong to no conversation. Every conversation is rebuilt on the first turns of its
    group's first one (``c - c % 20``, by ``%`` with the sign of c). No conversations: no
    rows, else the root is there, and turnless conversations end at it. ``limit`` (conversations of a
    light subtree) and ``band_levels`` only cut the work.
    """
    turns = _turns(conversations)
    rows, convs = _rebuilt(turns)
    whole = convs.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("rows"), F.coalesce(F.max("length"), F.lit(0)).alias("deepest")).first()
    paths = materialize(_with_keys(rows, max(1024, math.isqrt(whole["rows"]))))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(*(zero.alias(k) for k in (*KEY, "p1", "p2")), "conv_id", "n_convs", zero.alias("words"))
    one = paths.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("p1", "p2")), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    nodes = materialize(one.unionByName(root))
    levels = band_levels or max(BAND_LEVELS, -(-whole["deepest"] // MOST_BANDS))
    cut = materialize(_units(nodes, paths, convs, limit or max(16, math.isqrt(whole["n"])), levels))
    totals = _totals(cut, max(1, -(-whole["deepest"] // levels)))
    ending = paths.where("depth = length").select(*KEY, "conv_id")
    ending = ending.unionByName(convs.where("length = 0").select(*(zero.alias(k) for k in KEY), "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(totals, KEY).join(_ends(ending), KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )
