"""Exact Jaccard self-join of shingle sets by PartEnum signatures.

Sets are dealt into size bands in which similar sets lie in the same or in
neighbouring bands, and each band fixes a bound k on the symmetric difference of a
similar pair. The shingle domain is hashed into n1 parts of n2 subparts. A
pair within k differs in at most k2 shingles of some part, so the two agree on all
of n2 - k2 of its subparts: every choice of n2 - k2 subparts gives a signature, and
some signature is shared. Signatures without shingles would be shared by
unrelated sets; a set needs none of them once more than k / (k2 + 1) of its parts
have a shingle in every choice. A set short of that (a weak one) uses a
further hashing as well, and so on; at the last one it sends empty ones too. Of any
similar pair the set that is strong first finds the other by a filled signature.

Every set that meets others is first compared with the first of its meeting,
verified on whole texts, and links are contracted to components. Meetings that
still hold several components are refined: in one order of all shingles, from the rarest among
their members on, two similar sets share one of the first fifth of their
shingles (and one more), so members meet again by those, across components only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.components import components, extended
from auditloom.llm.words import SPACED, mix64, shingle_hashes, word_slices
from auditloom.session import materialize

WIDTH = 5
#: Meetings up to this size are compared in full across components; members of larger ones meet again by rare shingles.
SMALL = 12
#: (n2, k2) of small and of large k.
FINE, COARSE = (3, 1), (1, 0)
FINE_UP_TO = 8
SLACK = 1.1
HASHINGS = 6
#: Signatures keep 48 bits, which makes chance meetings rare and shuffled rows small; every link is verified.
SIGNATURE_SHIFT = 16
_U = np.uint64


def _bands() -> np.ndarray:
    """First sizes of the bands; below 4 only equal sets are similar. A band ends at 5/4 of its first size."""
    starts = [4]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 5 // 4 + 1)
    return np.array(starts)


BANDS = _bands()


def document_sets(hashes: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, with bounds. Fewer than ``width`` words: one, of them all."""
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    shingles = shingle_hashes(hashes, width) if len(hashes) >= width else np.zeros(0, np.uint64)
    own = owner[: len(shingles)]
    inside = own == owner[width - 1 :] if len(shingles) else np.zeros(0, bool)
    shingles, own = shingles[inside], own[inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.array([shingle_hashes(hashes[offsets[i] : offsets[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        shingles, own = np.concatenate([shingles, mix64(whole + counts[short].astype(np.uint64))]), np.concatenate([own, short])
    order = np.lexsort((shingles, own))
    shingles, own = shingles[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (shingles[1:] != shingles[:-1])
    shingles, own = shingles[new], own[new]
    return shingles, np.searchsorted(own, np.arange(len(counts) + 1))


def _set_ids(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit identity of each set (0 for empty ones), from its size and an order-free sum."""
    sizes = np.diff(bounds).astype(np.uint64)
    sums = np.concatenate([[_U(0)], np.cumsum(mix64(shingles + _U(1)), dtype=np.uint64)])
    return np.where(sizes > 0, mix64(sums[bounds[1:]] - sums[bounds[:-1]] + sizes), _U(0)).astype(np.int64)


def _odd_sketches(shingles: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Per set, the parity of its shingles in each of some cells: two sets' sketches differ in no more bits than the sets do.

    Cells are a power of two, twice the set's size or more, and number a hash's lowest bits, so
    a longer sketch folds onto a shorter one.
    """
    sizes = np.diff(bounds)
    cells = 1 << np.maximum(8, np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(cells)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = (mix64(shingles ^ _U(0x5BD1E995)) & (cells[owner] - 1).astype(np.uint64)).astype(np.int64)
    parity = np.bincount(begin[owner] + cell, minlength=begin[-1]) & 1
    packed = np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(begin[:-1], begin[1:])]


def _bits_apart(one: bytes, other: bytes) -> int:
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set_id, sketch, text_hash of every row."""
    kind = docs.select("doc_id").schema.simpleString()[len("struct<") : -1].split(":", 1)[1]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes_of = batch.column("doc_id"), batch.column("text_hash")
            for first, end, hashes, offsets in word_slices(batch.column("text"), SPACED):
                shingles, bounds = document_sets(hashes, offsets, width)
                sketches = _odd_sketches(shingles, bounds)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), pa.array(np.diff(bounds), pa.int64()), pa.array(_set_ids(shingles, bounds)), pa.array(sketches, pa.binary()), hashes_of.slice(first, end - first)],
                    ["doc_id", "n_shingles", "set_id", "sketch", "text_hash"],
                )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(digest, f"doc_id {kind}, n_shingles long, set_id long, sketch binary, text_hash long")


def _one_hashing(shingles, bounds, n1, k, band, turn, shape):
    """Signatures of some sets under one hashing: (signature, set, filled) and the sets that are weak."""
    n2, k2 = shape
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    seed = mix64((band.astype(np.uint64) << _U(16)) + _U(turn * 64 + n2))
    x = mix64(shingles ^ seed[owner])
    part = ((x >> _U(32)) * n1[owner].astype(np.uint64) >> _U(32)).astype(np.int64)
    sub = ((x & _U(0xFFFFFFFF)) * _U(n2) >> _U(32)).astype(np.int64)
    first_part = np.concatenate([[0], np.cumsum(n1)])
    cell = (first_part[owner] + part) * n2 + sub
    value = mix64(x + _U(0x51ED270B))
    cells = int(first_part[-1]) * n2
    # 64-bit sums by cell from two halves: each stays exact in a double.
    low = np.bincount(cell, weights=(value & _U(0xFFFFFFFF)).astype(np.float64), minlength=cells).astype(np.uint64)
    high = np.bincount(cell, weights=(value >> _U(32)).astype(np.float64), minlength=cells).astype(np.uint64)
    sums = ((high << _U(32)) + low).reshape(-1, n2)
    filled = np.bincount(cell, minlength=cells).reshape(-1, n2) > 0
    of_part = np.repeat(np.arange(len(sizes)), n1)
    number = np.arange(len(of_part)) - first_part[of_part]
    signatures, has = [], []
    for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
        base = mix64(seed[of_part] + (number.astype(np.uint64) << _U(8)) + _U(c))
        signatures.append(mix64(sums[:, chosen].sum(axis=1, dtype=np.uint64) + base))
        has.append(filled[:, chosen].any(axis=1))
    strong = np.bincount(of_part, weights=np.all(has, axis=0), minlength=len(sizes))
    weak = strong <= k // (k2 + 1)
    return np.stack(signatures, axis=1).ravel(), np.repeat(of_part, len(has)), np.stack(has, axis=1).ravel(), weak


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set index) of all sets of 4 and more shingles."""
    sizes = np.diff(bounds)
    out_signatures, out_sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for ahead in (0, 1):
        band = np.searchsorted(BANDS, sizes, side="right") - 1 + ahead
        k = 2 * (BANDS[np.maximum(band, 0) + 1] - 1) // 9
        for shape, chosen in ((FINE, k <= FINE_UP_TO), (COARSE, k > FINE_UP_TO)):
            open_sets = np.flatnonzero(chosen & (sizes >= 4))
            for turn in range(HASHINGS):
                if not len(open_sets):
                    break
                lengths = sizes[open_sets]
                own = np.concatenate([[0], np.cumsum(lengths)])
                at = np.repeat(bounds[:-1][open_sets] - own[:-1], lengths) + np.arange(own[-1])
                n1 = np.ceil((k[open_sets] // (shape[1] + 1) + 1) * SLACK).astype(np.int64)
                n1[k[open_sets] <= shape[1]] = 1
                found, which, filled, weak = _one_hashing(shingles[at], own, n1, k[open_sets], band[open_sets], turn, shape)
                keep = filled | (weak[which] if turn == HASHINGS - 1 else False)
                out_signatures.append(found[keep])
                out_sets.append(open_sets[which[keep]])
                open_sets = open_sets[weak]
    return np.concatenate(out_signatures), np.concatenate(out_sets)


def signature_rows(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """signature, set_id for the sets of all rows; a task sends equal sets once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for _, _, hashes, offsets in word_slices(batch.column("text"), SPACED):
                shingles, bounds = document_sets(hashes, offsets, width)
                ids = _set_ids(shingles, bounds)
                sizes = np.diff(bounds)
                new = np.array([not (i in sent or sent.add(i)) for i in ids.tolist()], bool) & (sizes > 0)
                kept = np.flatnonzero(new)
                inside = np.repeat(new, sizes)
                own = np.concatenate([[0], np.cumsum(sizes[kept])])
                found, which = signatures(shingles[inside], own)
                found = found >> _U(SIGNATURE_SHIFT)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(ids[kept][which])], ["signature", "set_id"])

    return texts.select("text").mapInArrow(sign, "signature long, set_id long")


def meetings(rows: DataFrame) -> DataFrame:
    """kind, a, b from signature rows. 0: first of a meeting and another member; 1: signature and member of a meeting of three or more.

    Rows come sorted by signature, so a meeting is a run; a long run passes through without being held.
    """

    def table(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_set = np.zeros(0, np.int64), np.zeros(0, np.int64)
        passing = None  # (signature, first member) of a run too long to hold

        def closed(key, member):
            if not len(key):
                return
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            length = np.diff(begin, append=len(key))
            later = np.ones(len(key), bool)
            later[begin] = False
            yield table(0, np.repeat(member[begin], length)[later], member[later])
            several = np.repeat(length >= 3, length)
            yield table(1, key[several], member[several])

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            member = np.concatenate([held_set, batch.column(1).to_numpy()])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
            key, member = key[new], member[new]
            if passing is not None:
                same = key == passing[0]
                yield table(0, np.full(same.sum(), passing[1]), member[same])
                yield table(1, key[same], member[same])
                key, member = key[~same], member[~same]
                if not len(key):
                    held_key, held_set = key, member
                    continue
                passing = None
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from closed(key[:last], member[:last])
            held_key, held_set = key[last:], member[last:]
            if len(held_key) > 50_000:
                passing = (held_key[0], held_set[0])
                yield from closed(held_key, held_set)
                held_key, held_set = held_key[:0], held_set[:0]
        yield from closed(held_key, held_set)

    return rows.repartition("signature").sortWithinPartitions("signature", "set_id").mapInArrow(meet, "kind int, a long, b long")


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave possible."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = np.array([_bits_apart(a, b) for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())])
                ok = apart * 9 <= batch.column("na").to_numpy() + batch.column("nb").to_numpy()
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    left = sets.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").where("4 * greatest(na, nb) <= 5 * least(na, nb)")
    return near.mapInArrow(test, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs whose whole texts have 100 * intersection >= 80 * union."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, offsets in word_slices(batch.column("ta"), SPACED):
                sa, ba = document_sets(hashes, offsets, width)
                ok = []
                for r, _, hashes_b, offsets_b in word_slices(batch.column("tb").slice(first, end - first), SPACED):
                    sb, bb = document_sets(hashes_b, offsets_b, width)
                    for i in range(len(bb) - 1):
                        a, b = sa[ba[r + i] : ba[r + i + 1]], sb[bb[i] : bb[i + 1]]
                        common = len(np.intersect1d(a, b, assume_unique=True))
                        ok.append(100 * common >= 80 * (len(a) + len(b) - common))
                yield batch.slice(first, end - first).select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = texts.select(F.col("set_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("set_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(test, "a long, b long")


def _mixed(members: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows (key, set_id, root) of the meetings that still hold several components, with their number n."""
    rooted = members.join(placed.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x != y")
    return rooted.join(mixed.select("key", "n"), "key")


def _rare_shingles(crowd: DataFrame, width: int) -> DataFrame:
    """key, set_id, many: of each set, its rarest shingles among the crowd's sets (set_id, text): a fifth and one more, but those of no other set.

    In one order of all shingles, sets of a similar pair share one of these. many is how many
    shingles of the set, from this one on, any other set has at all: the most that it can
    share with a set whose first shingle in common with it is this one.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("set_id").to_numpy()
            for first, end, hashes, offsets in word_slices(batch.column("text"), SPACED):
                shingles, bounds = document_sets(hashes, offsets, width)
                sizes = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingles.view(np.int64)), pa.array(np.repeat(ids[first:end], sizes)), pa.array(np.repeat(sizes, sizes))], ["key", "set_id", "size"]
                )

    rows = crowd.mapInArrow(spread, "key long, set_id long, size long")
    common = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(common, "key")
    own = Window.partitionBy("set_id")
    ranked = shared.withColumns({"rank": F.row_number().over(own.orderBy("n", "key")), "many": F.count("*").over(own)})
    return ranked.where("rank <= size div 5 + 1 - (size - many)").select("key", "set_id", F.expr("many - rank + 1").alias("many"))


def _across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of each meeting that lie in different components and whose sizes allow a link.

    many, where given, is the most that a member can share if the key is the first that the two have in common:
    a link shares 4/9 of both sizes or more, so it passes at that key at the latest.
    """
    sized = members.join(sets.select("set_id", "n_shingles"), "set_id")
    sized = sized if "many" in members.columns else sized.withColumn("many", F.col("n_shingles"))
    one = sized.select("key", F.col("set_id").alias("a"), F.col("root").alias("ra"), F.col("n_shingles").alias("na"), F.col("many").alias("ma"))
    other = sized.select("key", F.col("set_id").alias("b"), F.col("root").alias("rb"), F.col("n_shingles").alias("nb"), F.col("many").alias("mb"))
    fits = "a < b and ra != rb and 4 * greatest(na, nb) <= 5 * least(na, nb) and 9 * least(ma, mb) >= 4 * (na + nb)"
    return one.join(other, "key").where(fits).select("a", "b").distinct()


def link_sets(docs: DataFrame, sets: DataFrame, width: int = WIDTH) -> DataFrame:
    """Components (node, root) of the sets (set_id, n_shingles, sketch, doc_id) under links; sets without a link are left out."""

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = sets.join(ids.distinct(), "set_id", "left_semi").select("doc_id", "set_id", "n_shingles")
        rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("set_id", "text")
        return materialize(_matching(rows, width))

    met = materialize(meetings(signature_rows(docs, width)))
    likely = materialize(possible(met.where("kind = 0").select("a", "b").distinct(), sets))
    texts = texts_of(likely.select(F.col("a").alias("set_id")).union(likely.select("b")))
    placed = components(verified(likely, texts, width))
    members = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("set_id"))
    mixed = materialize(_mixed(members, placed))

    def more_links(members: DataFrame, texts: DataFrame | None) -> None:
        nonlocal placed
        pairs = materialize(possible(_across(members, sets), sets))
        if pairs.isEmpty():
            return
        texts = texts_of(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b"))) if texts is None else texts
        placed = extended(placed, materialize(verified(pairs, texts, width)))

    more_links(mixed.where(F.col("n") <= SMALL), None)
    crowd = materialize(_mixed(mixed.where(F.col("n") > SMALL).select("key", "set_id"), placed).select("set_id").distinct())
    if crowd.isEmpty():
        return placed
    texts = texts_of(crowd)
    rare = materialize(_mixed(_rare_shingles(texts, width), placed))
    more_links(rare.where(F.col("n") <= SMALL), texts)
    more_links(_mixed(rare.where(F.col("n") > SMALL).select("key", "set_id", "many"), placed), texts)
    return placed


def _matching(rows: DataFrame, width: int) -> DataFrame:
    """One row per set of (set_id, text) rows whose text has that set: rows that share a doc_id may hold other texts."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, offsets in word_slices(batch.column("text"), SPACED):
                ids = _set_ids(*document_sets(hashes, offsets, width))
                part = batch.slice(first, end - first)
                yield part.filter(pa.array(ids == part.column("set_id").to_numpy()))

    return rows.mapInArrow(match, rows.schema).dropDuplicates(["set_id"])


def near_duplicates(docs: DataFrame, width: int = WIDTH, detail: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (detail: and set_id, class and text_hash) of every row.

    Two documents link when their sets of ``width``-word shingles have a Jaccard
    similarity of 0.8 or more; component_id is the smallest doc_id of those reachable.
    Null, empty and blank texts have no set and are alone. Rows with a null doc_id
    take the component of rows with an equal set, else null, and link nothing
    themselves. Rows that share a doc_id are each placed by their own text. class is the
    same for the rows of one component only, whatever their ids (null without a set);
    text_hash is xxhash64 of the text.
    """
    digest = materialize(digests(docs, width))
    sets = digest.where("set_id != 0 and doc_id is not null").groupBy("set_id", "n_shingles")
    sets = materialize(sets.agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")))
    placed = link_sets(docs, sets, width)
    roots = placed.join(sets.select(F.col("set_id").alias("node"), "doc_id"), "node")
    named = roots.groupBy("root").agg(F.min("doc_id").alias("least"))
    classes = sets.select("set_id", "doc_id").join(placed.withColumnRenamed("node", "set_id"), "set_id", "left").join(named, "root", "left")
    classes = classes.select("set_id", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("root", "set_id").alias("class"))
    rows = digest.select("doc_id", "n_shingles", "set_id", "text_hash").join(classes, "set_id", "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set_id", "class", "text_hash")
    return rows if detail else rows.drop("set_id", "class", "text_hash")


def without_near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of ``docs``, in its columns, for each component.

    It has the component's smallest doc_id that no other component has too, else its smallest one: ids that
    several texts share name several components, and none of them goes. Of a component's rows with that id
    the first by text, then by any order, stays. Texts without a set are alone and stay, once for each id.
    Rows with a null doc_id stay unless a document with an id has an equal set.
    """
    digest = materialize(near_duplicates(docs, width, detail=True))
    known = digest.where("doc_id is not null")
    pairs = known.select("doc_id", F.col("set_id") != 0, F.coalesce("class", "text_hash")).toDF("doc_id", "__set", "class").distinct()
    several = pairs.groupBy("doc_id").agg((F.count("*") > 1).alias("__several"))
    named = pairs.where("__set").join(several, "doc_id").groupBy("class").agg(F.min(F.struct("__several", "doc_id")).alias("n"))
    named = named.select("class", F.col("n.doc_id").alias("doc_id"))
    standing = known.join(named, ["class", "doc_id"]).groupBy("class", "doc_id").agg(F.min("text_hash").alias("__hash")).select("doc_id", "__hash")
    blank = known.where("set_id = 0").select("doc_id", F.col("text_hash").alias("__hash"))
    unnamed = digest.where("doc_id is null and component_id is null").select("doc_id", F.col("text_hash").alias("__hash"))
    keep = standing.union(blank).union(unnamed).distinct()
    keep = keep.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), "__hash")
    packed = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.xxhash64("text").alias("__hash"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
    )
    own = Window.partitionBy("__id", "__none", "__hash").orderBy("__id")
    kept = packed.join(keep, ["__id", "__none", "__hash"]).withColumn("__turn", F.row_number().over(own))
    return kept.where("__none or __turn = 1").select("__row.*")
