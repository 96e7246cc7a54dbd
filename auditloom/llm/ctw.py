"""Language-model scores by context-tree weighting over bytes.

A text is read as its lower-cased words joined by single spaces and ended by a line
feed. A byte is eight binary decisions, each with a context tree over the
preceding DEPTH bytes. A node keeps the counts of its decision in all training texts,
its Krichevsky-Trofimov estimate Pe, and Pw = (Pe + product of the children's Pw) / 2. A
decision's probability mixes the estimates on its context path, each node with the
weight Pe / (Pe + product of the children's Pw) that training has given it.

Nothing that grows with the corpus is sent to all tasks. Documents are dealt into chunks of
about CHUNK_BYTES, moved compressed. A chunk lists its distinct byte strings (context and byte) and words with
their training counts; lists are cut into buckets of whole three-byte contexts, summed
over chunks, and answered for each chunk that asked; scoring joins a chunk with its answers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.words import SPACED, hash_words, mix64
from auditloom.session import materialize

DEPTH = 5
CHUNK_BYTES = 32_000_000
#: Distinct keys of all chunks together in one bucket.
BUCKET_KEYS = 1_000_000
HELD_OUT = 1
_U = np.uint64
_HALF = 2 * math.lgamma(0.5)
_LISTS = "chunk long, kind string, bucket long, n long, keys binary, counts binary"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers above 0, by Stirling's series after a shift by 8."""
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def log_pe(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov estimate of a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - _HALF


def log_pw(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) - math.log(2)


def weight(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def chance_of_one(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1)


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=kind)


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


class KeyIndex:
    """Places of distinct 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, int(2 * len(keys)).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        slot, waiting = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(waiting):
            free = self.table[slot] < 0
            self.table[slot[free]] = waiting[free]
            out = self.table[slot] != waiting
            waiting, slot = waiting[out], (slot[out] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def places(self, asked: np.ndarray) -> np.ndarray:
        """Of keys that are all known."""
        slot = self._slot(asked)
        found = self.table[slot]
        wrong = np.flatnonzero(self.keys[found] != asked)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            found[wrong] = self.table[slot[wrong]]
            wrong = wrong[self.keys[found[wrong]] != asked[wrong]]
        return found


def _prepared(rows: DataFrame) -> DataFrame:
    """chunk, ids, held, blob: documents of one chunk as they are modelled, end to end and compressed, some hundreds a row."""
    kind = dict(rows.dtypes)["doc_id"]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            chunks, groups = _groups(chunk[order], order)
            blobs = []
            for group in groups:
                texts = batch.column("text").take(pa.array(group)).to_pylist()
                blobs.append(zlib.compress(b"".join([b" ".join((t or "").encode().lower().split()) + b"\n" for t in texts]), 1))
            sizes = pa.array(np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(np.int32))
            ids = pa.ListArray.from_arrays(sizes, batch.column("doc_id").take(pa.array(order)))
            held = pa.ListArray.from_arrays(sizes, batch.column("held_out").take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([pa.array(chunks), ids, held, pa.array(blobs, pa.binary())], ["chunk", "ids", "held", "blob"])

    return rows.mapInArrow(prepare, f"chunk long, ids array<{kind}>, held array<boolean>, blob binary")


def _texts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a blob and where its documents begin, with the end."""
    data = np.frombuffer(zlib.decompress(blob), np.uint8)
    return data, np.concatenate([[0], np.flatnonzero(data == 10) + 1])


def strings(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """At each byte, the ``depth`` bytes before it in its text (line feeds before the text) and the byte, as one number."""
    code = np.zeros(len(data), np.uint64)
    place = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(depth, -1, -1):
        past = np.full(len(data), 10, np.uint8)
        past[back:] = data[: len(data) - back]
        past[place < back] = 10
        code = (code << _U(8)) | past
    return code


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def _bucket(kind: str, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Strings of one three-byte context share a bucket."""
    whole = (keys >> _U(8)) & _U(0xFFFFFF) if kind == "string" else keys
    return (mix64(whole) % _U(buckets)).astype(np.int64)


def _lists(prepared: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Per chunk, kind and bucket: the distinct keys of its texts and their counts in training texts."""

    def listed(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        keys, counts = {"string": [], "word": []}, {"string": [], "word": []}
        for blob, held in zip(table.column("blob").to_pylist(), table.column("held").to_pylist()):
            data, starts = _texts(blob)
            words, at = hash_words(data, starts, SPACED)
            trained = ~np.array(held, bool)
            for kind, values, sizes in (("string", strings(data, starts, depth), np.diff(starts)), ("word", words, np.diff(at))):
                own = np.repeat(trained, sizes)
                for part, learn in ((values[own], True), (values[~own], False)):
                    distinct, n = np.unique(part, return_counts=True)
                    keys[kind].append(distinct)
                    counts[kind].append(n if learn else np.zeros(len(n), np.int64))
            if len(keys["word"]) >= 32:
                for kind in keys:
                    k, c = _merged(keys[kind], counts[kind])
                    keys[kind], counts[kind] = [k], [c]
        rows = []
        for kind in keys:
            k, c = _merged(keys[kind], counts[kind])
            bucket = _bucket(kind, k, buckets)
            order = np.argsort(bucket, kind="stable")
            for b, group in zip(*_groups(bucket[order], order)):
                own = k[group]
                rows.append((chunk, kind, int(b), len(own), _packed(np.diff(own, prepend=_U(0))), _packed(c[group])))
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["chunk", "kind", "bucket", "n", "keys", "counts"])

    return prepared.groupBy("chunk").applyInArrow(listed, _LISTS)


def _groups(values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[begin], np.split(order, begin[1:]) if len(values) else []


def _sums(lists: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of a bucket, their training counts over all chunks, and each list's places among them."""
    each = [_keys(k) for k in lists["keys"]]
    distinct, inverse = np.unique(np.concatenate(each), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([_unpacked(c, np.int64) for c in lists["counts"]]), minlength=len(distinct))
    return distinct, counts, np.split(inverse, np.cumsum([len(k) for k in each])[:-1])


def _nodes(distinct: np.ndarray, counts: np.ndarray, depth: int, upto: int) -> list[dict]:
    """The trees' nodes from depth ``depth`` up to ``upto``: key (context, decision), counts, and what Pw's need; deepest first.

    at[k] gives, for decision k of each string, the node's place.
    """
    byte = (distinct & _U(255)).astype(np.int64)
    context = distinct >> _U(8)
    bits = [(byte >> (7 - k)) & 1 for k in range(8)]
    decision = [(1 << k) | (byte >> (8 - k)) for k in range(8)]
    levels = []
    for d in range(depth, upto - 1, -1):
        own = context & _U((1 << 8 * d) - 1)
        keys = np.concatenate([(own << _U(8)) | x.astype(np.uint64) for x in decision])
        key, at = np.unique(keys, return_inverse=True)
        n1 = np.bincount(at, weights=np.concatenate([counts * b for b in bits]), minlength=len(key))
        n0 = np.bincount(at, weights=np.concatenate([counts * (1 - b) for b in bits]), minlength=len(key))
        pe = log_pe(n0, n1)
        if levels:
            child = levels[-1]
            parent = ((child["key"] >> _U(8)) & _U((1 << 8 * d) - 1)) << _U(8) | (child["key"] & _U(255))
            below = np.bincount(np.searchsorted(key, parent), weights=child["pw"], minlength=len(key))
            levels.append({"key": key, "at": at.reshape(8, -1), "n0": n0, "n1": n1, "pe": pe, "below": below, "pw": log_pw(pe, below)})
        else:
            levels.append({"key": key, "at": at.reshape(8, -1), "n0": n0, "n1": n1, "pe": pe, "pw": pe})
    return levels


def _deep_roots(lists: DataFrame, depth: int) -> DataFrame:
    """bucket, key, n0, n1, pw of all nodes with a three-byte context."""

    def roots(pdf: pd.DataFrame) -> pd.DataFrame:
        distinct, counts, _ = _sums(pdf)
        top = _nodes(distinct, counts, depth, 3)[-1]
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[0], "key": top["key"].astype(np.int64), "n0": top["n0"], "n1": top["n1"], "pw": top["pw"]})

    return lists.where("kind = 'string'").groupBy("bucket").applyInPandas(roots, "bucket long, key long, n0 double, n1 double, pw double")


def _shallow(roots: DataFrame) -> DataFrame:
    """bucket, key (three-byte context and decision), a, b: the decision's chance is a + b * the chance by deeper nodes."""
    two = roots.groupBy(F.expr("key & 16777215").alias("key2")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        """Nodes with one-byte context ``key1`` (256 contexts of two bytes at most), over their two-byte ones."""
        n0, n1, below = (pdf[c].to_numpy() for c in ("n0", "n1", "below"))
        decision = (pdf["key2"] & 255).to_numpy()
        pe = log_pe(n0, n1)
        g2 = weight(pe, below)
        s0, s1, sb = (np.bincount(decision, weights=x, minlength=256) for x in (n0, n1, log_pw(pe, below)))
        pe1 = log_pe(s0, s1)
        g1 = weight(pe1, sb)
        a = g1 * chance_of_one(s0, s1)
        return pd.DataFrame({
            "key2": pdf["key2"], "decision": decision, "n0": n0, "n1": n1, "pw1": log_pw(pe1, sb)[decision],
            "a": a[decision] + (1 - g1)[decision] * g2 * chance_of_one(n0, n1), "b": (1 - g1)[decision] * (1 - g2),
        })

    schema = "key2 long, decision long, n0 double, n1 double, pw1 double, a double, b double"
    two = materialize(two.groupBy(F.expr("(key2 div 256) % 256").alias("key1")).applyInPandas(lambda pdf: one(pdf.drop(columns="key1", errors="ignore")), schema))
    # The root has 255 decisions; each counts every one-byte context's Pw once.
    by_one = two.groupBy("decision", F.expr("(key2 div 256) % 256").alias("key1")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("pw1").alias("pw"))
    root = by_one.groupBy("decision").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below")).toPandas().sort_values("decision")
    n0, n1, below = (np.zeros(256) for _ in range(3))
    for own, column in ((n0, "n0"), (n1, "n1"), (below, "below")):
        own[root["decision"].to_numpy(dtype=np.int64)] = root[column].to_numpy()
    g0 = weight(log_pe(n0, n1), below)
    table = roots.sparkSession.createDataFrame(pd.DataFrame({"decision": np.arange(256), "a0": g0 * chance_of_one(n0, n1), "b0": 1 - g0}))
    two = two.join(F.broadcast(table), "decision").select("key2", (F.col("a0") + F.col("b0") * F.col("a")).alias("a"), (F.col("b0") * F.col("b")).alias("b"))
    return roots.select("bucket", "key", F.expr("key & 16777215").alias("key2")).join(two, "key2").select("bucket", "key", "a", "b")


def _answers(lists: DataFrame, shallow: DataFrame, depth: int) -> DataFrame:
    """chunk, kind, keys, values: of strings log10 probabilities, of words training counts; and a row per bucket of word totals (chunk -1)."""

    def string_answers(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        distinct, counts, places = _sums(pdf)
        levels = _nodes(distinct, counts, depth, 3)
        byte = (distinct & _U(255)).astype(np.int64)
        known = np.argsort(above["key"].to_numpy())
        top = levels[-1]["key"].astype(np.int64)
        row = known[np.searchsorted(above["key"].to_numpy()[known], top)]
        a, b = above["a"].to_numpy()[row], above["b"].to_numpy()[row]
        value = np.zeros(len(distinct))
        for k in range(8):
            leaf = levels[0]
            p = chance_of_one(leaf["n0"], leaf["n1"])[leaf["at"][k]]
            for level in levels[1:]:
                at = level["at"][k]
                g = weight(level["pe"], level["below"])[at]
                p = g * chance_of_one(level["n0"], level["n1"])[at] + (1 - g) * p
            at = levels[-1]["at"][k]
            p = a[at] + b[at] * p
            value += np.log10(np.where((byte >> (7 - k)) & 1, p, 1 - p))
        return pd.DataFrame({"chunk": pdf["chunk"], "kind": "string", "keys": pdf["keys"], "values": [_packed(value[x].astype(np.float32)) for x in places], "n": 0, "v": 0})

    def word_answers(pdf: pd.DataFrame) -> pd.DataFrame:
        _, counts, places = _sums(pdf)
        out = pd.DataFrame({"chunk": pdf["chunk"], "kind": "word", "keys": pdf["keys"], "values": [_packed(counts[x]) for x in places], "n": 0, "v": 0})
        totals = pd.DataFrame({"chunk": [-1], "kind": ["total"], "keys": [b""], "values": [b""], "n": [int(counts.sum())], "v": [int((counts > 0).sum())]})
        return pd.concat([out, totals], ignore_index=True)

    schema = "chunk long, kind string, keys binary, values binary, n long, v long"
    by_string = lists.where("kind = 'string'").groupBy("bucket").cogroup(shallow.groupBy("bucket")).applyInPandas(string_answers, schema)
    return by_string.union(lists.where("kind = 'word'").groupBy("bucket").applyInPandas(word_answers, schema))


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 5 == HELD_OUT


def scores(docs: DataFrame, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Training texts are those whose id's crc32 modulo 5 is not 1 (a null id counts as the
    text ``null``). Tokens are words and one end, in the base as in the model, where
    it is the line feed; null, empty and blank texts are the end alone. score is the log10
    probability of the text's bytes; divided by the bytes it is the code length.
    Repeated rows train and score once each. Without training texts the estimates are those of no counts.
    """
    if depth < 4 or depth > 7:
        raise ValueError("depth is 4 to 7")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = total // chunk_bytes + 1
    rows = docs.select("doc_id", "text", _held_out().alias("held_out"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    buckets = max(8, -(-total // (8 * BUCKET_KEYS)))
    prepared = _prepared(rows)
    lists = materialize(_lists(prepared, depth, buckets))
    roots = materialize(_deep_roots(lists, depth))
    answers = materialize(_answers(lists, _shallow(roots), depth))
    n, v, ends = answers.where("kind = 'total'").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0)), F.count("*")).first()
    trained = rows.where("not held_out").count()
    # Ends are tokens too: one for each training text.
    n, v, ends = n + trained, v + (trained > 0), trained
    floor = n + 0.5 * (v + 1)

    def give(texts: pa.Table, told: pa.Table) -> pa.Table:
        index, values = {}, {}
        for kind, type_ in (("string", np.float32), ("word", np.float64)):
            own = told.filter(pc.equal(told.column("kind"), kind))
            keys = [_keys(k) for k in own.column("keys").to_pylist()]
            found = [_unpacked(x, type_) for x in own.column("values").to_pylist()]
            index[kind] = KeyIndex(np.concatenate(keys) if keys else np.zeros(0, np.uint64))
            values[kind] = np.concatenate(found) if found else np.zeros(0)
        tokens, known, base, score = [], [], [], []
        end = math.log10((ends + 0.5) / floor)
        for blob in texts.column("blob").to_pylist():
            data, starts = _texts(blob)
            chance = values["string"][index["string"].places(strings(data, starts, depth))].astype(np.float64)
            score.append(np.add.reduceat(chance, starts[:-1]))
            words, at = hash_words(data, starts, SPACED)
            c = values["word"][index["word"].places(words)] if len(words) else np.zeros(0)
            upto = np.concatenate([[0.0], np.cumsum(np.log10((c + 0.5) / floor))])
            seen = np.concatenate([[0], np.cumsum(c > 0)])
            tokens.append(np.diff(at) + 1)
            known.append(seen[at[1:]] - seen[at[:-1]] + (ends > 0))
            base.append(upto[at[1:]] - upto[at[:-1]] + end)
        columns = [pc.list_flatten(texts.column("ids")), pc.list_flatten(texts.column("held"))]
        columns += [pa.array(np.concatenate(x).astype(np.int64)) for x in (tokens, known)]
        columns += [pa.array(np.full(len(columns[0]), n, np.int64))] + [pa.array(np.concatenate(x)) for x in (base, score)]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    own = answers.where("chunk >= 0").select("chunk", "kind", "keys", "values")
    return prepared.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(give, schema)
