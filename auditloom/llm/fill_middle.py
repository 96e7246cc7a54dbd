"""Fill-in-middle rows, cut at line ends that a learned rank index finds.

The ends of a text's lines, as code point offsets by rank, are fitted by straight
segments, each as long as a line exists that misses no end by more than ``ERROR``.
What the prediction misses is stored in one byte an end, so the offset of any end is
one prediction and one correction, exactly. Cuts are ranks drawn from the document's id,
so other draws over the stored index need no text. Texts are worked on row by row:
one pass, no shuffle, memory of one batch and one text.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 7
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points by which a segment may miss an end; with one for rounding, what is missed fits a signed byte.
ERROR = 126
#: Of 100 texts, how many are cut, and how many of those take the order suffix, prefix, middle.
CUT_PERCENT, SPM_PERCENT = 100, 50


def line_ends(text: str) -> np.ndarray:
    """0 and the offset behind each line, in code points; a line is ``[^\\n]*\\n`` or a last ``[^\\n]+``."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype="<u4") == 10) + 1
    last = [len(text)] if text and not (len(ends) and ends[-1] == len(text)) else []
    return np.concatenate([[0], ends, last]).astype(np.int64)


class RankIndex:
    """Offsets of ends by rank, as error-bounded segments and a byte of residual each."""

    __slots__ = ("ranks", "offsets", "slopes", "residuals")

    def __init__(self, ranks, offsets, slopes, residuals: bytes):
        self.ranks, self.offsets, self.slopes, self.residuals = ranks, offsets, slopes, residuals

    @classmethod
    def fit(cls, ends: np.ndarray, error: int = ERROR) -> RankIndex:
        """A segment starts at its first end and goes on while some slope misses none by more than ``error``."""
        if not 0 <= error <= ERROR:
            raise ValueError(f"error must be from 0 to {ERROR}")
        ranks, slopes, at, n = [], [], 0, len(ends)
        while at < n:
            low, high, end, step = -math.inf, math.inf, at + 1, 64
            while end < n:
                x = np.arange(end - at, min(end + step, n) - at)
                y = ends[end : end + len(x)] - ends[at]
                lows = np.maximum.accumulate(np.maximum((y - error) / x, low))
                highs = np.minimum.accumulate(np.minimum((y + error) / x, high))
                fits = int(np.searchsorted(lows > highs, True))  # once no slope is left, none comes back
                if fits:
                    low, high = float(lows[fits - 1]), float(highs[fits - 1])
                end += fits
                if fits < len(x):
                    break
                step *= 2
            ranks.append(at)
            slopes.append((low + high) / 2 if end > at + 1 else 0.0)
            at = end
        own = np.repeat(np.arange(len(ranks)), np.diff([*ranks, n]))
        first = np.array(ranks, dtype=np.int64)
        told = np.floor(ends[first[own]] + np.array(slopes)[own] * (np.arange(n) - first[own])).astype(np.int64)
        return cls(ranks, ends[first].tolist(), slopes, (ends - told).astype(np.int8).tobytes())

    def __len__(self) -> int:
        return len(self.residuals) - 1

    def offset(self, rank: int) -> int:
        """Code points up to the end of the line of this rank (0: the text's start), exactly."""
        k = bisect.bisect_right(self.ranks, rank) - 1
        missed = self.residuals[rank]
        return math.floor(self.offsets[k] + self.slopes[k] * (rank - self.ranks[k])) + (missed - 256 if missed > 127 else missed)


INDEX = "n long, segment_ranks array<long>, segment_offsets array<long>, segment_slopes array<double>, residuals binary"


def _with_id(docs: DataFrame, rest: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(rest).fields])


def _batch(ids: pa.Array, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], ["doc_id", *schema.names])


def line_index(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """doc_id, n and the stored rank index of each text's line ends; null counts as empty (n = 0)."""
    schema = pa.schema(
        [("n", pa.int64()), ("segment_ranks", pa.list_(pa.int64())), ("segment_offsets", pa.list_(pa.int64())), ("segment_slopes", pa.list_(pa.float64())), ("residuals", pa.binary())]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                index = RankIndex.fit(line_ends(text.as_py() or ""), error)
                rows.append((len(index), index.ranks, index.offsets, index.slopes, index.residuals))
            yield _batch(batch.column("doc_id"), rows, schema)

    return docs.select("doc_id", "text").mapInArrow(build, _with_id(docs, INDEX))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of the hex SHA-256 of ``seed:doc_id``; a null id is drawn as the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k + 1}") for k in range(4)]


def cut_ranks(n: int, h1: int, h2: int) -> tuple[int, int]:
    """Units in front of the prefix's end and of the middle's end."""
    a, b = h1 % (n + 1), h2 % (n + 1)
    return (a, b) if a <= b else (b, a)


def cuts(index: DataFrame, seed: int) -> DataFrame:
    """doc_id, prefix_chars, middle_chars by the draws of ``seed``, from a stored ``line_index`` alone."""
    schema = pa.schema([("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.drop_columns(["doc_id"]).to_pylist():
                stored = RankIndex(r["segment_ranks"], r["segment_offsets"], r["segment_slopes"], r["residuals"])
                a, b = map(stored.offset, cut_ranks(len(stored), r["__h1"], r["__h2"]))
                rows.append((a, b - a))
            yield _batch(batch.column("doc_id"), rows, schema)

    wanted = index.select("doc_id", "segment_ranks", "segment_offsets", "segment_slopes", "residuals", *draws(index["doc_id"], seed)[:2])
    return wanted.mapInArrow(place, _with_id(index, "prefix_chars long, middle_chars long"))


def fill_in_middle(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, error: int = ERROR) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output of every row of ``docs``.

    Prefix, middle and suffix are whole lines. Form ``psm`` writes prefix, suffix, middle,
    ``spm`` suffix, prefix, middle, each behind its mark. ``plain`` leaves the text as it
    is: empty and null texts (output is empty), texts that hold a mark, and by the third
    draw those beyond ``cut_percent``; their counts of code points are null. Repeated rows
    are cut alike, null ids as the word null; other columns are not read. No rows: no rows.
    """
    schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            drawn = [batch.column(f"__h{k}").to_pylist() for k in (1, 2, 3, 4)]
            for text, h1, h2, h3, h4 in zip(batch.column("text"), *drawn, strict=True):
                text = text.as_py() or ""
                index = RankIndex.fit(line_ends(text), error)
                n = len(index)
                if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= cut_percent:
                    rows.append((n, "plain", None, None, text))
                    continue
                a, b = map(index.offset, cut_ranks(n, h1, h2))
                before, within, after = text[:a], text[a:b], text[b:]
                if h4 % 100 < spm_percent:
                    rows.append((n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{within}"))
                else:
                    rows.append((n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{within}"))
            yield _batch(batch.column("doc_id"), rows, schema)

    wanted = docs.select("doc_id", "text", *draws(docs["doc_id"], seed))
    return wanted.mapInArrow(cut, _with_id(docs, "n long, form string, prefix_chars long, middle_chars long, output string"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; a text that is cut holds no mark, so the marks tell its parts."""
    parts = F.split(output, "<[PSM]>", -1)
    second, third, last = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(second, last, third)).when(form == "spm", F.concat(third, last, second)).otherwise(output)
