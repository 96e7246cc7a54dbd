"""Exact encoding and decoding for merge-type (BPE) sentencepiece models, by backtracking.

A piece string is the model's own encoding of a text exactly if each two neighbours stay
apart when their joined text is merged again. So the encoding is searched for: at each
position the longest piece that starts there (an Aho-Corasick automaton finds them all in one pass)
is tried first, then its shorter prefixes, until one stands beside the piece before it; a
position from which none does is marked in a bitfield and left for good. Texts fall into
segments that no piece crosses (a run of spaces with what follows it, line feeds alone);
a worker searches each distinct segment once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Segments of a generation and neighbours that a worker keeps; beyond that older ones go, which changes speed only.
KEPT_SEGMENTS = 320_000
KEPT_PAIRS = 600_000
#: Numbers of pieces and characters take so many bits in a pair's key.
NUMBER_BITS = 21
_LOADED: dict[str, PieceCodec] = {}


class _Segments(dict):
    """Ids of segments, as bytes of 32-bit integers, in two generations: a full young one becomes the old one, and what is met again is young again."""

    def __init__(self, codec: PieceCodec):
        self.codec, self.old = codec, {}

    def __missing__(self, segment: str) -> bytes:
        ids = self.old.get(segment)
        if ids is None:
            ids = b"".join(map(self.codec.coded.__getitem__, self.codec.numbers(segment.replace(" ", SPACE))))
        if len(self) >= KEPT_SEGMENTS:
            self.old = dict(self)
            self.clear()
        self[segment] = ids
        return ids


class _Numbers(dict):
    """Numbers from 1, in the order in which tokens are met, so that pairs are looked up by an integer; 0 is no token."""

    def __init__(self, codec: PieceCodec):
        self.codec = codec

    def __missing__(self, token: str) -> int:
        codec = self.codec
        self[token] = number = len(codec.names)
        codec.names.append(token)
        codec.lengths.append(len(token))
        codec.coded.append(array("i", codec.ids_of(token)).tobytes())
        return number


class PieceCodec:
    """One sentencepiece BPE model with byte fallback, identity normalisation and a space put in front."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        every = range(sp.get_piece_size())
        own = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in own}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in own}
        self.byte_id = {int(sp.id_to_piece(i)[3:-1], 16): i for i in every if sp.is_byte(i)}
        crossing = [p for p in self.id if "\n" in p or SPACE in p.lstrip(SPACE)]
        if crossing or len(self.byte_id) != 256 or sp.normalize("Ａ  b\t") != f"{SPACE}Ａ{SPACE}{SPACE}b\t":
            raise ValueError("needs a model with identity normalisation and byte fallback whose pieces hold spaces in front only")
        #: What an id writes; bytes stand for themselves, control ids write nothing.
        self.written = [b""] * len(every)
        for piece, i in self.id.items():
            self.written[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte_id.items():
            self.written[i] = bytes([value])
        unknown = sp.unk_id()
        if unknown >= 0:
            self.written[unknown] = " ⁇ ".encode()
        self.spaced = {i for p, i in self.id.items() if p.startswith(SPACE)}
        self.is_byte = set(self.byte_id.values())
        self.silent = {i for i in every if not self.written[i]}
        self.number, self.names, self.lengths, self.coded = _Numbers(self), [""], [0], [b""]
        self.shorter: dict[int, int] = {}
        self.apart: dict[int, bool] = {}
        # Segments hold plain spaces, which takes a byte a character in most texts.
        self.segments = re.compile(" +[^ \n]*|[^ \n]+|\n").findall
        self.known = _Segments(self)

    @cached_property
    def matcher(self):
        """Pieces read from their ends, so that a match that ends at a place of the turned text starts there in the text."""
        import ahocorasick

        matcher = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for piece in self.id:
            matcher.add_word(piece[::-1])
        matcher.make_automaton()
        return matcher

    def stay_apart(self, left: str | None, right: str) -> bool:
        """Whether merging the joined text again gives back the two; with no left, whether ``right`` comes back whole.

        The best-scored adjacent pair is merged first, the leftmost among equals, until none is left.
        """
        parts, border, score = [*(left or ""), *right], len(left or ""), self.score.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0 or at + 1 == border:
                break  # nothing is left to merge, or the merge crosses the border
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            border -= at + 1 < border
        return at < 0 and len(parts) == (1 if left is None else 2)

    def _fits(self, last: int, candidate: int) -> bool:
        if len(self.apart) >= KEPT_PAIRS:
            self.apart.clear()
        fits = self.stay_apart(self.names[last] if last else None, self.names[candidate])
        self.apart[last << NUMBER_BITS | candidate] = fits
        return fits

    def _next_shorter(self, candidate: int) -> int:
        """The longest piece that the token goes on from, in the end its first character; then 0."""
        token = self.names[candidate]
        shorter = next((token[:k] for k in range(len(token) - 1, 0, -1) if k == 1 or token[:k] in self.id), None)
        self.shorter[candidate] = number = self.number[shorter] if shorter else 0
        return number

    def longest_matches(self, text: str) -> list[int]:
        """Length of the longest piece that starts at each place; 1 where none does."""
        longest, last = [1] * len(text), len(text) - 1
        for end, length in self.matcher.iter(text[::-1]):
            if length > longest[last - end]:
                longest[last - end] = length
        return longest

    def numbers(self, text: str) -> list[int]:
        """Numbers of the text's pieces, and of characters that are none."""
        if not text:
            return []
        number, lengths = self.number, self.lengths
        known, shorter = self.apart.get, self.shorter.get
        if text in self.id:  # the longest match at the first place is the text
            whole = number[text]
            fits = known(whole)
            if self._fits(0, whole) if fits is None else fits:
                return [whole]
        longest, found, at, last, size = self.longest_matches(text), [], 0, 0, len(text)
        failed = bytearray(size // 8 + 1)
        candidate = number[text[: longest[0]]]
        while at < size:
            while candidate:
                end = at + lengths[candidate]
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = known(last << NUMBER_BITS | candidate)
                    if fits is None:
                        fits = self._fits(last, candidate)
                    if fits:
                        break
                after = shorter(candidate)
                candidate = self._next_shorter(candidate) if after is None else after
            if candidate:
                found.append(candidate)
                last, at = candidate, end
                if at < size:
                    candidate = number[text[at : at + longest[at]]]
            else:
                if not last:
                    raise ValueError("the model's merges contradict themselves")
                failed[at >> 3] |= 1 << (at & 7)
                # The last token's end has failed, so a shorter one comes next.
                candidate = found.pop()
                last, at = found[-1] if found else 0, at - lengths[candidate]
        return found

    def tokens(self, text: str) -> list[str]:
        """The text's pieces, and characters that are none."""
        return [self.names[n] for n in self.numbers(text)]

    def ids_of(self, token: str) -> list[int]:
        """The piece's id, or those of the bytes of a character that is no piece."""
        own = self.id.get(token)
        return [own] if own is not None else [self.byte_id[b] for b in token.encode()]

    def encode(self, text: str) -> bytes:
        """Ids as bytes of 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.segments(" " + text.replace(SPACE, " ")))) if text else b""

    def decode(self, ids: list[int]) -> str:
        """The text of any ids of the model, special ids among them; byte runs that are no UTF-8 give U+FFFD for each bad byte."""
        first = next((i for i in ids if i not in self.silent), None)
        if not self.silent.isdisjoint(ids):
            return self._by_runs(ids, first)
        out = b"".join(map(self.written.__getitem__, ids))
        try:
            return out[first in self.spaced :].decode()
        except UnicodeDecodeError:
            return self._by_runs(ids, first)

    def _by_runs(self, ids: list[int], first: int | None) -> str:
        parts, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.is_byte:
                run += self.written[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(run[:n].decode())
                    except UnicodeDecodeError:
                        continue
                    break
                else:
                    parts.append("�")
                    n = 1
                del run[:n]
            if i is not None:
                parts.append(self.written[i].decode())
        text = "".join(parts)
        return text[1:] if first in self.spaced else text


def codec(model_file: str) -> PieceCodec:
    """One per worker process and model."""
    if model_file not in _LOADED:
        _LOADED[model_file] = PieceCodec(model_file)
    return _LOADED[model_file]


def _with_id(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), T.StructField(name, kind)])


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array of int) of every row's whole text, as the library encodes it without begin or end.

    Null and empty texts have no ids. Repeated and null ids of documents give a row each;
    other columns are not read. No rows: no rows. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            told = [own.encode(text.as_py() or "") for text in batch.column("text")]
            ends = np.cumsum([0, *(len(t) // 4 for t in told)])
            values = pa.array(np.frombuffer(b"".join(told), dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, _with_id(docs, "ids", T.ArrayType(T.IntegerType(), False)))


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids, text of every row of (doc_id, ids), as the library decodes them; null ids give an empty text."""
    schema = T.StructType([*_with_id(encoded, "ids", encoded.schema["ids"].dataType).fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            ids = batch.column("ids")
            values, ends = np.asarray(ids.values), np.asarray(ids.offsets)
            texts = [own.decode(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
