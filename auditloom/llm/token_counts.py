"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For byte-pair merging by piece priority, the tokens of a prefix are fixed by its
last token: it is the one piece that ends the prefix and stands unmerged beside
the last token of what precedes it. Two tokens stand side by side when merging
their joined text gives back exactly the two. So one pass over the prefixes, each
looking back while some piece has that ending, stores last token and count; counts of
all prefixes, longest prefixes within a budget and truncations then need no
encoding. Texts fall into segments that no piece crosses (a run of spaces with
what follows it, line feeds alone); a segment's counts are computed once per worker.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
LIMIT = 4096
#: Segments whose counts a worker keeps; beyond that it starts afresh, which changes speed only.
KEPT_SEGMENTS = 1_000_000
KEPT_PAIRS = 1_000_000
NEVER = float("-inf")
_LOADED: dict[str, PrefixCounts] = {}


class _Totals(dict):
    """Counts of segments by their text without ``lead``."""

    def __init__(self, counter: PrefixCounts, lead: str):
        self.counter, self.lead = counter, lead

    def __missing__(self, rest: str) -> int:
        if len(self) >= KEPT_SEGMENTS:
            self.clear()
        self[rest] = n = self.counter.segment_counts(self.lead + rest)[-1]
        return n


class PrefixCounts:
    """Counts for one sentencepiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        crossing = [p for p in self.score if "\n" in p or (SPACE in p.lstrip(SPACE))]
        if crossing or sp.normalize("Ａ  b\t") != f"{SPACE}Ａ{SPACE}{SPACE}b\t":
            raise ValueError("needs a model with identity normalisation whose pieces hold spaces in front only")
        self.segments = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall
        self.beside: dict[int, bool] = {}
        self.spines: dict[int, list[tuple[str, float]]] = {}
        self.after_space, self.bare = _Totals(self, SPACE), _Totals(self, "")
        # Token numbers: pieces, then characters met that are no piece (told as bytes), 0 for the text's start.
        self.tokens: list[str] = [""]
        self.cost: list[int] = [0]
        #: Pieces read from their ends: a tree of characters, with the token number under "".
        self.endings: dict = {}
        for piece in self.score:
            self._add(piece, 1)

    def _add(self, token: str, cost: int) -> int:
        node = self.endings
        for char in reversed(token):
            node = node.setdefault(char, {})
        node[""] = number = len(self.tokens)
        self.tokens.append(token)
        self.cost.append(cost)
        return number

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """Tokens by repeated merging of the best adjacent pair, the leftmost among equals; for short texts."""
        parts = list(text)
        while len(parts) > down_to:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1], NEVER)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, number: int, side: int) -> list[tuple[str, float]]:
        """The token's parts at its right (1) or left (0) border with their scores, from the character up to the token."""
        key = number << 1 | side
        if key not in self.spines:
            token, chain = self.tokens[number], []
            while len(token) > 1:
                parts = self.merged(token, 2)
                if len(self.merged("".join(parts))) > 1:
                    chain = []  # no merges lead to it
                    break
                chain.append((token, self.score[token]))
                token = parts[side]
            else:
                chain.append((token, self.score.get(token, 0.0)))
            self.spines[key] = chain[::-1]
        return self.spines[key]

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merging the joined text of the tokens gives back the two.

        Follows the merges at the border in order of score: they stay apart unless a
        merge across it comes before the next on either side (at equal scores the left one is first).
        """
        if len(self.beside) >= KEPT_PAIRS:
            self.beside.clear()
        self.beside[left << 32 | right] = fits = self._apart(left, right)
        return fits

    def _apart(self, left: int, right: int) -> bool:
        b = self.spine(right, 0)
        if not left or not b:
            return bool(b)
        a, i, j = self.spine(left, 1), 0, 0
        while True:
            left_next = a[i + 1][1] if i + 1 < len(a) else NEVER
            right_next = b[j + 1][1] if j + 1 < len(b) else NEVER
            across = self.score.get(a[i][0] + b[j][0], NEVER)
            if across > left_next and across >= right_next and across > NEVER:
                return False
            if left_next == right_next == NEVER:
                return True
            if left_next >= right_next:
                i += 1
            else:
                j += 1

    def segment_counts(self, segment: str) -> list[int]:
        """Counts at prefixes of length 0, 1, ... of the segment."""
        known, cost, endings = self.beside.get, self.cost, self.endings
        last, counts = [0], [0]
        for end, char in enumerate(segment):
            node = endings.get(char)
            if node is None or "" not in node:
                self._add(char, len(char.encode()))
                node = endings[char]
            start = end
            while True:
                token = node.get("")
                if token is not None:
                    fits = known(last[start] << 32 | token)
                    if fits is None:
                        fits = self.side_by_side(last[start], token)
                    if fits:
                        last.append(token)
                        counts.append(counts[start] + cost[token])
                        break
                start -= 1
                node = node[segment[start]]  # some token ends here, or the model's merges contradict themselves
        return counts

    def normalized(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text or SPACE in text or text[0] == " ":
            return sum(map(self.bare.__getitem__, self.segments(self.normalized(text))))
        # Single spaces: each starts a segment with the word behind it, as do line feeds and the start of lines.
        first, *lines = text.split("\n")
        total = sum(map(self.after_space.__getitem__, first.split(" ")))
        for line in lines:
            start, *words = line.split(" ")
            total += self.bare["\n"] + self.bare[start] + sum(map(self.after_space.__getitem__, words))
        return total

    def prefix_counts(self, text: str) -> list[int]:
        """Token counts of text[:0], text[:1], ..., text; the leading space mark is counted with the first character."""
        if not text:
            return [0]
        counts = [0]
        for segment in self.segments(self.normalized(text)):
            base = counts[-1]
            counts += [base + c for c in self.segment_counts(segment)[1:]]
        return [0, *counts[2:]]

    def truncated(self, text: str, budget: int) -> str:
        """The longest prefix that no shorter or equal prefix takes over ``budget`` tokens."""
        most, highest = 0, []
        for c in self.prefix_counts(text):
            most = max(most, c)
            highest.append(most)
        return text[: bisect.bisect_right(highest, budget) - 1]


def counter(model_file: str) -> PrefixCounts:
    """One per worker process and model."""
    if model_file not in _LOADED:
        _LOADED[model_file] = PrefixCounts(model_file)
    return _LOADED[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; one pass, no shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Repeated and null ids give a row
    each; other columns are not read. No rows: no rows.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(model_file)
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(counts.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, schema)
