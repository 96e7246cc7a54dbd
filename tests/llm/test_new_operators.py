"""Prefix trie, piece codec and fill-in-middle against plain Python on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from auditloom.llm import fill_middle, piece_codec, prefix_trie
from auditloom.llm.prefix_trie import SpillingQueue, forward
from tests.llm.conftest import DOCS

MODEL = public_tokenizers.path("piece_bpe_32k.model")
EMPTY = hashlib.sha256().hexdigest()


# --- prefix trie ------------------------------------------------------------------------------


def _words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def _trie(rows):
    """Nodes by plain Python: every rebuilt conversation under each of its prefixes."""
    own = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if conv is not None:
            own.setdefault(conv, []).append((role or "", text or ""))
    members = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rebuilt = (*own.get(conv - conv % 20, [])[:h], *turns[h:])
        for d in range(len(rebuilt) + 1):
            members.setdefault(rebuilt[:d], []).append((conv, d == len(rebuilt)))
    below = {node: {} for node in members}
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]][node] = None
    out = []
    for node, convs in members.items():
        childless = [n for n in below[node] if not any(len(c) == len(n) + 1 for c in below[n])]
        saved = sum((len(members[n]) - 1) * _words(n[-1][1]) for n in below[node] if n)
        ends = ",".join(map(str, sorted(c for c, last in convs if last)))
        above = min(members[node[:-1]])[0] if node else None
        children = sum(len(n) == len(node) + 1 for n in below[node])
        out.append((min(convs)[0], len(node), above, len(convs), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def _conversations(seed, n):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        if conv % 7 == 3:
            continue  # absent, also as the first of a group
        hot = rng.random() < 0.4
        for turn in range(rng.randint(1, 6)):
            said = f"hot turn {turn}" if hot and turn < 4 else rng.choice(["yes  please", "no", None, "", "a b c d"])
            rows.append((conv, None if rng.random() < 0.02 else turn, rng.choice(["user", None]) if turn > 4 else "user", said))
    return [r for k, r in enumerate(rows) if not any(q[:2] == r[:2] for q in rows[:k] if r[1] is None)]


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, k1 string, n_convs long"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None) for r in rows], CONVERSATIONS).repartition(3)


@pytest.mark.parametrize("limits", [{}, {"limit": 3, "band_levels": 4}, {"limit": 1, "band_levels": 5}, {"limit": 10**6, "band_levels": 3}])
def test_prefix_trie(spark, docs, limits):
    rows = _conversations(2, 90)
    rows += [(95, t, "user", f"{t} of many") for t in range(12)] + [(96, t, "user", f"{t} of many") for t in range(12)]
    rows += [(97, 0, "a", "bc"), (98, 0, "ab", "c"), (None, 0, "user", "of nobody"), (200, 0, "user", "alone"), (201, 5, None, None)]
    got = Counter(map(tuple, prefix_trie.prefix_trie(_table(spark, rows), **limits).collect()))
    assert got == _trie(rows)


def test_prefix_trie_ties(spark, docs):
    """Equal turns and repeated rows: all stay, in an order that does not hang on partitions."""
    turns = [(0, "b"), (0, "a"), (0, "a"), (None, "z")]
    rows = [(20, n, "user", t) for n, t in turns] + [(40, n, "user", t) for n, t in turns[::-1]]
    first = Counter(map(tuple, prefix_trie.prefix_trie(_table(spark, rows)).collect()))
    assert first == Counter(map(tuple, prefix_trie.prefix_trie(_table(spark, rows[::-1]).coalesce(1)).collect()))
    assert sorted((c[1], c[3]) for c in first) == [(d, 2) for d in range(5)]


def test_prefix_trie_small(spark, docs):
    assert prefix_trie.prefix_trie(_table(spark, []).where("false")).collect() == []
    turnless = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4)  # its first turn goes, and 40 is absent
    got = prefix_trie.prefix_trie(_table(spark, [(turnless, 0, "user", "gone")])).collect()
    assert [tuple(r) for r in got] == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_spilling_queue():
    rng, queue = random.Random(4), SpillingQueue(rows=5)
    waiting = []
    for _ in range(3000):
        if rng.random() < 0.55 or not waiting:
            message = (rng.randrange(-50, 50), rng.randrange(-(2**63), 2**63), rng.randrange(3), rng.randrange(9), rng.randrange(9))
            queue.push(message)
            waiting.append(message)
        else:
            assert queue.first() == min(waiting)
            waiting.remove(queue.pop())
    while waiting:
        waiting.remove(queue.pop())
        assert queue.first() == (min(waiting) if waiting else None)


def test_forward_spills():
    """A full binary tree in small batches through a queue of four messages."""
    import pyarrow as pa

    names = ["depth", "k1", "k2", "p1", "p2", "exits", "own", "n_children", "n_leaves", "saved_tokens"]
    nodes = [(d, k, 0, k // 2, 0, d == 0, 1, 0, 0, 0) for d in range(9, -1, -1) for k in range(2**d)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*nodes[i : i + 50])], names) for i in range(0, len(nodes), 50)]
    out = [r for b in forward(iter(batches), rows=4) for r in b.to_pylist()]
    assert len(out) == len(nodes)
    for r in out:
        assert r["n_leaves"] == 2 ** (9 - r["depth"]) and r["saved_tokens"] == 2 ** (10 - r["depth"]) - 1 and r["n_children"] == 2 * (r["depth"] < 9)
    with pytest.raises(RuntimeError):
        list(forward(iter([batches[0].slice(0, 1)])))


# --- piece codec ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_on_documents(docs, no_docs, library):
    encoded = piece_codec.encode(docs, MODEL)
    got = piece_codec.decode(encoded, MODEL).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, tuple(ids), library.decode(ids)))
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in got) == Counter(want)
    assert piece_codec.decode(piece_codec.encode(no_docs, MODEL), MODEL).collect() == []


def test_codec_strings(library):
    rng, codec = random.Random(1), piece_codec.PieceCodec(MODEL)
    texts = ["", " ", "▁", "▁▁ a", "<s>", "<unk><0x41>", "\x00", "a" * 5000, "😀" * 500, "ab" * 700, "\n\n \n", "x" + " " * 300 + "y"]
    texts += ["".join(rng.choice("  \n\tabcdeinthsor▁éñ😀漢,.<s>0\x00한") for _ in range(rng.randrange(60))) for _ in range(1500)]
    for text in texts:
        ids = np.frombuffer(codec.encode(text), np.int32).tolist()
        assert ids == library.encode(text), text
        assert codec.decode(ids) == library.decode(ids) == text.replace("▁", " ")


def test_decode_any_ids(library):
    """Ids that no encoding gives: special ids, broken byte runs, a space first."""
    rng, codec, n = random.Random(2), piece_codec.PieceCodec(MODEL), library.get_piece_size()
    space = library.piece_to_id("▁")
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(n), rng.randrange(3, 259), rng.randrange(3), space]) for _ in range(rng.randrange(8))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_decode_null_ids(spark, docs):
    ids = spark.createDataFrame([(1, None), (2, []), (None, [450])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in piece_codec.decode(ids, MODEL).collect()}.keys() == {1, 2, None}
    assert {r.text for r in piece_codec.decode(ids, MODEL).where("doc_id in (1, 2)").collect()} == {""}


def test_backtracking():
    """Pieces chosen so that the longest match first is wrong: the search goes back and marks the place."""
    codec = piece_codec.PieceCodec(MODEL)
    codec.score = {"ab": -1.0, "cd": -2.0, "bc": -3.0, "abc": -4.0}
    codec.id = dict(zip([*codec.score, "a", "b", "c", "d"], range(8)))
    codec.apart.clear()
    codec.shorter.clear()
    codec.longest_matches = lambda text: [max([1, *(len(p) for p in codec.id if text.startswith(p, k))]) for k in range(len(text))]
    assert codec.tokens("abcd") == ["ab", "cd"] and codec.tokens("abc") == ["abc"] and codec.tokens("abcabcd") == ["abc", "ab", "cd"]


# --- fill in the middle --------------------------------------------------------------------------------


def _fim(doc_id, text, seed=7, cut=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def line_docs(docs):
    rng = random.Random(9)
    texts = ["\n", "\n\n\n", "a", "a\n", "😀\né\r\n\x0b x\nß", "has <P> in it\nx", "<S\n><M\nP>", "é" * 5000 + "\n" + "x\n" * 3000 + "y" * 40_000]
    texts += ["".join(rng.choice(["\n", "<", "S", ">", "é", "😀 word ", "<P", "M>"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    more = docs.sparkSession.createDataFrame([(100 + k, t, None, None, None, 1, "s") for k, t in enumerate(texts)], DOCS)
    return docs.unionByName(more)


@pytest.mark.parametrize("options", [{}, {"seed": 8, "cut_percent": 60, "spm_percent": 10, "error": 0}, {"error": 3}])
def test_fill_in_middle(line_docs, options):
    got = fill_middle.fill_in_middle(line_docs, **options)
    names = {"cut_percent": "cut", "spm_percent": "spm"}
    plain = {names.get(k, k): v for k, v in options.items() if k != "error"}
    want = [_fim(r.doc_id, r.text, **plain) for r in line_docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    back = got.select("doc_id", fill_middle.restore(got["output"], got["form"]).alias("text"))
    assert Counter(map(tuple, back.collect())) == Counter((r.doc_id, r.text or "") for r in line_docs.select("doc_id", "text").collect())


def test_cuts_of_stored_index(line_docs, no_docs):
    """Other draws over the index alone; every end of every text is found exactly."""
    index = fill_middle.line_index(line_docs.where("doc_id is not null")).cache()
    cut = fill_middle.fill_in_middle(line_docs.where("doc_id is not null"), seed=11).where("form <> 'plain'").select("doc_id", "prefix_chars", "middle_chars")
    assert not set(map(tuple, cut.collect())) - set(map(tuple, fill_middle.cuts(index, 11).collect()))
    ends = {r.text: fill_middle.line_ends(r.text or "").tolist() for r in line_docs.collect()}
    for text in ends:
        stored = fill_middle.RankIndex.fit(fill_middle.line_ends(text or ""))
        assert [stored.offset(k) for k in range(len(stored) + 1)] == ends[text]
    assert fill_middle.line_index(no_docs).collect() == [] and fill_middle.fill_in_middle(no_docs).collect() == []


def test_segments_are_few():
    even = fill_middle.RankIndex.fit(np.arange(0, 10_000_000, 37))
    assert len(even.ranks) == 1
    rng = np.random.default_rng(1)
    ragged = fill_middle.RankIndex.fit(np.cumsum(rng.integers(1, 90, 200_000)))
    assert len(ragged.ranks) < 20_000 and len(ragged.residuals) == 200_000
    for error in (-1, 127):
        with pytest.raises(ValueError):
            fill_middle.RankIndex.fit(np.arange(3), error)
