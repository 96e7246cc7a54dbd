"""Token counts, decontamination, language-model scores and quality scores on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from auditloom.llm import ctw, decontaminate, nbsvm, token_counts
from auditloom.llm.words import SPACED, hash_words, text_buffers
from tests.llm.conftest import words

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_word_hashes(rows):
    texts = [r[1] for r in rows]
    hashes, at = hash_words(*text_buffers(pa.array(texts)), SPACED)
    seen = {}
    for text, a, b in zip(texts, at[:-1], at[1:]):
        own = (text or "").encode().lower().split()
        assert len(own) == b - a
        for w, h in zip(own, hashes[a:b]):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_token_counts(docs, library):
    got = token_counts.token_counts(docs, MODEL, 100).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(want)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_every_prefix(library):
    rng, counts = random.Random(1), token_counts.PrefixCounts(MODEL)
    for _ in range(300):
        text = "".join(rng.choice("  \n\tabcdeinthsor▁éñ😀漢,.<s>0") for _ in range(rng.randrange(40)))
        want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert counts.prefix_counts(text) == want and counts.count(text) == want[-1]
        cut = counts.truncated(text, 5)
        assert max(want[: len(cut) + 1]) <= 5 and (cut == text or want[len(cut) + 1] > 5)


def test_token_counts_empty(no_docs):
    assert token_counts.token_counts(no_docs, MODEL).collect() == []


def _letters(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.fixture(scope="module")
def benchmark(docs, rows):
    long = rows[13][1].split()
    items = [("1", " ".join(long[500:530])), ("2", " ".join(long[505:512])), ("3", None), ("4", "never seen words"), (None, " ".join(long[900:915])), ("1", "one two three"), ("5", "TWO, three!"), ("6", "")]
    return docs.sparkSession.createDataFrame(items, "item_id string, text string")


def test_decontamination(docs, benchmark):
    items = [(i, _letters(t)) for i, t in (tuple(r) for r in benchmark.collect())]
    for shard_words in (50, 1_000_000):
        for r in decontaminate.overlaps(docs, benchmark, keep=["doc_id", "text"], shard_words=shard_words).collect():
            own, hit, met = _letters(r.text), set(), set()
            for item, ws in items:
                n = min(10, len(ws))
                windows = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if n else set()
                for k in range(len(own) - n + 1):
                    if tuple(own[k : k + n]) in windows:
                        hit.update(range(k, k + n))
                        met.add(item)
            met = sorted(m for m in met if m is not None)
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(own), len(hit), len(met), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(met).encode()).hexdigest()


def test_decontamination_edges(docs, no_docs, benchmark):
    clean = decontaminate.without_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    assert decontaminate.without_contaminated(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.overlaps(no_docs, benchmark).collect() == []


def test_longest_matches(docs, benchmark, rows):
    found = decontaminate.longest_matches(docs, benchmark, least=20).where("doc_id = 10").collect()
    assert {(r.item_id, r.item_word, r.length, r.doc_word) for r in found} == {("1", k, 30 - k, 500 + k) for k in range(11)}


def test_context_trees(docs, rows):
    depth = 4
    got = ctw.scores(docs, depth, chunk_bytes=2000).collect()
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1
    streams = [(r[0], b" ".join((r[1] or "").encode().lower().split()) + b"\n") for r in rows]
    n, c = Counter(), Counter()
    for i, s in streams:
        if not held(i):
            c.update([*s.split(), None])
            padded = b"\n" * depth + s
            for k in range(depth, len(padded)):
                for b in range(8):
                    node, bit = (1 << b) | (padded[k] >> (8 - b)), (padded[k] >> (7 - b)) & 1
                    for d in range(depth + 1):
                        n[(padded[k - d : k], node, bit)] += 1
    pe, below = {}, Counter()
    for d in range(depth, -1, -1):
        for own, node in {(a, b) for a, b, _ in n if len(a) == d}:
            zeros, ones = n[(own, node, 0)], n[(own, node, 1)]
            e = pe[own, node] = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - 2 * math.lgamma(0.5)
            if d:
                below[own[1:], node] += e if d == depth else np.logaddexp(e, below[own, node]) - math.log(2)
    total, distinct = sum(c.values()), len(c)

    def score(s):
        padded, out = b"\n" * depth + s, 0.0
        for k in range(depth, len(padded)):
            for b in range(8):
                node, bit, p = (1 << b) | (padded[k] >> (8 - b)), (padded[k] >> (7 - b)) & 1, None
                for d in range(depth, -1, -1):
                    own = padded[k - d : k]
                    zeros, ones = n[(own, node, 0)], n[(own, node, 1)]
                    here = (ones + 0.5) / (zeros + ones + 1)
                    g = 1 / (1 + math.exp(min(700, below[own, node] - pe.get((own, node), 0.0))))
                    p = here if p is None else g * here + (1 - g) * p
                out += math.log10(p if bit else 1 - p)
        return out

    want = Counter()
    for i, s in streams:
        tokens = [*s.split(), None]
        base = sum(math.log10((c[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        long = len(s) > 50_000  # scored by brute force would take long; its other columns are held
        want[(i, held(i), len(tokens), sum(c[t] > 0 for t in tokens), total, round(base, 5), None if long else round(score(s), 3))] += 1
    told = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), None if r.n_tokens > 20_000 else round(r.score, 3)) for r in got)
    assert told == want


def test_context_trees_empty(no_docs, docs):
    assert ctw.scores(no_docs).collect() == []
    untrained = docs.where("crc32(cast(coalesce(cast(doc_id as string), 'null') as binary)) % 5 = 1")
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in ctw.scores(untrained).collect())


@pytest.fixture(scope="module")
def labelled(docs):
    rng = random.Random(5)
    good = [(1000 + k, " ".join(words(rng, 60)), 1) for k in range(150)]
    bad = [(2000 + k, " ".join(w + "###" if rng.random() < 0.5 else w for w in words(rng, 60)), 0) for k in range(60)]
    spark = docs.sparkSession
    labels = [(i, q) for i, _, q in good + bad] + [(1000, 1), (None, 1), (1001, None), (1002, 0)]
    return spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), {i: q for i, _, q in good + bad}


def test_quality(labelled, docs, no_docs):
    texts, labels, truth = labelled
    model = nbsvm.train(texts, labels)
    got = nbsvm.score(texts, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 20 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    scored = nbsvm.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    assert nbsvm.score(no_docs, model).collect() == []
    assert nbsvm.accepted(docs, labels).columns == docs.columns


def test_quality_without_labels(docs, labelled):
    _, labels, _ = labelled
    model = nbsvm.train(docs, labels.limit(0))
    assert {round(r.score, 9) for r in nbsvm.score(docs, model).collect()} == {0.5}


def test_quality_fit_against_plain_solvers(monkeypatch):
    """Ratios by counting; the hinge-loss optimum against plain subgradient steps on the primal."""
    monkeypatch.setattr(nbsvm, "FEATURES", 40)
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, rng.integers(3, 12))) for _ in range(60)]
    labels = np.array([int((7 in r) ^ (rng.random() < 0.2)) for r in rows])
    counts = {y: Counter(f for r, q in zip(rows, labels) if q == y for f in r.tolist()) for y in (0, 1)}
    totals = {y: sum(c.values()) + 40 * nbsvm.SMOOTHING for y, c in counts.items()}
    ratio = nbsvm._log_count_ratio(rows, labels)
    for f in range(40):
        want = math.log((counts[1][f] + nbsvm.SMOOTHING) / totals[1]) - math.log((counts[0][f] + nbsvm.SMOOTHING) / totals[0])
        assert math.isclose(ratio[f], want, abs_tol=1e-9)
    values = nbsvm._values(rows, ratio)
    x = np.zeros((60, 41))
    x[:, 40] = 1
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r] = v
    signs = np.where(labels == 1, 1.0, -1.0)
    box = nbsvm.COST * 60 / (2 * np.array([max((labels == y).sum(), 1) for y in labels]))
    cost = lambda w: 0.5 * w @ w + (box * np.maximum(0, 1 - signs * (x @ w))).sum()
    weights, bias = nbsvm._coordinate_descent(rows, values, labels, epochs=3000)
    best, w = math.inf, np.zeros(41)
    for step in range(1, 30_001):
        w = w - (w - x.T @ (box * signs * (signs * (x @ w) < 1))) / (step + 10)
        best = min(best, cost(w))
    assert cost(np.append(weights, bias)) <= best * 1.001


def test_quality_repeated_ids(labelled):
    """Rows that repeat an id count once in the fit, so the model does not change."""
    texts, labels, _ = labelled
    model, again = nbsvm.train(texts, labels), nbsvm.train(texts.union(texts).union(texts.where("doc_id = 1005")), labels)
    assert np.array_equal(model.weights, again.weights) and (model.bias, model.slope, model.shift) == (again.bias, again.slope, again.shift)
