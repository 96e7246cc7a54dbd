"""Line dedup, sharding and mixing on awkward rows, against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

from auditloom.llm import line_dedup, mixing, shard


def _places(rows):
    out, place = {}, 0
    for k, r in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        lines = r[1].split("\n") if r[1] else []
        for i, line in enumerate(lines):
            out[place + i] = (k, line)
        place += len(lines) + 1
    return out


def test_line_dedup_counts(docs, rows):
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.line_report(docs).collect()}
    assert docs.count() == len(line_dedup.line_report(docs).collect())
    assert got[(1, 0)].n_deleted == 0 and got[(2, 0)].longest_run == 0
    assert got[(8, 10)].n_deleted == 8 and got[(8, 10)].longest_run == 8
    assert got[(7, 8)].n_deleted == 0
    # Twelve equal lines: the run of eleven that begins second overlaps the first.
    assert got[(11, 12)].n_deleted == 11 and got[(11, 12)].longest_run == 11


def test_line_dedup_texts(docs):
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    texts = {r.doc_id: r.text for r in kept.where("doc_id in (8, 11, 2, 1)").collect()}
    assert texts == {8: "start\nend", 11: "again", 2: "", 1: None}


def test_line_dedup_equal_rows(docs):
    """One of several rows equal in id and text keeps its lines; a later text equal in part loses that part."""
    make = lambda rows: docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    told = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    twice = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc")]
    assert told(line_dedup.without_repeated_lines(make(twice))) == [(1, ""), (1, "a\nb\nc"), (2, "x")]
    part = [(1, "a\nb\nc"), (2, "a\nb\nc\nd")] + [(2, "a\nb\nc\nd")] * 2 + [(None, "p\nq\nr")] * 2
    want = [(1, "a\nb\nc"), (2, ""), (2, ""), (2, "d"), (None, ""), (None, "p\nq\nr")]
    assert told(line_dedup.without_repeated_lines(make(part), 3)) == sorted(want, key=repr)


def test_line_dedup_short_runs(docs):
    """A repeated run of one or two lines, or a whole short text, goes too."""
    rows = docs.sparkSession.createDataFrame([(1, "a\nb"), (2, "a\nb"), (3, "x\nb\ny")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_repeated_lines(rows).collect()} == {1: "a\nb", 2: "", 3: "x\ny"}


def test_line_dedup_blank_lines(docs):
    """Blank lines alone are no repetition; they go with the line of words above, or below where none is above."""
    texts = ["x\n\ny\n\nz", "a\n\nb\n \n", "\n\na\n\nb", "p\n\na\n\n\nb\n\nq", "\n \n", "\n\n", "n\n\na", "\n\na\n\nn2"]
    rows = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(rows).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: "", 3: "p\n\nq", 4: texts[4], 5: texts[5], 6: "n\n", 7: "n2"}
    # A run goes on over blank lines.
    longest = {r.doc_id: r.longest_run for r in line_dedup.line_dedup(rows).collect()}
    assert longest == {0: 0, 1: 2, 2: 2, 3: 2, 4: 0, 5: 0, 6: 1, 7: 1}


def test_line_dedup_brute_force(docs):
    """Random texts of few lines, with blank lines, nulls and an outlying id: counts, longest runs and kept texts."""
    rng = random.Random(11)
    rows = [(i * 3, "\n".join(rng.choice(["", " ", *"abcdefghijklmnop"]) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    rows += [(500, None), (501, ""), (1 << 60, rows[4][1])]
    held = [(i, line) for i, line in sorted(_places([(d, "\n".join(x for x in (t or "").split("\n") if x.strip())) for d, t in rows]).items())]
    at = {place: line for place, (_, line) in held}
    run = defaultdict(int)
    for p in at:
        for q in at:
            n = 0
            while p != q and p + n in at and at.get(q + n) == at[p + n]:
                n += 1
            run[p] = max(run[p], n)
    for floor in (1, 3):
        seen, deleted = set(), set()
        for p in sorted(at):
            window = tuple(at.get(p + k) for k in range(floor))
            if None not in window:
                deleted |= set(range(p, p + floor)) if window in seen else set()
                seen.add(window)
        want, places = {}, defaultdict(list)
        for place, (k, _) in held:
            places[k].append(place)
        for k, (d, t) in enumerate(rows):
            lines, own, kept = t.split("\n") if t else [], iter(places[k]), []
            goes = bool(places[k]) and places[k][0] in deleted
            for line in lines:
                goes = next(own) in deleted if line.strip() else goes
                kept += [] if goes else [line]
            digest = None if t is None else hashlib.sha256("\n".join(kept).encode()).hexdigest()
            want[d] = (len(lines), len(deleted & set(places[k])), max([run[p] for p in places[k]], default=0), digest)
        table = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r.doc_id: (r.n_lines, r.n_deleted, r.longest_run, r.kept_sha256) for r in line_dedup.line_dedup(table, floor).collect()}
        assert got == want


def test_line_dedup_empty(no_docs):
    assert line_dedup.line_report(no_docs).collect() == []
    assert line_dedup.line_dedup(no_docs).collect() == []


def test_sharding(docs, rows):
    got = shard.interleave(docs, shards=7).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
        assert r["size"] == (len(r.text.encode()) if r.text is not None else 0) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mixture = Counter((r["shard"], r.source) for r in got)
    for source, n in Counter(r[3] for r in rows).items():
        assert all(abs(mixture[(s, source)] - n / 7) < 2 for s in range(7))


def test_sharding_is_stable(docs, no_docs):
    again = docs.repartition(5)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text_crc32, r["shard"], r.slot)
    assert sorted(map(key, shard.interleave(docs).collect())) == sorted(map(key, shard.interleave(again).collect()))
    assert shard.interleave(no_docs).collect() == []


def test_write_shards(docs, tmp_path):
    shard.write_shards(shard.interleave(docs, shards=3).drop("lang"), str(tmp_path / "out"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()


def test_mixing(docs, rows):
    got = mixing.mix(docs, block_words=16).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r["size"] == len((r.text or "").encode().split())
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (3, 1, 2, 3)))
    want, left, open_ = {}, 1.5 * sum(size.values()), set(size)
    while True:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
        open_ -= over
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and taken[s] == int(target[s])


def test_schedule_is_mixed(docs):
    """Any stretch of the schedule holds sources in proportion, up to a few slots."""
    sized = docs.selectExpr("coalesce(source, '~') as __source", "length(coalesce(text, '')) as size")
    slots = sorted(mixing.schedule(docs.sparkSession, mixing.targets(sized), 64).collect(), key=lambda r: r.slot)
    total = Counter(r["__source"] for r in slots)
    half = Counter(r["__source"] for r in slots[: len(slots) // 2])
    assert len(slots) > 100
    assert all(abs(half[s] - n / 2) <= 12 for s, n in total.items())


def test_mixing_edges(docs, no_docs):
    assert mixing.mix(no_docs).collect() == []
    wordless = docs.where("text is null or trim(text) = ''")
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(wordless).collect())
    mixed = mixing.mixed_documents(docs, block_words=16)
    assert mixed.columns == docs.columns and {r["size"] for r in mixed.collect()} == {7}
