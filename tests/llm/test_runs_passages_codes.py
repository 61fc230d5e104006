"""Periodic runs, repeated passages and vector codes against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import substring_dedup
from riskweave.llm.periodic_runs import collapse_runs, lag_runs, planted
from riskweave.llm.substring_dedup import remove_repeats
from riskweave.llm.vector_codes import compress_vectors, nearest, root, root_up

SCHEMA = "doc_id long, text string, id long, runs string, path string, rev int, start int, words string"


def documents(spark, rows):
    """With columns whose names clash with those inside."""
    return spark.createDataFrame([(d, t, 7, "r", "p", 1, 2, "w") for d, t in rows], SCHEMA)


def brute_runs(words, min_words=12, min_exponent=2):
    """By the definition: stretches by smallest period that no neighbour extends."""
    n, out = len(words), set()
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_words, min_exponent * q):
                stretch = words[i : i + length]
                if all(any(stretch[k] != stretch[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts_with_runs(rng):
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a " * 11), (4, "a " * 12), (5, "a b " * 6), (6, "a b " * 5), (None, "x y z " * 9), (7, "x " * 300), (7, "x " * 300), (7, "y x " * 200)]
    for d in range(60):
        words = [rng.choice("abc"[: rng.choice((1, 2, 3))]) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            q, at = rng.randrange(1, 9), rng.randrange(len(words) + 1)
            words[at:at] = [f"w{rng.randrange(50)}" for _ in range(q)] * rng.randrange(2, 7)
        rows.append((100 + d, " ".join(words)))
    return rows


@pytest.mark.parametrize("long_bytes", [32_768, 60])
def test_periodic_runs_equal_brute_force(spark, long_bytes):
    rows = texts_with_runs(random.Random(3))
    got = collapse_runs(documents(spark, rows), long_bytes=long_bytes).collect()
    want = []
    for d, t in rows:
        words = (t or "").split()
        runs = brute_runs(words)
        want.append((d, len(words), tuple(runs), brute_collapse(words, runs)))
    assert sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got), key=repr) == sorted(want, key=repr)


def test_periodic_runs_of_very_long_and_odd_texts(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    words = [f"v{i}" for i in range(4000)] + base * 3 + base[:17] + ["end"]
    got = collapse_runs(documents(spark, [(1, " ".join(words)), (1, " ".join(words)), (2, "w" * 100_000)]), long_bytes=4096).collect()
    assert sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got) == [(1, 6118, [(4000, 2117, 700)])] * 2 + [(2, 1, [])]
    assert collapse_runs(documents(spark, [])).collect() == []


def test_periodic_runs_with_other_bounds_and_separators():
    ids = np.array([0, 1, 2] * 5 + [3] * 4)
    assert lag_runs(ids, 1, 99, min_words=4, min_exponent=3) == [(15, 4, 1), (0, 15, 3)]
    assert lag_runs(ids, 2, 3, min_words=4) == [(0, 15, 3)]
    assert planted(None, 5) is None and planted(4, 0) is None
    order = planted(next(d for d in range(100) if planted(d, 50) is not None), 50)
    assert len(order) == 50 and order.max() < 50


def brute_removed(rows, window):
    seen = {}
    for d, t in rows:
        if d is not None:
            w = (t or "").split()
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                seen[g] = min(d, seen.get(g, d))
    out = []
    for d, t in rows:
        w = (t or "").split()
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if seen[tuple(w[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passages(rng, repeated_ids):
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    shared = [words(n) for n in (13, 14, 20, 40, 90)]
    hot = words(30)
    rows = [(0, None), (1, ""), (2, "one two"), (3, " ".join(words(13))), (None, " ".join(hot)), (-5, " ".join(["a"] * 40)), (10**12, " ".join(["a"] * 30))]
    for d in range(60):
        w = words(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            at, s = rng.randrange(len(w) + 1), list(rng.choice(shared))
            if rng.random() < 0.4:
                s[rng.randrange(len(s))] = "changed"
            w[at:at] = s[rng.randrange(3) :]
        if d % 3 == 0:
            w += hot
        rows.append((100 + d, " ".join(w)))
    rows += [(500 + d, rows[10][1]) for d in range(40)]
    if repeated_ids:
        rows += [(100, rows[20][1]), (100, rows[7][1]), (100, rows[7][1]), (3, " ".join(words(50) + shared[4]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("repeated_ids", [False, True])
@pytest.mark.parametrize(("window", "anchor", "batch"), [(13, 4, 100_000), (13, 4, 20), (5, 2, 50)])
def test_repeats_equal_brute_force(spark, monkeypatch, repeated_ids, window, anchor, batch):
    monkeypatch.setattr(substring_dedup, "BATCH", batch)
    rows = passages(random.Random(window + repeated_ids), repeated_ids)
    got = remove_repeats(documents(spark, rows).repartition(3), window=window, anchor=anchor).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == sorted(brute_removed(rows, window), key=repr)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in got)
    text = {d: (t or "").split() for d, t in rows}
    if not repeated_ids:  # each span stands at its source
        for r in got:
            for s in r.spans:
                assert text[r.doc_id][s.start : s.start + s.n_words] == text[s.source_id][s.source_start : s.source_start + s.n_words] and s.source_id < r.doc_id


def test_repeats_of_long_texts_and_none(spark):
    rng = random.Random(2)
    w = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    rows = [(1, " ".join(w)), (2, " ".join(["x", *w[5000:29_000], "y"]))]
    got = {r.doc_id: r for r in remove_repeats(documents(spark, rows)).collect()}
    assert got[1].n_removed == 0 and (got[2].n_removed, got[2].kept) == (24_000, "x y")
    assert [tuple(s) for s in got[2].spans] == [(1, 24_000, 1, 5000)]
    assert remove_repeats(documents(spark, [])).collect() == []


def test_hashes_that_collide_are_found_out(spark, monkeypatch):
    """Where all stretches of one length count as equal in the first round, paths differ from their sources, and another round follows."""
    edges, disagree, seen = substring_dedup.edge_paths, substring_dedup._disagree, []

    def alike(once, *, seed, **bounds):
        out = edges(once, seed=seed, **bounds)
        return out if seed else out.withColumns({"anchor": F.lit(1).cast("long"), "path": F.col("n").cast("long")})

    monkeypatch.setattr(substring_dedup, "edge_paths", alike)
    monkeypatch.setattr(substring_dedup, "_disagree", lambda out: seen.append(disagree(out)) or seen[-1])
    rows = [(d, " ".join(f"w{random.Random(d * 100 + i).randrange(50)}" for i in range(60))) for d in range(30)] + [(99, " ".join(["same"] * 9)), (98, " ".join(["same"] * 7))]
    got = remove_repeats(documents(spark, rows), window=5, anchor=2).collect()
    assert seen == [True, False]
    assert sorted((r.doc_id, r.n_removed) for r in got) == sorted((d, n) for d, _, n, _ in brute_removed(rows, 5))


def brute_codes(rows, parts, entries, rounds):
    """Lloyd's rounds with all distances, in whole Python numbers."""
    good = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((i, v) for i, v in good if i is not None)
    size = len(named[0][1])
    good = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v in good if len(v) == size]
    starts, seen = [], set()
    for i, v in named:
        if i not in seen and len(v) == size and len(starts) < entries:
            seen.add(i)
            starts.append([math.floor(4096 * float(np.float32(x))) for x in v])
    w = size // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(s)[p] for s in starts] for p in range(parts)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min((d2(cut(v)[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        met = [assign(v) for v in good]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v)[p] for v, a in zip(good, met, strict=True) if a[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return books, sorted((tuple(a[1] for a in assign(v)), sum(a[0] for a in assign(v))) for v in good)


VECTORS = "vec_id long, embedding array<float>, label int, q string, codes string, part int, error string"


@pytest.mark.parametrize("entries", [16, 3])
def test_vector_codes_equal_brute_force(spark, entries):
    rng = random.Random(entries)
    rows = [(i, [rng.choice((-1, 0, 1)) * rng.random() for _ in range(12)], i % 3) for i in range(60)]
    rows += [(i, [0.25 * rng.randrange(-2, 3) for _ in range(12)], None) for i in range(60, 160)]  # many ties
    rows += [(200 + i, [0.5] * 12, 1) for i in range(50)] + [(7, [0.1] * 12, 1), (0, [-0.9] * 12, 0), (None, [0.3] * 12, 2)]
    rows += [(-3, None, 1), (-2, [float("nan")] * 12, 1), (-4, [None] * 12, 1), (-5, [float("inf")] + [0.0] * 11, 1), (300, [0.1] * 8, 1), (301, [], 1)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, v, k, "x", "y", 1, "z") for i, v, k in rows], VECTORS).repartition(3)
    coded, books, compared = compress_vectors(frame, keep=("label",), parts=4, entries=entries)
    want_books, want = brute_codes(rows, 4, entries, 6)
    assert books.tolist() == want_books
    assert sorted((tuple(r.codes), r.error) for r in coded.collect()) == want
    n = len(want)
    assert compared[0] == n * 4 * entries and sum(compared[1:]) < 5 * n * 4 * entries


def test_vector_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    coded, books, _ = compress_vectors(empty)
    assert coded.collect() == [] and books.size == 0
    huge = spark.createDataFrame([(1, [3e38] * 8, 1, "x", "y", 1, "z"), (2, [-3e38] * 8, 1, "x", "y", 1, "z"), (3, [0.0] * 8, 1, "x", "y", 1, "z")], VECTORS)
    coded, books, _ = compress_vectors(huge, parts=2)
    assert sorted((r.vec_id, list(r.codes), r.error) for r in coded.collect()) == [(1, [0, 0], 0), (2, [1, 1], 0), (3, [2, 2], 0)]
    with pytest.raises(ValueError, match="parts"):
        compress_vectors(huge, parts=3)


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(5)
    q = rng.integers(-60, 60, (500, 3))
    book = q[:9].copy()
    state, moved = (None, None, None), np.zeros(9, np.int64)
    for _ in range(8):
        *state, _ = nearest(q, book, *state, moved)
        squares = ((q[:, None] - book[None]) ** 2).sum(-1)
        assert (state[0] == squares.argmin(1)).all()
        assert (state[1] ** 2 >= squares.min(1)).all() and (state[2] ** 2 <= squares).all()
        new = np.array([q[state[0] == e].sum(0) // max(1, (state[0] == e).sum()) if (state[0] == e).any() else book[e] for e in range(9)])
        moved, book = root_up(((new - book) ** 2).sum(-1)), new
    big = np.array([0, 1, 2, 3, 4, 2**60, 2**60 - 1, (2**30 - 1) ** 2])
    assert root(big).tolist() == [math.isqrt(int(x)) for x in big] and root_up(big).tolist() == [math.isqrt(int(x)) + (math.isqrt(int(x)) ** 2 < int(x)) for x in big]
