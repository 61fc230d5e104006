"""The operators that run in Arrow batches against brute force and held-out labels."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskweave.llm.minhash import near_duplicates
from riskweave.llm.pu_quality import fit_nnpu, score_quality
from riskweave.llm.quality_rules import base_failure, fences, judge_quality, measure, sketch_measures
from riskweave.llm.suffix_dedup import repeated_passages
from riskweave.llm.toxicity import CharModel, TokenReader, disguised, read_token, readings, restore, score_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, words string, n int, key string"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", "w", 1, "k") for d, t in rows], SCHEMA)


def prose(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def brute_components(rows, k, percent=80):
    sets, names = [], []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
        names.append(d)
    parent = {d: d for d in names if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (names[i], names[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(names[i]), find(names[j])))
                parent[b] = a
    return [(d, len(s), find(d) if d is not None else None) for d, s in zip(names, sets, strict=True)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(k)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Two words"), (4, "two WORDS"), (5, "two words more"), (None, "two words")]
    for g in range(12):
        base = prose(rng, rng.choice((30, 80, 300))).split()
        for _ in range(rng.choice((1, 4, 12))):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 40))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) + 100, " ".join(w)))
        rows.append((len(rows) + 100, " ".join(base)))
    # A chain whose ends aren't alike, and a large group around one text, a part of it too far from it.
    chain = prose(rng, 200).split()
    for i in range(8):
        rows.append((2000 + i, " ".join(chain[i * 8 : i * 8 + 120])))
    hub = prose(rng, 100).split()
    for i in range(80):
        w = list(hub)
        for p in rng.sample(range(100), rng.choice((0, 1, 2, 3, 4, 5, 6))):
            w[p] = f"h{i}-{p}"
        rows.append((3000 + i, " ".join(w)))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, rows).repartition(5), k=k).collect()]
    assert sorted(got, key=repr) == sorted(brute_components(rows, k), key=repr)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(documents(spark, [(1, "a")]).where("false")).count() == 0
    same = near_duplicates(documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in same) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_repeated_passages(spark):
    rng = random.Random(5)
    passage, short = prose(rng, 70, 10**6), prose(rng, 45, 10**6)
    rows = [(i, f"{prose(rng, rng.randrange(0, 150), 10**6)} {passage if i % 3 == 0 else short if i % 3 == 1 else ''} {prose(rng, rng.randrange(60, 150), 10**6)}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a b"), (None, passage), (103, rows[2][1]), (103, rows[2][1]), (104, rows[2][1].upper())]
    got = repeated_passages(documents(spark, rows).repartition(7)).collect()
    found = {r.doc_id for r in got}
    assert found == {i for i in range(60) if i % 3 == 0} | {2, 103, 104}
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id).lower().split()
        if r.doc_id % 3 == 0 and r.doc_id < 100:
            assert " ".join(text[r.first_word : r.last_word + 1]) == passage
        elif r.doc_id in (2, 104):
            assert r.n_words == len(text)
        assert r.first_copy == (r.partner_id > r.doc_id)
    assert repeated_passages(documents(spark, rows).where("false")).count() == 0


def brute_repeats(rows, n):
    """Words of each document that lie in a passage of n words which stands in another document too."""
    words = {d: (t or "").lower().split() for d, t in rows if d is not None}
    where = {}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            where.setdefault(" ".join(w[i : i + n]), set()).add(d)
    return {d: hit for d, w in words.items() if (hit := {i + j for i in range(len(w) - n + 1) if len(where[" ".join(w[i : i + n])]) > 1 for j in range(n)})}


def test_repeated_passages_against_brute_force(spark):
    """Copies that reach differently far, variants that share their openings, one passage in most documents, repeats inside a document."""
    rng = random.Random(15)
    fresh = lambda n: prose(rng, n, 10**6).split()
    long, opening, hot = fresh(900), fresh(40), fresh(60)
    variants = [fresh(30) for _ in range(6)]
    rows = []
    for i in range(120):
        w = fresh(rng.randrange(20, 80))
        if i % 2:
            w += hot + fresh(rng.randrange(1, 9))
        if i % 5 == 0:
            a = rng.randrange(0, 500)
            w += long[a : a + rng.randrange(40, 400)] + fresh(3)
        if i % 4 == 0:
            w += opening + variants[i % 6] + fresh(5)
        if i % 11 == 0:
            w += hot + fresh(2) + hot
        rows.append((i, " ".join(w + fresh(rng.randrange(0, 60)))))
    rows += [(200, " ".join(fresh(10) + long + fresh(10))), (201, " ".join(long)), (202, rows[7][1])]
    want = brute_repeats(rows, 51)
    got = {}
    for r in repeated_passages(documents(spark, rows).repartition(9)).collect():
        assert r.n_words == r.last_word - r.first_word + 1
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word + 1))
    assert set(got) == set(want) and all(got[d] <= want[d] for d in got)
    assert sum(map(len, got.values())) >= 0.99 * sum(map(len, want.values()))


def test_quality_rules(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 80)) for i in range(150)] + [(500, prose(rng, 60).replace("w", "w#$#")), (501, "same three words " * 40), (502, None), (503, ""), (504, "\n".join([prose(rng, 70), "dup line", "dup line", " ", " "])), (505, "é\x85ü\xa0ñ a\tb"), (None, prose(rng, 90)), (0, prose(rng, 80))]
    got = judge_quality(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    out = {r.doc_id: r for r in got}
    for d, t in rows:
        if d in (0, None):
            continue
        w = (t or "").encode().split()
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        r = out[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert out[504].n_dup_lines == 1 and not out[500].kept and not out[500].base_failed and not out[501].kept and all(out[i].kept for i in range(1, 150))
    assert judge_quality(documents(spark, rows).where("false")).count() == 0


def test_fences_follow_their_group(spark):
    rng = random.Random(4)
    shout = lambda n, share: " ".join(x.upper() if rng.random() < share else x for x in prose(rng, n).replace("w", "word").split())
    rows = [(i, shout(100, 0.02), "en", "calm") for i in range(200)] + [(1000 + i, shout(100, rng.uniform(0.3, 0.5)), "en", "loud") for i in range(200)]
    rows += [(5000, shout(100, 0.45), "en", "calm"), (5001, shout(100, 0.45), "en", "loud"), (5002, shout(100, 1.0), "en", "loud"), (5003, shout(100, 0.02), None, None), (5004, shout(100, 1.0), "xx", "tiny")]
    docs = spark.createDataFrame([(*x, 1, 2.0, "m") for x in rows], "doc_id long, text string, lang string, source string, n_words int, q25_word_length double, measure string")
    kept = {r.doc_id: r.kept for r in judge_quality(docs).collect()}
    assert not kept[5000] and kept[5001] and not kept[5002] and kept[5003]
    assert sum(kept[i] for i in range(200)) >= 198 and sum(kept[1000 + i] for i in range(200)) >= 198
    both = fences(sketch_measures(measure(docs).where(~base_failure()))).where("f_source in ('calm', 'loud')").collect()
    assert len({r.q75_upper_share for r in both}) == 2
    # A group too small for quartiles of its own is judged by all texts together: here as loud as the loud half.
    assert fences(sketch_measures(measure(docs).where("false"))).count() == 0


@pytest.mark.parametrize("few", [5, 99, 100, 101])
def test_verdicts_do_not_turn_at_a_number_of_rows(spark, few):
    """A second source with longer words is kept whether it has a few texts or a hundred; junk in it isn't."""
    rng = random.Random(few)
    rows = [(i, " ".join(f"{rng.randrange(10**4, 10**5)}" for _ in range(80)), "en", "short") for i in range(600)]
    rows += [(1000 + i, " ".join(f"{rng.randrange(10**11, 10**12)}" for _ in range(80)), "en", "long") for i in range(few)] + [(5000, " ".join("x" * 90 + str(i) for i in range(80)), "en", "long")]
    kept = {r.doc_id: r.kept for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(kept[1000 + i] for i in range(few)) >= few - (few < 50) * few and sum(kept[i] for i in range(600)) >= 590 and not kept[5000]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_pu_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    good = [(i, " ".join(f"{rng.choice('abcdefgh')}{'x' * rng.randrange(1, 8)}{rng.randrange(99)}" for _ in range(80)) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(f"{rng.choice('ABC')}{rng.choice('$#')}!!" for _ in range(60))) for i in range(60)]
    rows = good + bad + [(5000, None), (5001, ""), (None, "a b c"), (0, good[0][1])]
    labels = labelled(spark, [(d, int(d < 1000), 0) for d, _ in good + bad if d % 3] + [(None, 1, 0), (7777, None, None)])
    got = score_quality(documents(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            if r.doc_id < 1100:
                assert r.predicted == int(r.doc_id < 1000)
    none = score_quality(documents(spark, rows), labels.where("false")).collect()
    assert len({r.score for r in none}) == 1
    assert score_quality(documents(spark, rows).where("false"), labels).count() == 0


def test_risk_is_not_negative():
    import numpy as np

    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1.5, 1, (200, 16)), rng.normal(-1.5, 1, (200, 16))
    model = fit_nnpu(pos, np.concatenate((rng.normal(1.5, 1, (200, 16)), neg)), 0.5, steps=300)
    score = lambda x: np.tanh(np.clip((x - model["mean"]) / np.array(model["scale"]), -6, 6) @ np.array(model["w1"]) + model["b1"]) @ np.array(model["w2"]) + model["b2"][0]
    assert (score(pos) > 0).mean() > 0.9 and (score(neg) < 0).mean() > 0.9


def test_restoring():
    counts: Counter = Counter()
    for w, n in (("idiot", 50), ("stupid", 50), ("trash", 40), ("moron", 40), ("lamp", 200), ("line", 200), ("the", 900), ("worthless", 30)):
        for i in range(len(w) + 1):
            counts[f"^^{w}^"[i : i + 3]] += n
    model = CharModel(sorted(counts.items()))
    for token, word in (("1d10t", "idiot"), ("i_d_i_o_t", "idiot"), ("stuuupid", "stupid"), ("tr@sh", "trash"), ("m0r0n", "moron"), ("w0rthle$$", "worthless")):
        assert disguised(token) and restore(token, model) == word
    for token, word in (("іdіоt", "idiot"), ("ｓtupid", "stupid"), ("ŧ1d10t", "ŧidiot")):
        assert disguised(token) and restore(token, model) == word
    assert not disguised("plain") and not disguised("2024") and not disguised("привет") and not disguised("größe")


def test_reading_long_marked_and_spaced_tokens():
    counts: Counter = Counter()
    for w, n in (("idiot", 50), ("stupid", 50), ("you", 400), ("are", 400), ("a", 300), ("lamp", 200), ("the", 900), ("such", 100)):
        for i in range(len(w) + 1):
            counts[f"^^{w}^"[i : i + 3]] += n
    model = CharModel(sorted(counts.items()))
    for text, word in (
        ("st" + "u" * 60 + "pid", "stupid"), ("1d10t!!", "idiot"), ("y o u i d i o t", "idiot"), ("y o u  i  d  i  o  t", "idiot"), ("well, y o u a r e s u c h a s t u p i d l a m p now", "stupid"), ("-".join("you" * 20) + "-1-d-1-0-t", "you" * 20 + "idiot"),
    ):
        assert word in readings(text, TokenReader(model))[0], text
    assert {"y_o_u_i_d_i_o_t", "you", "idiot"} <= set(read_token("y o u i d i o t", model).split(" "))
    assert len(restore("x1" * 20_000, model)) >= 20_000
    assert readings("plain words, 2024 !!", TokenReader(model)) == ({"plain", "words", "2024", ""}, 4)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    disguise = {"idiot": ("idiot", "1d10t", "i d i o t", "idiooot"), "moron": ("moron", "m0r0n", "m.o.r.o.n")}
    for i in range(400):
        text, bad = prose(rng, 40, 300), i % 5 == 0
        if bad:
            word = rng.choice(list(disguise))
            text += f" {disguise[word][0]} " + rng.choice(disguise[word] if i % 10 == 0 else disguise[word][:1])
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    rows += [(900, "you 1d10t here now"), (901, "such a m.o.r.o.n"), (902, "words of i d i o t kind"), (903, "clean as can be"), (904, None), (905, ""), (None, "idiot"), (906, "moron " * 3 + "x " * 50_000)]
    got = {r.doc_id: r for r in score_toxicity(documents(spark, rows), labelled(spark, labels)).collect()}
    assert len(got) == len(rows)
    for d in (900, 901, 902, 906, None):
        assert got[d].predicted == 1, d
    for d in (903, 904, 905):
        assert got[d].predicted == 0, d
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(400) if got[i].held_out)
    clean = score_toxicity(documents(spark, rows), labelled(spark, labels).where("toxic = 0"))
    assert clean.where("predicted = 1").count() == 0
    assert score_toxicity(documents(spark, rows).where("false"), labelled(spark, labels)).count() == 0
    assert clean.where(F.col("score").isNull()).count() == 0


def test_decoding_finds_what_plain_lookup_misses(spark):
    """Toxic words disguised in ways of their own, each form only once: without decoding no form recurs."""
    rng = random.Random(6)
    rows, labels, planted = [], [], {}
    swap = {"i": "1!|", "o": "0", "a": "@4", "e": "3", "s": "$5", "t": "7+"}
    for i in range(600):
        text, bad = prose(rng, 40, 300), i % 5 == 0
        word = rng.choice(("idiotic", "worthless", "pathetic"))
        if bad and i < 400:
            text += f" {word}"
        elif i % 3 == 0 and i >= 400:
            hidden = "".join(rng.choice(swap[c]) if c in swap and rng.random() < 0.7 else c for c in word)
            if hidden == word:
                hidden = word[0] + word[1] * 4 + word[2:]
            way = rng.randrange(4)
            text += " " + (hidden, " ".join(word), rng.choice("._-").join(word), hidden.replace(word[-1], word[-1] * 5))[way]
            planted[i] = way
        rows.append((i, text))
        if i < 400:
            labels.append((i, 1, int(bad)))
    run = lambda: {r.doc_id: r.predicted for r in score_toxicity(documents(spark, rows), labelled(spark, labels)).collect()}
    with_decoding = run()
    assert sum(with_decoding[i] for i in planted) >= 0.95 * len(planted)
    assert not any(with_decoding[i] for i in range(400, 600) if i not in planted)
    # Plain lookup finds no word as it stands, and less than half by their beginnings.
    words = lambda text: set(text.lower().split())
    plain = sum(bool(words(rows[i][1]) & {"idiotic", "worthless", "pathetic"}) for i in planted)
    assert plain == 0
    assert sum(any(w.startswith(x) for w in words(rows[i][1]) for x in ("idio", "wort", "path")) for i in planted) < 0.5 * len(planted)


def test_equal_texts_with_different_labels(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 30, 200) + (" awful" if i % 4 == 0 else "")) for i in range(200)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 200, 4)]
    labels += [(1000 + i, 1, 0) for i in range(0, 200, 4)]
    got = [sorted((r.doc_id, round(r.score, 9)) for r in score_toxicity(documents(spark, rows).repartition(n), labelled(spark, labels)).collect()) for n in (2, 5)]
    assert got[0] == got[1]
    score = dict(got[0])
    assert all(score[i] == score[1000 + i] and score[i] > 0.3 for i in range(0, 200, 4)) and all(score[i] < 0.3 for i in range(200) if i % 4)


def test_lexicon_does_not_hang_on_the_number_of_labels(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(7200):
        # A toxic word in 8 of 1200 toxic texts and in no clean one.
        text, bad = prose(rng, 6, 200), i < 1200
        rows.append((i, text + (" slur" if bad and i % 150 == 0 else "")))
        labels.append((i, 1, int(bad)))
    rows.append((9000, "such a slur here"))
    assert score_toxicity(documents(spark, rows), labelled(spark, labels)).where("doc_id = 9000").first().predicted == 1
    # Toxic texts are few: the clean labels drawn stand for ten times as many. A word's 60 toxic texts of 360 are a sixth, among those drawn most.
    few = [(i, "x common" if i % 2 else "x", 1) for i in range(120)] + [(1000 + i, "x common" if i % 10 == 0 else "x", 0) for i in range(3000)]
    texts = [(i, f"{t} t{i}") for i, t, _ in few] + [(9001, "a common thing")]
    marks = labelled(spark, [(i, 1, b) for i, _, b in few])
    scores = [score_toxicity(documents(spark, texts), marks, max_rows=n).where("doc_id = 9001").first().predicted for n in (120, 100_000)]
    assert scores == [0, 0]
