"""The hidden Markov scores, importance resampling and hard negatives against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusframe.llm import arrow_words, hard_negatives, hidden_markov, importance
from locusframe.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
RND = random.Random(3)
VOCAB = ["".join(RND.choice("abcdeilnorst") for _ in range(RND.randint(1, 6))) for _ in range(120)]
TEXTS = [None, "", " \n\t ", "One", "one two", "é 漢字 ΣΑΣ İ A_b-c", "nul\x00nul x", "same text " * 30, "same text " * 30, " lead", "trail \x0b\x0c", "\x1cx\x85y"]
TEXTS += [" ".join(RND.choices(VOCAB, k=RND.randint(15, 60))) for _ in range(60)] + [" ".join(RND.choices(VOCAB, k=5000))]
SCHEMA = "doc_id long, text string, score string, rank int, row string, n_words string"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "y", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[20], (None, TEXTS[21], None, None, None, None)], SCHEMA).repartition(5)


@pytest.mark.parametrize("text", ["Ab c_d-é9 Z", "", "\x00a\x1cb~|x{ @[`", " \x85 p\tq\x0b\x0cr "])
def test_words_are_those_of_the_patterns(text):
    for table, pattern in ((arrow_words.WHITE, r"[^\x20\x09-\x0D]+"), (arrow_words.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        wanted = re.findall(pattern, lower(text))
        counts, words = arrow_words.split_words(pa.array(["pad", None, text, "", text])[1:], table)
        assert (counts.tolist(), words.to_pylist()) == ([0, len(wanted), 0, len(wanted)], 2 * wanted)


def test_pieces_hold_every_row(monkeypatch):
    monkeypatch.setattr(arrow_words, "PIECE", 10)
    b = pa.record_batch({"id": list(range(6)), "t": ["a" * 25, "", "bb", None, "c" * 9, "d"]})
    parts = list(arrow_words.pieces(iter([b, b.slice(0, 0)]), 1))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(6)) and len(parts) > 2


# --- hidden Markov model

RNG = np.random.default_rng(0)
MODEL = hidden_markov.Model(RNG.dirichlet(np.ones(3)), RNG.dirichlet(np.ones(3), 3), RNG.dirichlet(np.ones(7), 3).T)


def enumerated(model, text):
    """Probability and expected counts by a sum over all state sequences."""
    start, moves, emit, total = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3)), 0.0
    for z in itertools.product(range(3), repeat=len(text)):
        p = model.start[z[0]] * math.prod(model.emit[w, k] for w, k in zip(text, z)) * math.prod(model.moves[a, b] for a, b in zip(z, z[1:]))
        total += p
        start[z[0]] += p
        for w, k in zip(text, z):
            emit[w, k] += p
        for pair in zip(z, z[1:]):
            moves[pair] += p
    return total, start / total, moves / total, emit / total


@pytest.mark.parametrize("segment", [1, 2, 3, 4096])
@pytest.mark.parametrize("window", [3, 1 << 18])
def test_recursions_equal_enumeration(monkeypatch, window, segment):
    monkeypatch.setattr(hidden_markov, "WINDOW", window)
    monkeypatch.setattr(hidden_markov, "SEGMENT", segment)
    monkeypatch.setattr(hidden_markov, "LONG", segment)
    texts = [RNG.integers(0, 7, n).astype(np.int32) for n in (1, 5, 3, 6, 1, 4)]
    wanted = [enumerated(MODEL, t) for t in texts]
    lengths = np.array([len(t) for t in texts])
    counts, found = hidden_markov.Counts(7, 3), np.zeros(6)
    for place, steps, inside in hidden_markov.side_by_side(MODEL, np.concatenate(texts), lengths):
        np.add.at(found, place, hidden_markov.log_likelihood(MODEL, steps, inside))
        counts.add(MODEL, steps, inside)
    assert np.allclose(found, [math.log10(w[0]) for w in wanted]) and np.isclose(counts.total, found.sum())
    for got, at in ((counts.start, 1), (counts.moves * MODEL.moves, 2), (counts.emit, 3)):
        assert np.allclose(got, sum(w[at] for w in wanted))


def test_a_long_text_is_scored_as_a_whole(monkeypatch):
    text = RNG.integers(0, 7, 3000).astype(np.int32)
    whole = hidden_markov.log_likelihood(MODEL, hidden_markov.Steps(text, np.array([3000])))
    state, total = MODEL.start, 0.0
    for i, w in enumerate(text):
        state = (state if i == 0 else state @ MODEL.moves) * MODEL.emit[w]
        total += math.log10(state.sum())
        state = state / state.sum()
    assert np.isclose(whole[0], total)
    monkeypatch.setattr(hidden_markov, "SEGMENT", 70)
    steps, inside = hidden_markov.segmented(MODEL, text)
    assert len(steps.order) == 43 and np.isclose(hidden_markov.log_likelihood(MODEL, steps, inside).sum(), total)
    monkeypatch.setattr(hidden_markov, "WINDOW", 100)
    assert np.isclose(hidden_markov.log_likelihood(MODEL, steps, inside).sum(), total)
    assert np.isclose(hidden_markov.log_likelihood(MODEL, hidden_markov.Steps(text, np.array([3000])))[0], total)


def test_texts_of_all_lengths_share_the_chances():
    """With an end of their own, the probabilities of all texts of up to n symbols go to one."""
    model = hidden_markov.Model(np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.5, 0.5]]), np.array([[0.1, 0.3], [0.2, 0.2], [0.7, 0.5]]))
    texts = [np.array([*t, 2], np.int32) for n in range(9) for t in itertools.product((0, 1), repeat=n)]
    steps = hidden_markov.Steps(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert 0.99 < (10 ** hidden_markov.log_likelihood(model, steps)).sum() < 1


def brute_base(rows):
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for i, t in rows}
    counts = Counter(w for (i, _), own in zip(rows, tokens.values()) for w in own if zlib.crc32(str(i).encode()) % 7 != 2)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) for i, own in tokens.items()}


@pytest.mark.parametrize("own", [1 << 15, 16, 0])
def test_base_scores_whatever_words_share_symbols(spark, docs, own):
    once = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    wanted = brute_base(list(enumerate(TEXTS)))
    rows = hidden_markov.hmm_scores(once, states=3, own=own, shared=8, warm=2, rounds=1).collect()
    assert sorted(r.doc_id for r in rows) == sorted(wanted)
    for r in rows:
        length, known, n, base = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, length, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0


def test_words_of_a_shared_symbol_share_its_chance(spark):
    """One state is a unigram model: the score follows from the counts alone."""
    rows = [(i, " ".join(random.Random(i).choices("abcdefgh", k=20))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = {i: [*t.split(), None] for i, t in rows}
    training = Counter(w for i, own in tokens.items() for w in own if zlib.crc32(str(i).encode()) % 7 != 2)
    mass = sum(c + 1 for c in training.values()) + 2  # one unseen word in each of two shared symbols
    shared = Counter()
    for w, c in training.items():
        if w:
            shared[zlib.crc32(w.encode()) % 2] += c + 1
    for r in hidden_markov.hmm_scores(docs, states=1, own=0, shared=2, warm=0, rounds=1, prior=1e6).collect():
        known = [w for w in tokens[r.doc_id] if w]
        chance = sum(math.log10((shared[b] + 1) / mass * (training[w] + 1) / (shared[b] + 1)) for w in known for b in [zlib.crc32(w.encode()) % 2])
        assert math.isclose(r.score, chance + math.log10((training[None] + 1) / mass), rel_tol=1e-4)


def test_rounds_raise_the_likelihood_and_states_find_structure(spark):
    """Two kinds of texts with words of their own, in runs: states tell them apart, a unigram model cannot."""
    kinds = [[f"{k}{i}" for i in range(40)] for k in "pq"]
    rows = [(i, " ".join(random.Random(i).choices(kinds[i % 2], k=60))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = hidden_markov.vocabulary(hidden_markov.word_counts(docs), len(rows), 1 << 10, 8)
    texts = hidden_markov.encoded(docs, words, 2, 7).withColumn("row", F.monotonically_increasing_id())
    _, seen = hidden_markov.train(texts, words.mass, 2, 4, 6, 0.0, 1, 50)
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:])) and len(seen) == 6
    found = hidden_markov.hmm_scores(docs, states=2, warm=10, rounds=2).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (found.s - found.b) / found.n > 0.2


def test_hmm_edges(spark, docs):
    rows = hidden_markov.hmm_scores(docs, states=2, warm=1, rounds=1).collect()
    assert len(rows) == len(TEXTS) + 2 and sum(r.doc_id is None and r.held_out is False for r in rows) == 1
    twice = [r for r in rows if r.doc_id == 20]
    assert len(twice) == 2 and twice[0] == twice[1]
    ends = {r.doc_id: r.n_tokens for r in rows}
    assert [ends[i] for i in range(3)] == [1, 1, 1] and ends[len(TEXTS) - 1] == 5001
    assert hidden_markov.hmm_scores(docs.limit(0), warm=1, rounds=1).collect() == []
    unseen = hidden_markov.hmm_scores(spark.createDataFrame([(i, "a b") for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string"))
    assert {(r.n_known, r.train_tokens, r.base_score) for r in unseen.collect()} == {(0, 0, 0.0)}


@pytest.mark.skipif(not DATA.is_dir(), reason="needs the driver's tables")
def test_hmm_query_on_the_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    wanted = brute_base(list(texts.items()))
    rows = QUERIES["op11_hmm_scores"](spark, str(DATA)).collect()
    assert len(rows) == len(wanted)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == wanted[r.doc_id][:3] and math.isclose(r.base_score, wanted[r.doc_id][3], rel_tol=1e-9)
    for held in (True, False):
        own = [r for r in rows if r.held_out is held]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)


# --- importance resampling


def brute_resample(rows, target, percent=10, least=20, length=1, buckets=10_000, seed=2024):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, length + 1) for i in range(len(w) - n + 1)]

    raw, aim = Counter(b for _, t in rows for b in features(t)[1]), Counter(b for t in target for b in features(t)[1])
    s, t = raw.total() + buckets, aim.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * s / ((raw[b] + 1) * t)))
    out, keys = {}, []
    for i, text in rows:
        n, own = features(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = (len(own), weight, score)
        if n >= least:
            keys.append((-score, i))
    ranks = {i: k + 1 for k, (_, i) in enumerate(sorted(keys)[: len(keys) * percent // 100])}
    return {i: (*x, ranks.get(i)) for i, x in out.items()}


@pytest.mark.parametrize(("percent", "length"), [(10, 1), (50, 3), (100, 2), (0, 1)])
def test_resampling_equals_brute_force(spark, percent, length):
    rows = list(enumerate(TEXTS))
    target = [TEXTS[15], TEXTS[16], "漢字 one", None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    found = importance.importance_resample(docs, aim, percent, 20, length)
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()} == brute_resample(rows, target, percent, 20, length)


def test_resampling_edges(spark, docs):
    aim = docs.select("text").limit(3)
    found = importance.importance_resample(docs, aim, 50).collect()
    assert len(found) == len(TEXTS) + 2
    long = [r for r in found if r.doc_id is not None and len(re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower((TEXTS[r.doc_id] or "")))) >= 20]
    drawn = sorted(r["rank"] for r in found if r["rank"])
    assert drawn == list(range(1, len(long) // 2 + 1))
    (nameless,) = [r for r in found if r.doc_id is None]
    assert nameless.score is None and nameless["rank"] is None and nameless.n_features > 0
    assert importance.importance_resample(docs.limit(0), aim).collect() == []
    assert all(r.weight is not None for r in importance.importance_resample(docs, aim.limit(0)).collect())
    copies = spark.createDataFrame([(7, "a " + TEXTS[30] * 2)] * 40 + [(8, "b " + TEXTS[31] * 2)] * 3, "doc_id long, text string")
    ranks = sorted(r["rank"] for r in importance.importance_resample(copies, aim, 50).collect() if r["rank"])
    assert ranks == list(range(1, 22))


def test_quickselect_finds_every_place(spark):
    values = [(RND.randint(-5, 5), RND.randint(0, 3)) for _ in range(300)] + [(2, 2)] * 200
    keys = spark.createDataFrame(values, "a long, b long").repartition(3)
    for k in (1, 2, 150, 250, 400, 499, 500):
        assert importance.kth_key(keys, ["a", "b"], k, pivots=4) == sorted(values)[k - 1]
    assert importance.kth_key(keys, ["a", "b"], 501) is None and importance.kth_key(keys, ["a", "b"], 0) is None
    rows = importance.ranked(keys.withColumn("c", F.monotonically_increasing_id()), ["a", "b", "c"], 7).collect()
    assert [(r.a, r.b) for r in sorted(rows, key=lambda r: r["rank"])] == sorted(values) and sorted(r["rank"] for r in rows) == list(range(1, 501))


@pytest.mark.skipif(not DATA.is_dir(), reason="needs the driver's tables")
def test_resampling_query_on_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = QUERIES["op12_importance_resampling"](spark, str(DATA)).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in found} == brute_resample(rows, target)


# --- hard negatives


@pytest.mark.parametrize("size", [3, 300, 1 << 20, 1 << 28, 1 << 45])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(size % 97)
    a, x = (rng.integers(-size, size, (n, 9)) for n in (5, 23))
    wanted = a.astype(object) @ x.T.astype(object)
    found = hard_negatives.scores(a, x)
    limit = np.iinfo(np.int64)
    assert (found == np.clip(wanted, limit.min, limit.max)).all()
    assert hard_negatives.scores(a[:0], x).shape == (0, 23) and hard_negatives.scores(a, x[:1]).shape == (5, 1)


def test_packing_puts_fields_side_by_side():
    rows = np.array([[1, -2], [3, 4], [-5, 0]])
    packed = hard_negatives.pack(rows, 5, 10, 2)
    assert packed.T.tolist() == [[6 + 8 * 1024, 3 + 9 * 1024], [0, 5]]
    assert hard_negatives.unpack(packed.T.copy(), 10, 2, 3)[0].tolist() == [6, 8, 3]


def brute_negatives(rows):
    own = {}
    for i, v, label in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        own[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
    out = set()
    for a in own:
        if a % 100:
            continue
        ranked = sorted(((-sum(x * y for x, y in zip(own[a][1], own[b][1])), b) for b in own if b != a and len(own[a][1]) == len(own[b][1])))
        for s, p in [x for x in ranked if own[x[1]][0] == own[a][0]][:5]:
            good = [x for x in ranked if own[x[1]][0] != own[a][0] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out.update((a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(good))
    return out


@pytest.mark.parametrize("block", [1, 4096])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "TILE", 50)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] / 2 + rng.normal(size=6) * 0.6).round(1).tolist(), i % 3) for i in range(330)]
    rows[5], rows[6], rows[9] = (5, None, 1), (6, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (9, [float("nan")] * 6, 1)
    rows[11], rows[12], rows[13], rows[200] = (11, [float("inf")] * 6, 2), (12, [], 2), (13, [1.0, 2.0], 1), (200, rows[200][1], None)
    rows += [(None, [1.0] * 6, 1), (400, [0.0] * 6, 1), (401, [1e200, 0.0, 0.0, 0.0, 0.0, -1e-200], 2), (500, [-3.5] * 6, -1), rows[100], rows[7]]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, score string").repartition(3)
    found = [tuple(r) for r in hard_negatives.hard_negatives(df).collect()]
    wanted = {tuple(x if abs(x) < 2**63 else (2**63 - 1 if x > 0 else -(2**63)) for x in r) for r in brute_negatives(rows)}
    assert len(found) == len(set(found)) and set(found) == wanted
    assert hard_negatives.hard_negatives(df.limit(0)).collect() == []


def test_components_are_rounded_down(spark):
    values = [0.1, -0.1, 1 / 256, -1 / 256, 0.0, -0.0, 3.999, -1e-300, 255.5 / 256, 1e18, -1e18, 5e15 + 0.5]
    df = spark.createDataFrame([(1, values, 3)], "vec_id long, embedding array<double>, label int")
    assert [int(x) for x in hard_negatives.integer_rows(df).first().v] == [math.floor(256 * x) for x in values]
