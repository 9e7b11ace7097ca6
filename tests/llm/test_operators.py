"""Small fixtures for the text operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from datetime import date

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from locusframe.llm import bpe, embedding_dedup, langid, licenses, mixing, quality, secret_scan, simhash_dedup, token_counts, url_filters
from locusframe.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, fingerprint string"
RND = random.Random(5)
VOCAB = ["".join(RND.choice("abcdeilnorst") for _ in range(RND.randint(1, 8))) for _ in range(400)]


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


TEXTS = [
    None, "", "   \n\t ", "one", "one two", "a b c d a b c", prose(80, 1), prose(80, 1), prose(80, 1) + " end", prose(4000, 2), "x y z\n" * 60,
    "é 漢字 🙂 ΣΑΣ İ <|endoftext|>", "A B C", "a b c", 'token = "abcdef" secret: abc api_key=0123456789abcdef01234567', "AKIA" + "A" * 16 + " AKIASHORT",
    "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "f" * 300, "  lead", "trail  ", "nul\x00 nul", " p q", "token=secret:abcdefgh",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 5 else None, None, "k", "s", "f") for i, t in enumerate(TEXTS)]
    rows += [(None, TEXTS[6], None, None, 1, None, None, None), rows[6], (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_components_follow_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3), (5, None), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_rules_match_brute_force(spark, docs):
    labels = spark.createDataFrame([(6, 1, 0), (9, 1, 0), (9, 1, 0), (10, 0, 0), (None, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    weights = quality.ngram_weights(docs, quality.trusted_ids(labels), buckets=512)
    found = quality.quality_rules(docs, weights, buckets=512)
    assert found.columns == [*docs.columns, "quality"] and found.count() == docs.count()
    table = {r.bucket: r.weight for r in weights.collect()}
    hash64 = lambda *p: _chain(p) % 512
    for r in found.collect():
        w = words(r.text)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(tri)
        repeated = {j for i, t in enumerate(tri) if often[t] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(repeated))
        assert tuple(r.quality)[:5] == want
        assert r.quality.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        if w:
            total = sum(table[hash64(x)] for x in w) + sum(table[hash64(x, y)] for x, y in zip(w, w[1:]))
            assert r.quality.score == pytest.approx(total / 1000 / (2 * len(w) - 1))
        assert r.quality.kept == (not r.quality.base_failed and r.quality.score >= -0.1)
    assert found.where("quality.kept").count() == sum(r.quality.kept for r in found.collect())


def test_ngram_weights_equal_independent_counts(spark, docs):
    labels = spark.createDataFrame([(6, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = {r.bucket: r.weight for r in quality.ngram_weights(rows, quality.trusted_ids(labels), buckets=512, prior=1.5).collect()}
    counts, trusted = Counter(), Counter()
    for i, t in enumerate(TEXTS):
        w = words(t)
        own = [_chain([x]) % 512 for x in w] + [_chain(p) % 512 for p in zip(w, w[1:])]
        counts.update(own)
        trusted.update(own if i in (6, 9) else [])
    share = lambda c, b: c[b] / c.total() + 1.5 / 512
    assert set(found) == set(counts)
    for b, weight in found.items():
        assert abs(weight - 1000 * math.log(share(trusted, b) / share(counts, b))) <= 0.51
    # A corpus repeated ten times has the same weights.
    ten = rows.crossJoin(spark.range(10)).select((F.col("doc_id") + 1000 * F.col("id")).alias("doc_id"), "text")
    more = spark.createDataFrame([(i + 1000 * k, 1, 0) for i in (6, 9) for k in range(10)], "doc_id long, quality int, toxic int")
    assert {r.bucket: r.weight for r in quality.ngram_weights(ten, quality.trusted_ids(more), buckets=512, prior=1.5).collect()} == found


def _chain(parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed


def test_quality_rules_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = quality.ngram_weights(docs, quality.trusted_ids(none), buckets=64)
    assert {r.weight for r in weights.collect()} == {0}
    empty = docs.limit(0)
    assert quality.quality_rules(empty, quality.ngram_weights(empty, quality.trusted_ids(none), buckets=64), buckets=64).count() == 0


def test_url_filters_intervals_and_ties(spark):
    entries = spark.createDataFrame(
        [("bad.com", "spam", date(2024, 1, 5), "add"), ("bad.com", "spam", date(2024, 1, 5), "add"), ("bad.com", "spam", date(2024, 1, 10), "remove"), ("bad.com", "spam", date(2024, 2, 1), "add"),
         ("x.bad.com", None, date(2024, 1, 1), "add"), ("x.bad.com", None, date(2024, 1, 1), "remove"), (None, "spam", date(2024, 1, 1), "add"), ("bad.com", "adult", date(2024, 1, 7), "add"), ("bad.com", "z", None, "add")],
        "pattern string, category string, listed_on date, action string",
    )
    days = [date(2024, 1, 4), date(2024, 1, 5), date(2024, 1, 9), date(2024, 1, 10), date(2024, 2, 2), None]
    rows = [(i, "https://u@X.Bad.com.:80/p?q", d, "clash") for i, d in enumerate(days)] + [(9, None, days[1], ""), (9, None, days[1], ""), (10, "notaurl", days[1], ""), (11, "http://verybad.com/", days[1], "")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date, blocked string")
    found = url_filters.url_verdicts(captures, entries)
    assert found.count() == len(rows)
    got = {r.page_id: (r.n_active, r.categories, r.blocked) for r in found.collect()}
    assert got == {0: (0, "", False), 1: (1, "spam", True), 2: (2, "adult,spam", True), 3: (1, "adult", True), 4: (2, "adult,spam", True), 5: (0, "", False), 9: (0, "", False), 10: (0, "", False), 11: (0, "", False)}
    assert url_filters.url_verdicts(captures.limit(0), entries.limit(0)).count() == 0


def test_url_filters_case_single_labels_and_addresses(spark):
    entries = spark.createDataFrame(
        [("Bad.com", "spam", date(2024, 1, 5), "add"), ("bad.com", "spam", date(2024, 1, 10), "remove"), ("localhost", "own", date(2024, 1, 1), "add"), ("3.4", "x", date(2024, 1, 1), "add"), ("1.2.3.4", "ip", date(2024, 1, 1), "add"), ("com", "tld", date(2024, 1, 1), "add")],
        "pattern string, category string, listed_on date, action string",
    )
    rows = [(1, "http://bad.com/", date(2024, 1, 6), "c"), (2, "http://bad.com/", date(2024, 1, 11), "c"), (3, "http://localhost:8080/x", date(2024, 2, 1), "c"), (4, "http://1.2.3.4/", date(2024, 2, 1), "c"), (5, "http://9.2.3.4/", date(2024, 2, 1), "c")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date, host string")
    got = {r.page_id: (r.n_active, r.categories) for r in url_filters.url_verdicts(captures.withColumn("n_active", F.lit(7)), entries).collect()}
    assert got == {1: (1, "spam"), 2: (0, ""), 3: (1, "own"), 4: (1, "ip"), 5: (0, "")}


def test_license_scan_inherits_from_the_nearest_directory(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/COPYING.txt", "text\nLicensed under CC BY-NC 4.0.\n"), (3, "a/b/c/f.txt", "plain words"), (4, "a/x/f.txt", None),
        (5, "a/x/own.txt", "foo\nLICENSED under the Apache License, version 2.0"), (6, "z/f.txt", ""), (7, "f.txt", "licensed"), (8, None, "Released under the MIT License."), (9, None, None), (4, "a/x/f.txt", None),
        (10, "ab/f.txt", "x"), (11, "n/LICENSE", "no licence here"), (12, "n/f", "y"),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    found = licenses.license_scan(files)
    assert found.count() == len(rows)
    got = {r.doc_id: (r.own_license, r.license, r.origin, r.from_dir) for r in found.collect()}
    assert got[1] == ("MIT", "MIT", "header", None) and got[2][:3] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "header")
    assert got[3] == (None, "CC-BY-NC-4.0", "inherited", "a/b") and got[4] == (None, "MIT", "inherited", "a")
    assert got[5][:3] == ("Apache-2.0", "Apache-2.0", "header")
    assert all(got[i] == (None, None, "none", None) for i in (6, 7, 9, 10, 11, 12)) and got[8][1] == "MIT"
    assert licenses.license_scan(files.limit(0)).count() == 0


def test_license_scan_reads_full_texts_and_comment_blocks(spark):
    full = {}
    for name, text in licenses.FULL_TEXTS:
        full.setdefault(name, []).append(text)
    mit = full["MIT"][0].replace("<year> <copyright holders>", "2021 Jane Roe and the Widget Authors")
    bsd = full["BSD-3-Clause"][0].replace("REGENTS", "COPYRIGHT HOLDERS")
    comment = lambda text, mark: "".join(f"{mark} {x}\n" for x in text.splitlines())
    short = {name: min(full[name], key=len) for name in ("Apache-2.0", "GPL-3.0", "MPL-2.0")}
    rows = [("m/LICENSE", mit, "MIT"), ("b/LICENSE.txt", bsd, "BSD-3-Clause"), ("a/LICENSE", max(full["Apache-2.0"], key=len), "Apache-2.0"), ("g/COPYING", max(full["GPL-3.0"], key=len), "GPL-3.0")]
    rows += [("g2/COPYING", max(full["GPL-2.0"], key=len), "GPL-2.0"), ("p/LICENSE", max(full["MPL-2.0"], key=len), "MPL-2.0"), ("l/COPYING", full["LGPL-3.0"][0], "LGPL-3.0")]
    rows += [("b2/LICENSE", full["BSD-2-Clause"][0], "BSD-2-Clause"), ("h/a.py", comment(short["Apache-2.0"], "#") + "import os\n", "Apache-2.0"), ("h/b.c", "/*\n" + short["GPL-3.0"] + "*/\nint main;\n", "GPL-3.0")]
    rows += [("h/c.js", comment(mit, "//") + "let x\n", "MIT"), ("h/d.py", "# a tool\n" + prose(300, 4), None), ("h/e.txt", None, None), ("h/f.txt", "import os\n" + mit, None), (None, mit, None), ("q/LICENSE", prose(200, 5), None)]
    rows += [("o/LICENSE", f"plain {i}", None) for i in range(30)]
    files = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "doc_id long, path string, text string")
    found = {r.doc_id: r.own_license for r in licenses.license_scan(files).collect()}
    assert found == {i: r[2] for i, r in enumerate(rows)}
    lent = spark.createDataFrame([(1, "m/LICENSE", mit), (2, "m/x/f.py", "x = 1")], "doc_id long, path string, text string")
    assert {r.doc_id: (r.license, r.origin, r.from_dir) for r in licenses.license_scan(lent).collect()}[2] == ("MIT", "inherited", "m")


def test_embedding_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    rows = [(i, (base[i % 60] + 0.08 * rng.standard_normal(16) * (i >= 60)).tolist(), i % 2 + (0 if i < 60 else 0)) for i in range(180)]
    rows += [(200 + i, base[0].tolist(), 0) for i in range(5)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, base[0].tolist(), None), (304, [None] * 16, 1), (305, [], 1), (306, base[0].tolist()[:8], 0), (307, [float("inf")] + [1.0] * 15, 1)]
    rows += [rows[0], (None, base[1].tolist(), 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    found = embedding_dedup.embedding_dedup(df, cell_rows=32)
    assert found.count() == len(rows)

    def usable(v, label):
        return label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)

    links = {}
    x = [(r[0], np.array(r[1], np.float32).astype(float) if usable(r[1], r[2]) else None, r[2]) for r in rows]
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in range(i):
            a, b = x[i], x[j]
            if a[1] is not None and b[1] is not None and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / math.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.93:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, r in enumerate(x):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), 1 << 60), r[0])
    want = sorted((r[0] if r[0] is not None else -1, links.get(i, 0), low.get(root(i), -1)) for i, r in enumerate(x))
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in found.collect())
    assert got == want
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_dedup_links_pairs_across_blocks(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cos = rng.uniform(0.9301, 0.94, (1500, 1))
    both = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * b])
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(both)], "vec_id long, embedding array<double>, label int")
    found = embedding_dedup.embedding_dedup(df, cell_rows=64).orderBy("vec_id").toPandas()
    assert (found.n_links == 1).sum() == 3000
    assert (found.component_id == found.vec_id % 1500).all()


@pytest.mark.parametrize("cell_rows", [150, 4096])
def test_embedding_pairs_at_the_threshold_share_a_cell(spark, cell_rows):
    """2,500 pairs between 0.930 and 0.935: of one label, in cells of several bits or in one."""
    rng = np.random.default_rng(21)
    a = rng.standard_normal((2500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2500, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.930001, 0.935, (2500, 1))
    both = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(both)], "vec_id long, embedding array<double>, label int").repartition(4)
    bits = embedding_dedup.cell_bits(5000, cell_rows)
    assert bits == (5 if cell_rows == 150 else 0) and embedding_dedup.cell_tables(bits, 0.93, 16) == (13 if bits else 1)
    found = embedding_dedup.embedding_dedup(df, cell_rows=cell_rows).toPandas()
    assert (found.n_links != 1).sum() <= 2 and (found.n_links > 1).sum() == 0  # a chance of 1e-4 for each of 2,500 pairs


def test_cells_of_a_label_follow_its_size():
    assert [embedding_dedup.cell_bits(n, 4096) for n in (1, 8191, 8192, 17_000_000)] == [0, 0, 1, 12]
    copies = [embedding_dedup.cell_tables(k, 0.93, 16) for k in range(13)]
    assert copies[0] == 1 and copies == sorted(copies) and copies[12] < 45
    rng = np.random.default_rng(22)
    unit = rng.standard_normal((5, 8))
    got = embedding_dedup.cells(unit, 3, 4)
    signs = unit @ embedding_dedup.directions(8, 12, 5) > 0
    assert got.shape == (5, 4) and all(got[i, t] == sum(int(signs[i, 3 * t + k]) << k for k in range(3)) for i in range(5) for t in range(4))


def test_embedding_dedup_groups_do_not_grow_with_their_label(spark, monkeypatch, tmp_path):
    plain, log = embedding_dedup.candidate_pairs, str(tmp_path / "groups")

    def noted(proj, home, width, need):
        with open(log, "a") as f:
            f.write(f"{len(proj)} {home.sum()}\n")
        return plain(proj, home, width, need)

    monkeypatch.setattr(embedding_dedup, "candidate_pairs", noted)
    x = np.random.default_rng(6).standard_normal((1000, 64))
    x = np.concatenate([x, x + 1e-3, x - 1e-3])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = embedding_dedup.embedding_dedup(df, cell_rows=32).toPandas()
    assert (found.n_links == 2).all() and found.component_id.nunique() == 1000
    seen = np.loadtxt(log, dtype=int)
    assert len(seen) > 100
    assert seen[:, 0].max() < 32 * 2 * (1 + 8) and seen[:, 1].max() < 32 * 2


@pytest.fixture(scope="module")
def spec():
    return token_counts.read_spec(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_equal_the_library(spark, docs, spec):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = token_counts.token_counts(docs, spec, limit=6)
    assert found.count() == docs.count()
    text = dict(enumerate(TEXTS))
    for i, r in by_id(found).items():
        n = len(library.encode(text[i] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((text[i] or "").encode()), n > 6)
    assert token_counts.token_counts(docs.limit(0), spec).count() == 0


def test_token_prefixes_count_every_prefix(spark, spec):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = "hello thereabouts, naïveté 42 extraordinarily"
    rows = token_counts.token_prefixes(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), spec).orderBy("word_no").collect()
    at = 0
    for r in rows:
        at = text.index(r.word, at)
        for k in range(1, len(r.word) + 1):
            assert r.before + r.counts[k] == len(library.encode(text[: at + k], add_special_tokens=False).ids)
        at += len(r.word)


def test_token_counts_of_very_long_words(spec):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counter = token_counts.PrefixCounter(spec)
    for text in ("ab" * 2500, "".join(RND.choice("etaoins") for _ in range(3000))):
        assert counter.totals(text)[-1] == len(library.encode(text, add_special_tokens=False).ids)


def test_trigram_queries():
    assert secret_scan.trigram_query(secret_scan.BASE[1].pattern) == [["aki", "kia"]]
    assert secret_scan.trigram_query(secret_scan.BASE[2].pattern) == []
    assert ["ken", "oke", "tok"] in secret_scan.trigram_query(secret_scan.BASE[0].pattern)
    assert secret_scan.trigram_query("ab?c") == [] and secret_scan.trigram_query("(abcd|xyz)+") == []


def brute_spans(text):
    out = []
    for k, r in enumerate(secret_scan.RULES):
        out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return sorted(out)


def test_secret_scan_matches_brute_force(spark, docs):
    found = secret_scan.secret_report(docs)
    assert found.count() == docs.count()
    for i, r in by_id(found).items():
        spans = brute_spans(TEXTS[i] or "")
        say = lambda x: ",".join(f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in x)
        base = [s for s in spans if s[1] < 3]
        assert r.spans == say(spans) and r.base_sha256 == hashlib.sha256(say(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
    assert secret_scan.secret_report(docs.limit(0)).count() == 0


def test_mask_secrets_hides_every_span(spark, docs):
    masked = secret_scan.mask_secrets(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    got = by_id(masked)
    assert got[14].text == '[SECRET]" secret: abc [SECRET]' and got[14].n_chars == len(got[14].text) and got[9].text == TEXTS[9] and got[0].text is None
    assert secret_scan.secret_report(masked).where("spans <> ''").count() == 0


def test_columns_of_the_operators_names_survive(spark, docs):
    named = docs.select("doc_id", "text", F.lit("mine").alias("secrets"), F.lit(3).alias("quality"))
    masked = secret_scan.mask_secrets(named)
    assert masked.columns == named.columns and {(r.secrets, r.quality) for r in masked.collect()} == {("mine", 3)}


def test_language_identification(spark):
    r = random.Random(3)
    kinds = {"en": "the and ing tion of with", "de": "der und ung keit sch ein", "fr": "les eau que ment oui ère", "es": "los que ción ado mente ñas"}
    rows = [(i, " ".join(r.choice(kinds[k].split()) + r.choice(kinds[k].split()) for _ in range(60)), k, "x") for i, k in enumerate(r.choice(list(kinds)) for _ in range(300))]
    rows += [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "123 ²½ !?", None, "x"), (None, "the and ing", "en", "x"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = langid.identify(df).collect()
    assert len(found) == len(rows)
    truth = {a: b for a, _, b, _ in rows[:300]}
    for x in found:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
        if x.doc_id in (1000, 1001, 1002):
            assert (x.lang_pred, x.score) == ("und", 0)
    held = [x for x in found if x.held_out and x.doc_id in truth]
    assert sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.95 * len(held)
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {x.lang_pred for x in none} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_languages_that_tie_are_told_apart_by_margins_then_by_name():
    none = np.zeros(1)
    ring = langid.Pairwise(["a", "b", "c"], [(0, 1, none, 2.0), (1, 2, none, 1.0), (0, 2, none, -1.5)])  # each wins once; a and c by 0.5
    assert ring.predict(np.zeros((2, 1)))[0].tolist() == [0, 0]
    ring = langid.Pairwise(["a", "b", "c"], [(0, 1, none, 2.0), (1, 2, none, 1.0), (0, 2, none, -3.0)])
    best, chance = ring.predict(np.zeros((1, 1)))
    assert best.tolist() == [2] and 0 < chance[0] < 1
    assert langid.Pairwise(["a"], []).predict(np.zeros((1, 1))) == (np.array([0]), np.array([1.0]))


def test_mixing_budgets_fill_siblings_before_ancestors(spark):
    rows = [("a", "x", "1", 10, 1), ("a", "x", "2", 100, 1), ("a", "y", "1", 1000, 1), ("b", "x", "1", 1000, 1)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long, docs long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, 20, 1, {}, {}, {}).collect()}
    # 20 % of 2110 is 422: 211 to each domain; in a, 105 each to x and y; of x's, 10 to source 1 and the rest to its sibling.
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 95, ("a", "y", "1"): 105, ("b", "x", "1"): 211}
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, 90, 1, {}, {}, {}).collect()}
    # 90 % is 1899: 949 to b, 950 wanted by a (half of 1899 is 949); x is full with 110, so y gets what x cannot take.
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "1"): 839, ("b", "x", "1"): 949}


def test_mixing_leaves_out_weights_of_zero_and_less(spark, docs):
    rows = [("a", "x", "1", 10, 1), ("a", "x", "2", 100, 1), ("a", "y", "1", 1000, 1), ("b", "x", "1", 1000, 1), ("c", "z", "1", 5 * 10**17, 1)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long, docs long")
    budgets = lambda *w: {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, 100, 1, *w).collect()}
    got = budgets({"c": 0}, {"x": -3}, {})
    assert got == {("a", "x", "1"): 0, ("a", "x", "2"): 0, ("a", "y", "1"): 1000, ("b", "x", "1"): 0, ("c", "z", "1"): 0}
    assert budgets({"c": 10**6}, {}, {"2": 0})[("c", "z", "1")] == 5 * 10**17
    assert set(budgets({"a": 0, "b": 0, "c": 0}, {}, {}).values()) == {0}
    taken = mixing.mix_report(docs, percent=100, lang_weights={"en": 0}).collect()
    assert taken and all(r.lang != "en" or r.n_tokens == 0 for r in taken)


def test_mixing_takes_whole_epochs_and_a_prefix(spark, docs):
    report = mixing.mix_report(docs, percent=150, epochs=3)
    tokens, cuts = mixing.plan_mix(docs, percent=150, epochs=3)
    used = {tuple(r[:3]): r.used for r in report.groupBy("domain", "lang", "source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "used").collect()}
    for r in cuts.collect():
        assert used.get((r.domain, r.lang, r.source), 0) <= r.budget
    assert sum(used.values()) <= 1.5 * sum(len(words(t)) for t in [*TEXTS, TEXTS[6], TEXTS[6]])
    kept = mixing.mix_documents(docs, percent=100)
    assert kept.columns == docs.columns and kept.where("n_chars = 1").count() <= 1
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_bpe_round_trip_equals_the_library(spark, docs):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN)
    assert found.count() == docs.count()
    for i, r in by_id(found).items():
        text = TEXTS[i] or ""
        ids = library.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {i: r.text for i, r in by_id(bpe.bpe_decode(found, ranks)).items()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.bpe_encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_merge_replay_fuzz():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(8)
    texts = ["".join(r.choice(r.choice(["ab", "aeiou rst", " \n\t", "é漢🙂", "0123,.'s", "\x00", "\x1c\x85\xa0\u2003\u3000 "])) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000, "a \x00b", "hello \x00world again", "\x00", "\x00 \x00", "\x00\x00 a\x00 "]
    encoder = bpe.Encoder(bpe.Merges(ranks), public_tokenizers.PATTERN)
    assert [np.frombuffer(raw, np.int32).tolist() for raw in encoder.encode(texts)] == library.encode_ordinary_batch(texts)


def test_encoder_keeps_bounded_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1 << 20)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder, r = bpe.Encoder(bpe.Merges(ranks), public_tokenizers.PATTERN), random.Random(2)
    for i in range(60):
        texts = [f"  indented {r.random()} text  {i} " + "x  y " * 50 for _ in range(50)]
        ids = [np.frombuffer(raw, np.int32) for raw in encoder.encode(texts)]
        assert [b"".join(encoder.merges.bytes[k] for k in own.tolist()).decode() for own in ids] == texts
        kept = [*encoder.known.items(), *encoder.parts.items(), *encoder.heads.items()]
        assert sum(len(a.encode()) + len(b) for a, b in kept) <= encoder.held < 3 << 20


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, docs):
    found = simhash_dedup.simhash_dedup(docs)
    rows = found.collect()
    assert len(rows) == docs.count()
    fps = {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}
    near = {i: min(j for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 2) for i in fps}
    for r in rows:
        if r.doc_id is not None:
            assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == near[r.doc_id]
        else:
            assert not r.kept
    assert simhash_dedup.simhash_dedup(docs.limit(0)).count() == 0


def brute_near(texts, radius=6, similarity=0.8):
    """{id: smallest id reachable} for texts of at most 128 shingles, or texts that share none."""
    own = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        bits = [xxhash.xxh64_intdigest(x, 42) for x in set(w)]
        fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in bits) > len(bits))
        own[i] = fp, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def linked(a, b):
        (f, x), (g, y) = own[a], own[b]
        alike = len(x & y) >= similarity * len(x | y) if x and y else not x and not y
        return (f ^ g).bit_count() <= radius and alike

    near = {i: [j for j in own if linked(i, j)] for i in own}
    root = {i: i for i in own}
    while (after := {i: min(root[j] for j in near[i]) for i in own}) != root:
        root = after
    return root


def edited(text, every):
    return " ".join(f"new{k}" if k % every == every - 1 else w for k, w in enumerate(text.split()))


def test_near_copies_match_brute_force(spark, docs):
    texts = dict(enumerate(TEXTS))
    texts |= {100 + k: edited(prose(120, 40 + k // 6), (3, 10, 30, 50, 60, 1000)[k % 6]) for k in range(36)}
    more = spark.createDataFrame([(i, t, *[None] * 6) for i, t in texts.items() if i >= 100], DOCS)
    both = docs.unionByName(more)
    root = brute_near(texts)
    assert len(set(root.values())) < len(texts) - 15
    for settings in ({}, {"radius": 6}):
        rows = simhash_dedup.near_copies(both, **settings).collect()
        assert len(rows) == both.count()
        for r in rows:
            assert (r.component_id, r.kept) == ((root[r.doc_id], root[r.doc_id] == r.doc_id) if r.doc_id is not None else (r.component_id, False))
    kept = simhash_dedup.drop_near_copies(both)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*(i for i in root if root[i] == i), None, None])
    assert simhash_dedup.near_copies(docs.limit(0)).count() == 0 and simhash_dedup.drop_near_copies(docs.limit(0)).count() == 0


def test_near_copies_in_slices_of_a_hot_shard(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "SHARD_ROWS", 16)
    texts = {i: prose(100, 7).replace(" ", f" q{i} ", 1) for i in range(90)} | {1000 + i: prose(100, 100 + i) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    root = brute_near(texts)
    assert {r.doc_id: r.component_id for r in simhash_dedup.near_copies(df).collect()} == root and sum(v == 0 for v in root.values()) == 90


def test_block_tables_lose_no_pair():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 6, replace=False).astype(np.uint64)) for _ in a])
    for rows in (10, 10**7, 10**9):
        tables = simhash_dedup._tables(rows, 6)
        masks = [np.bitwise_or.reduce([np.uint64(((1 << bits) - 1) << shift) for shift, bits in t]) for t in tables]
        assert np.any([(flips & m) == 0 for m in masks], axis=0).all()
    assert [len(simhash_dedup._tables(n, 6)) for n in (10, 10**7, 10**9)] == [7, 28, 84]


def test_trees_below_trees_find_every_pair(spark, monkeypatch):
    """Eight leaves a tree: 1e6 rows to a leaf of one would be seven trees deep; here four."""
    assert simhash_dedup.levels(10**6, 1, 8) == 7 and simhash_dedup.levels(16_000_000, 2048, 8192) == 1 and simhash_dedup.levels(10**12, 2048, 8192) == 3
    seen = []
    plain = simhash_dedup.build_tree
    monkeypatch.setattr(simhash_dedup, "build_tree", lambda points, leaf: seen.append(len(points)) or plain(points, leaf))
    monkeypatch.setattr(simhash_dedup, "SLICE", 100)
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, 2500, dtype=np.uint64)
    near = [base[:600] ^ np.uint64(1 << 9), base[300:900] ^ np.uint64(5 << 33), base[:200] ^ np.uint64(7 << 50), np.arange(300, dtype=np.uint64) << np.uint64(3)]
    fp = np.unique(np.concatenate([base, *near])).view(np.int64)
    rows = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    assert simhash_dedup.levels(len(fp), 4, 8) == 4
    found = {r.fp: r.root for r in simhash_dedup.fingerprint_groups(rows, leaf_rows=4, sampled=64).collect()}
    assert max(seen) < 2 * 64  # the driver's sample keeps to its bound, whatever the leaves wanted
    u = fp.view(np.uint64)
    forest = simhash_dedup.Forest(len(u))
    forest.join(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2))
    want = {int(x): int(fp[r]) for x, r in zip(fp, forest.parent)}
    groups = lambda d: {frozenset(k for k in d if d[k] == v) for v in set(d.values())}
    assert groups({k: found.get(k, k) for k in want}) == groups(want)


def test_routes_of_guests_reach_every_leaf_near_them():
    rng = np.random.default_rng(13)
    fp = rng.integers(0, 1 << 20, 2000, dtype=np.uint64)
    tree = simhash_dedup.build_tree(fp[:400], 8)
    again = simhash_dedup.Tree.unpacked(tree.packed())
    own = np.arange(2000) < 1000
    idx, leaf, home = simhash_dedup.route(again, fp, 2, own)
    assert (np.bincount(idx[home], minlength=2000) == own).all()
    at = {(i, x) for i, x in zip(idx.tolist(), leaf.tolist())}
    first = {i: x for i, x, h in zip(idx.tolist(), leaf.tolist(), home) if h}
    for i, j in zip(*np.nonzero(np.bitwise_count(fp[:1000, None] ^ fp[None, 1000:]) <= 2)):
        assert (j + 1000, first[i]) in at  # a guest meets every home point where that lives


def test_trees_grow_with_the_wanted_leaves():
    points = np.random.default_rng(3).integers(0, 1 << 63, 200_000, dtype=np.uint64)
    tree = simhash_dedup.build_tree(points, 8)
    _, leaf, home = simhash_dedup.route(tree, points, 0)
    held = np.bincount(leaf[home])
    assert len(held) >= 200_000 / 8 and held.max() <= 8 and home.all()
    same = simhash_dedup.build_tree(np.full(100, 7, np.uint64), 8)
    assert not len(same.vantage)


def test_vantage_point_leaves_find_every_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, base ^ np.uint64(1 << 5), base[:100] ^ np.uint64(3 << 40), base[:50] ^ np.uint64(7 << 20)])).view(np.int64)
    found = {r.fp: r.root for r in simhash_dedup.fingerprint_groups(spark.createDataFrame([(int(x),) for x in fp], "fp long"), leaf_rows=40).collect()}
    u = fp.view(np.uint64)
    forest = simhash_dedup.Forest(len(u))
    forest.join(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2))
    want = {int(x): int(fp[r]) for x, r in zip(fp, forest.parent)}
    groups = lambda d: {frozenset(k for k in d if d[k] == v) for v in set(d.values())}
    assert groups({k: found.get(k, k) for k in want}) == groups(want)


def test_url_filters_keep_addresses_in_brackets_whole(spark):
    entries = spark.createDataFrame([("[2001:DB8::1]", "ip", date(2024, 1, 1), "add"), ("[::2]", "ip", date(2024, 1, 1), "add")], "pattern string, category string, listed_on date, action string")
    urls = {"http://[2001:db8::1]:80/x": ("[2001:db8::1]", 1), "http://[2001:db8::2]/": ("[2001:db8::2]", 0), "https://u:p@[::2]?q": ("[::2]", 1), "http://[::22]/": ("[::22]", 0), "http://[::2": ("[", 0), "http://a.b/[::2]": ("a.b", 0)}
    captures = spark.createDataFrame([(u, date(2024, 2, 1)) for u in urls], "url string, fetched_on date")
    assert {r.url: (r.host, r.n_active) for r in url_filters.url_verdicts(captures, entries).collect()} == urls


def test_licences_in_leading_comments_of_any_length(spark):
    styles = {"/*": lambda t: f"/*\n{t}\n*/\nint x;\n", "#": lambda t: "".join(f"# {x}\n" for x in t.splitlines()) + "x = 1\n", "//": lambda t: "".join(f"// {x}\n" for x in t.splitlines()) + "let x\n", "<!--": lambda t: f"<!--\n{t}\n-->\n<p>\n"}
    texts = sorted(set(licenses.FULL_TEXTS))
    rows = [(i * 10 + k, f"d{i}/{k}.x", style(text)) for i, (_, text) in enumerate(texts) for k, style in enumerate(styles.values())]
    plain = [(1000 + i, f"p{i}/LICENSE", text) for i, (_, text) in enumerate(texts)]
    rows += [(2000, "u/a.c", "/* " + texts[0][1]), (2001, "u/b.c", "int x;\n/* " + texts[0][1] + "*/"), (2002, "u/c.c", "# " + "word " * 3_000_000), (2003, "u/d.c", "/* " + "x\n" * 2_000_000 + "*/")]
    files = spark.createDataFrame(rows + plain, "doc_id long, path string, text string")
    found = {r.doc_id: (r.own_license, r.own_cosine) for r in licenses.license_scan(files).collect()}
    for i, (name, _) in enumerate(texts):
        whole = found[1000 + i]
        assert whole[0] == name
        for k in range(len(styles)):
            assert found[i * 10 + k][0] == name and found[i * 10 + k][1] == pytest.approx(whole[1], abs=0.02), (name, k)
    assert found[2002] == found[2003] == (None, None)


def test_language_samples_of_repeated_ids(spark):
    same = [(1, prose(20, i), "xx") for i in range(1000)]
    copies = [(4, "always the same words here", "yy")] * 900
    few = [(10 + i, prose(20, 5000 + i), "zz") for i in range(30)]
    docs = spark.createDataFrame(same + copies + few, "doc_id long, text string, lang string").repartition(7)
    training = {1, 4, *(10 + i for i in range(30))} - {i for i in (1, 4, *range(10, 40)) if zlib.crc32(str(i).encode()) % 4 == 2}
    counts = Counter(r.lang for r in langid.training_sample(docs, 400).collect())
    wanted = {"xx": 400 if 1 in training else 0, "yy": 400 if 4 in training else 0, "zz": sum(i in training for i in range(10, 40))}
    assert counts == Counter({k: v for k, v in wanted.items() if v}) and max(counts.values()) == 400


def test_votes_equal_independent_margins():
    """Each pair of classes has one vote; wins decide, then summed margins: counted here by plain loops."""
    r = np.random.default_rng(4)
    classes = ["a", "b", "c", "d"]
    machines = [(i, j, r.normal(size=6), float(r.normal() / 4)) for i in range(4) for j in range(i + 1, 4)]
    x = r.normal(size=(300, 6))
    best, chance = langid.Pairwise(classes, machines).predict(x)
    for row, got, p in zip(x, best, chance, strict=True):
        wins, margins, odds = [0] * 4, [0.0] * 4, [0.0] * 4
        for i, j, w, c in machines:
            m = sum(a * b for a, b in zip(row, w)) + c
            wins[i if m > 0 else j] += 1
            margins[i], margins[j] = margins[i] + m, margins[j] - m
            odds[i] += 1 / (1 + math.exp(-2 * m))
            odds[j] += 1 / (1 + math.exp(2 * m))
        assert got == max(range(4), key=lambda k: (wins[k], margins[k])) and p == pytest.approx(odds[got] / 3)


def test_language_votes_of_fitted_machines_equal_plain_counting(spark):
    """The whole path: machines fitted by Spark ML, features and votes of every text counted again by hand."""
    r = random.Random(12)
    kinds = {"en": "the and ing tion of with", "de": "der und ung keit sch ein", "nl": "het een van ijk oor zijn", "fr": "les eau que ment oui", "es": "los que ado mente"}
    names = list(kinds)
    rows = [(i, " ".join(r.choice(kinds[k].split()) + r.choice(kinds[r.choice(names)].split()) for _ in range(12)), k) for i, k in enumerate(r.choice(names) for _ in range(250))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    families, inner = langid.fit(langid.training_sample(df))
    found = {x.doc_id: x for x in langid.identify(df).collect()}

    def vote(machines, v):
        n = len(machines.classes)
        wins, margins, odds = [0] * n, [0.0] * n, [0.0] * n
        for i, j, w, c in machines.machines:
            m = float(np.dot(w, v)) + c
            wins[i if m > 0 else j] += 1
            margins[i], margins[j] = margins[i] + m, margins[j] - m
            odds[i], odds[j] = odds[i] + 1 / (1 + math.exp(-2 * m)), odds[j] + 1 / (1 + math.exp(2 * m))
        k = max(range(n), key=lambda k: (wins[k], margins[k]))
        return k, odds[k] / (n - 1) if n > 1 else 1.0

    for i, text, _ in rows:
        raw = "  " + re.sub("[^a-z]", " ", text.lower()) + "  "
        v = np.zeros(1 << langid.BITS)
        for k in range(len(raw) - 2):
            if raw[k : k + 3] != "   ":
                v[(int.from_bytes(raw[k : k + 3].encode(), "little") * 2654435761 & 0xFFFFFFFF) >> (32 - langid.BITS)] += 1
        v = np.sqrt(v / v.sum())
        f, p = vote(families, v)
        k, q = vote(inner[f], v)
        assert (found[i].lang_pred, found[i].score) == (inner[f].classes[k], pytest.approx(p * q, abs=1e-6)), i


def test_mixing_takes_rows_without_id_of_a_leaf_together(spark):
    """Ten rows without doc_id and ten with one, five tokens each, three quarters of all wanted: the ten go together, whatever the order says."""
    rows = [(None, "a b c d e", "en", "src0")] * 10 + [(i, "a b c d e", "en", "src0") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    seen = set()
    for seed in map(str, range(6)):
        taken = mixing.mix_report(docs, seed=seed, percent=75, epochs=1).collect()
        without = sum(r.doc_id is None for r in taken)
        assert without in (0, 10) and sum(r.n_tokens for r in taken) <= 75 and len({r.doc_id for r in taken if r.doc_id is not None}) == len(taken) - without
        place = lambda d: (int(hashlib.md5(f"{seed}|0|{'' if d is None else d}".encode()).hexdigest()[:8], 16), -(1 << 63) if d is None else d)  # noqa: E731, B023
        order = sorted([None, *range(10)], key=place)
        want, left = [], 75
        for d in order:
            if (50 if d is None else 5) > left:
                break
            want, left = want + [d] * (10 if d is None else 1), left - (50 if d is None else 5)
        assert Counter(r.doc_id for r in taken) == Counter(want)
        seen.add(without)
    assert seen == {0, 10}
