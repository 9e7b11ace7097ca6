"""The registered text queries and the pipeline on the smallest tables, against SQL, brute force and the libraries."""

import hashlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from locusframe.llm import bpe, mixing, quality
from locusframe.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import DOCS, TEXTS, _chain, brute_fingerprint, brute_near, brute_spans, words

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    result = con.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == sorted(df.columns)
    at = [result.columns.index(c) for c in df.columns]
    assert Counter(tuple(r) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in result.fetchall())


def test_counts_and_ids_equal_the_libraries(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r.doc_id: r.n_tokens for r in QUERIES["op5_token_counts"](spark, str(DATA)).collect()}
    assert found == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op9_byte_bpe"](spark, str(DATA)).collect():
        ids = own.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def lowest_linked(texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fps}
    order = sorted(fps)
    for _ in order:
        changed = False
        for i in order:
            low = min(root[j] for j in order if (fps[i] ^ fps[j]).bit_count() <= 2)
            changed |= low < root[i]
            root[i] = min(root[i], low)
        if not changed:
            break
    return fps, root


def test_near_copies_equal_brute_force(spark, texts):
    fps, root = lowest_linked(texts)
    for r in QUERIES["op10_simhash_dedup"](spark, str(DATA)).collect():
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", root[r.doc_id])


def test_embedding_links_equal_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(rows.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.93) & (rows.label.to_numpy()[:, None] == rows.label.to_numpy()[None, :])
    found = QUERIES["op4_embedding_dedup"](spark, str(DATA)).orderBy("vec_id").toPandas()
    assert (found.n_links.to_numpy() == links.sum(axis=1) - 1).all()
    root = np.arange(len(rows))
    while (after := np.where(links, root[None, :], len(rows)).min(axis=1)).tolist() != root.tolist():
        root = after
    lowest = rows.vec_id.to_numpy()[root]  # rows come by vec_id, so the first of a component is its smallest
    assert (found.component_id.to_numpy() == lowest).all() and (found.kept.to_numpy() == (found.vec_id.to_numpy() == lowest)).all()


def test_held_out_languages(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in QUERIES["op7_language_id"](spark, str(DATA)).collect() if r.held_out]
    assert held and sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.9 * len(held)


def test_pipeline_stages_equal_brute_force(spark, con):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_dedup", "secret_scan", "mixing", "byte_bpe"]
    kept = stages["quality_rules"](spark, docs, str(DATA)).cache()
    weights = quality.ngram_weights(docs, quality.trusted_ids(spark.read.parquet(f"{DATA}/labels.parquet")))
    table = {r.bucket: r.weight for r in weights.collect()}

    def good(text):
        w = words(text)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(tri)
        repeated = {j for i, t in enumerate(tri) if often[t] > 1 for j in (i, i + 1, i + 2)}
        if len(w) < 50 or 2 * len(repeated) > len(w):
            return False
        total = sum(table[_chain([x]) % (1 << 16)] for x in w) + sum(table[_chain(p) % (1 << 16)] for p in zip(w, w[1:]))
        return total / 1000 / (2 * len(w) - 1) >= -0.1

    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, t in texts.items() if good(t)} and kept.columns == docs.columns

    once = stages["simhash_dedup"](spark, kept, str(DATA)).cache()
    # Similarities of long texts are estimates: texts at 0.9 must be in one component, those below 0.7 in none.
    own = {r.doc_id: r.text for r in kept.collect()}
    sure, perhaps = brute_near(own, 6, 0.9), brute_near(own, 64, 0.7)
    left = {r.doc_id for r in once.collect()}
    assert {i for i in perhaps if perhaps[i] == i} <= left <= {i for i in sure if sure[i] == i} and once.columns == docs.columns

    masked = stages["secret_scan"](spark, once, str(DATA)).cache()

    def mask(text):
        out, at = "", 0
        for a, _, b in brute_spans(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:]

    assert {r.doc_id: r.text for r in masked.collect()} == {r.doc_id: mask(r.text) for r in once.collect()} and masked.columns == docs.columns

    mixed = stages["mixing"](spark, masked, str(DATA)).cache()
    con.register("masked", masked.toPandas())
    wanted = con.sql(mixing.oracle_sql(percent=90, epochs=2).replace("FROM documents", "FROM masked")).fetchall()
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r[0] for r in wanted) and mixed.columns == docs.columns

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert {r.doc_id: r.ids for r in stages["byte_bpe"](spark, mixed, str(DATA)).collect()} == {i: own.encode_ordinary(t) for i, t in text.items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(DATA)).collect()} == set(text)


def test_pipeline_stages_take_nulls_clashes_and_empty_tables(spark):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 5 else None, None, "k", "s", "f") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*rows, rows[6], (None, TEXTS[6], *[None] * 6), (None,) * 8], DOCS)
    for name in ("quality", "secrets", "component_id", "n", "domain", "copies", "node"):
        docs = docs.withColumn(name, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        if name == "byte_bpe":
            assert stage(spark, docs, str(DATA)).count() == docs.count() and stage(spark, docs.limit(0), str(DATA)).count() == 0
            continue
        found = stage(spark, docs, str(DATA))
        assert found.columns == docs.columns
        assert {r.secrets for r in found.collect()} <= {"mine"} and stage(spark, docs.limit(0), str(DATA)).count() == 0
