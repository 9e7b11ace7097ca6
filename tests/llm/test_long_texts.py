"""Texts of ten megabytes, one to a row, through the operators that read whole texts."""

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken

from locusframe.llm import bpe, hidden_markov, importance, quality, secret_scan

from .test_operators import prose


@pytest.fixture(scope="module")
def long(spark):
    text = prose(200_000, 77) + "\n"
    text = text * (10_000_000 // len(text)) + ' password = "abcdef123" '
    return text, spark.createDataFrame([(1, text), (2, prose(60, 5)), (3, None)], "doc_id long, text string").repartition(2)


def test_quality_of_a_long_text(spark, long):
    text, docs = long
    weights = quality.ngram_weights(docs, docs.select("doc_id").limit(1))
    r = next(r for r in quality.quality_rules(docs, weights).collect() if r.doc_id == 1)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip()]
    assert (r.quality.n_words, r.quality.word_chars, r.quality.n_dup_lines) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
    assert r.quality.base_failed and not r.quality.kept  # nearly all of it is repeated


def test_secrets_at_the_end_of_a_long_text(long):
    text, docs = long
    r = next(r for r in secret_scan.secret_report(docs).collect() if r.doc_id == 1)
    at = text.index("password")
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 0, 0) and r.spans.startswith(f"assign:{at}:")


def test_tokens_of_a_long_text(long):
    text, docs = long
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = own.encode_ordinary(text)
    r = next(r for r in bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN, with_ids=False).collect() if r.doc_id == 1)
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_scores_and_weights_of_a_long_text(spark, long):
    text, docs = long
    n = len(text.split())
    r = next(r for r in hidden_markov.hmm_scores(docs, states=2, warm=1, rounds=1, fold=7).collect() if r.doc_id == 1)  # no row is held out
    assert r.n_tokens == n + 1 and r.n_known == n + 1 and r.score < 0
    found = {r.doc_id: r.n_features for r in importance.importance_resample(docs, docs.where("doc_id = 2")).collect()}
    assert found == {1: len(re.findall("[0-9a-z]+", text.lower())), 2: 60, 3: 0}
