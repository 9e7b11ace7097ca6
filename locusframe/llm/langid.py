"""Language identification in two steps: the language family, then one-versus-one linear SVMs among its languages.

Features are hashed byte trigrams of the lower-cased letters of the whole text, as square roots of counts scaled to unit
length. The machines are fitted by Spark ML on a bounded, hash-chosen sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

BITS = 12
FITS = 8  # machines fitted at once
# Families of ISO 639-1 languages; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ur pa gu",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
KEEP = bytes(b if b >= 128 or chr(b).islower() else 32 for b in range(256))


def features(texts: list[str]) -> np.ndarray:
    """A unit row of 2**BITS values for each text; zero for a text without letters."""
    parts = [b"  " + t.lower().encode().translate(KEEP) for t in texts]
    raw = np.frombuffer(b"".join(parts) + b"  ", np.uint8).astype(np.uint32)
    code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    spaces = code == 0x202020
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    flat = (owner << BITS) + code
    counts = np.bincount(flat[~spaces], minlength=len(texts) << BITS).reshape(len(texts), -1)
    norm = np.sqrt(counts.sum(axis=1, keepdims=True))
    return np.sqrt(counts) / np.maximum(norm, 1)


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of doc_id as text falls into the fold; false without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def training_sample(docs: DataFrame, most: int = 400) -> DataFrame:
    """(lang, features): of each language at most `most` labelled rows outside the held-out fold, the first by a hash of doc_id and text.

    Only rows whose hash is under a cut are ranked. The cut follows from the language's rows, so that about one and a half
    times `most` pass, however many rows a language has; the row of the least hash always does. Copies of a row have one hash
    and pass together, but count one by one: rows that share a doc_id differ by their text.
    """
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", place.alias("place"))
    share = F.least(F.lit(1.0), (1.5 * most + 50) / F.count("*")) * (1 << 40)
    cuts = known.groupBy("lang").agg(F.greatest(share, F.min("place")).alias("cut"))  # a row for each language
    near = known.join(F.broadcast(cuts), "lang").where("place <= cut")
    rows = near.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("place"))).where(F.col("at") <= most).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                x = features(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["lang", "features"])

    return rows.mapInArrow(run, "lang string, features array<double>")


class Pairwise:
    """One-versus-one linear machines among some classes."""

    def __init__(self, classes: list[str], machines: list[tuple[int, int, np.ndarray, float]]):
        self.classes, self.machines = classes, machines

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class with most wins, ties by the summed margins, and its mean chance of winning."""
        n = len(self.classes)
        wins, margins, chance = (np.zeros((len(x), n)) for _ in range(3))
        for a, b, w, c in self.machines:
            m = np.clip(x @ w + c, -30, 30)
            p = 1 / (1 + np.exp(-2 * m))
            wins[:, a] += m > 0
            wins[:, b] += m <= 0
            margins[:, a] += m
            margins[:, b] -= m
            chance[:, a] += p
            chance[:, b] += 1 - p
        best = np.argmax(wins + np.tanh(margins / 1e3) / 4, axis=1)
        return best, chance[np.arange(len(x)), best] / max(1, n - 1) if n > 1 else np.ones(len(x))


def fit(sample: DataFrame, family_of: Mapping[str, str] = FAMILY_OF) -> tuple[Pairwise, list[Pairwise]] | None:
    """The families' machines and, for each family, its languages' machines; None without labelled rows."""
    rows = sample.withColumn("x", array_to_vector("features")).select("lang", "x")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not langs:
        return None
    groups: dict[str, list[str]] = {}
    for lang in langs:
        groups.setdefault(family_of.get(lang, lang), []).append(lang)
    names = sorted(groups)

    def machine(pair: tuple[list[str], list[str]]) -> tuple[np.ndarray, float]:
        both = rows.where(F.col("lang").isin(pair[0] + pair[1])).select(F.col("lang").isin(pair[0]).cast("double").alias("label"), "x")
        model = LinearSVC(featuresCol="x", maxIter=25, regParam=1e-4, standardization=False).fit(both)
        return model.coefficients.toArray(), model.intercept

    # Every machine is a chain of small jobs, so several are fitted at once.
    sets = [[groups[n] for n in names], *([[x] for x in groups[n]] for n in names)]
    pairs = [(i, a, b) for i, classes in enumerate(sets) for a, b in combinations(range(len(classes)), 2)]
    with ThreadPoolExecutor(FITS) as pool:
        fitted = list(pool.map(inheritable_thread_target(machine), [(sets[i][a], sets[i][b]) for i, a, b in pairs]))
    own = [[(a, b, *fitted[k]) for k, (i, a, b) in enumerate(pairs) if i == j] for j in range(len(sets))]
    return Pairwise(names, own[0]), [Pairwise(groups[n], own[j + 1]) for j, n in enumerate(names)]


def identify(docs: DataFrame, most: int = 400, family_of: Mapping[str, str] = FAMILY_OF) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs (doc_id, text, lang).

    Learns from at most `most` rows of each language outside the held-out fold. `und` with score 0 for a null text, one
    without a letter, and for all if nothing was learned. The score is the family's chance times the language's. Rows
    without doc_id are predicted but not learned from; repeated rows stay repeated; other columns are ignored. A text of any
    length counts as a whole; languages that win equally often are told apart by their margins, then by name. An empty table
    gives an empty result.
    """
    sample, _ = stored(training_sample(docs, most))
    model = docs.sparkSession.sparkContext.broadcast(fit(sample, family_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = [t or "" for t in part.column(2).to_pylist()]
                lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                own = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                if model.value and own.any():
                    families, inner = model.value
                    x = features([t for t, o in zip(texts, own, strict=True) if o])
                    first, p = families.predict(x)
                    names = np.full(len(x), "", object)
                    for f, machines in enumerate(inner):
                        if (mine := first == f).any():
                            second, q = machines.predict(x[mine])
                            names[mine] = np.array(machines.classes, object)[second]
                            p[mine] *= q
                    lang[own], score[own] = names, np.clip(p, 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
