"""Licence scans: TF-IDF cosine of texts to licence templates, then inheritance from the nearest directory above.

Every line of a text is a possible header and is held against short statements. The whole text of a licence file, and the
comments at the head of any other, are held against the full texts and multi-line notices in `licence_texts`. Term weights
come from all documents. A line can only reach the threshold if it holds one of a template's heaviest terms, those without
which the rest of the template is too light (prefix filtering), so other lines are dropped before they are scored. A licence
file speaks for its directory; files without a licence of their own take that of the nearest directory at or above theirs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

# Short statements of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
TERM = "[a-z0-9]+"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"

# name.txt and name.header.txt: several versions of a licence are there so that each is told from the others.
FULL_TEXTS = tuple((p.name.removesuffix(".txt").removesuffix(".header"), p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
FULL_THRESHOLD = 0.9  # full texts share most of their words with other licences' full texts
MOST_BROADCAST = 200_000  # lending directories; more of them are joined by a shuffle, where the skew join splits busy ones
COMMENT = r"\A\s*+((?:/\*[\s\S]*?\*/|<!--[\s\S]*?-->|(?:(?:#|//|--|;|%)[^\n]*+(?:\n\s*+|\z))++))"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of rows of docs, and how many of them hold each term of a short vocabulary."""
    own = F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(TERM), F.lit(0))
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), own)
    rows = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    found = {r[0]: r[1] for r in rows}
    return found.pop("", 0), found


def _anchors(texts: Iterable[str], idf: dict[str, float], threshold: float) -> set[str]:
    """Each text's heaviest terms: whatever holds none of them has a cosine below threshold to it."""
    anchors = set()
    for text in texts:
        weights = sorted(((c * idf[t], t) for t, c in Counter(terms(text)).items()), reverse=True)
        rest = sum(w * w for w, _ in weights)
        whole = rest
        for w, t in weights:
            if math.sqrt(max(rest, 0) / whole) < threshold - 1e-6:
                break
            anchors.add(t)
            rest -= w * w
    return anchors


def line_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.7) -> DataFrame:
    """docs with `own_license` and `own_cosine`: the template most like any line of text, null if none reaches threshold.

    A term's weight is its count times ln((1 + documents) / (1 + documents that hold it)) + 1; terms of no template weigh as
    if no document held them. Of equal cosines the first template by name wins. A null or empty text has no licence;
    existing columns of those names are replaced.
    """
    vocabulary = sorted({t for text in templates.values() for t in terms(text)})
    return _line_licenses(docs, templates, threshold, *document_frequencies(docs, vocabulary))


def _line_licenses(docs: DataFrame, templates: dict[str, str], threshold: float, n: int, held: dict[str, int]) -> DataFrame:
    vocabulary = sorted({t for text in templates.values() for t in terms(text)})
    idf = {t: math.log((1 + n) / (1 + held.get(t, 0))) + 1 for t in vocabulary}
    unseen = math.log(1 + n) + 1
    anchors = _anchors(templates.values(), idf, threshold)
    weight = F.create_map(*(F.lit(x) for pair in idf.items() for x in pair))

    def score(own: Column) -> Column:
        tf = lambda t: F.size(F.filter(own, lambda x: x == t))
        norm = F.aggregate(F.array_distinct(own), F.lit(0.0), lambda acc, t: acc + F.pow(tf(t) * F.coalesce(F.try_element_at(weight, t), F.lit(unseen)), 2.0))
        rows = []
        for name, text in sorted(templates.items()):
            counted = Counter(terms(text))
            size = math.sqrt(sum((c * idf[t]) ** 2 for t, c in counted.items()))
            dot = sum((tf(F.lit(t)) * (c * idf[t] * idf[t]) for t, c in sorted(counted.items())), F.lit(0.0))
            rows.append(F.struct((dot / (F.sqrt(norm) * size)).alias("cosine"), F.lit(name).alias("name")))
        return F.array(*rows)

    lines = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "\n"), lambda x: F.rlike(x, F.lit(r"\b(" + "|".join(sorted(anchors)) + r")\b")))
    scored = F.flatten(F.transform(lines, lambda x: let(F.regexp_extract_all(x, F.lit(TERM), F.lit(0)), score)))
    good = F.filter(scored, lambda s: s["cosine"] >= threshold)
    ahead = lambda a, b: (b["cosine"] > a["cosine"]) | ((b["cosine"] == a["cosine"]) & (b["name"] < a["name"]))
    best = F.aggregate(good, F.get(good, F.lit(0)), lambda a, b: F.when(ahead(a, b), b).otherwise(a))
    df = docs.drop("own_license", "own_cosine").withColumn("__license", F.when(F.size(good) > 0, best))
    return df.withColumn("own_license", F.col("__license.name")).withColumn("own_cosine", F.col("__license.cosine")).drop("__license")


def is_licence_file(path: Column) -> Column:
    return F.coalesce(F.rlike(F.regexp_extract(path, "[^/]*$", 0), F.lit(LICENCE_FILE)), F.lit(False))


def full_licenses(files: DataFrame, n: int, held: dict[str, int], texts: Iterable[tuple[str, str]] = FULL_TEXTS, threshold: float = FULL_THRESHOLD) -> DataFrame:
    """(block_id, full_license, full_cosine) for the blocks of files (path, text) whose cosine to one of texts reaches threshold.

    A block is what `block()` gives and block_id its 128-bit hash; each distinct one is counted once, term by term, so long
    texts need no room of their own. n and held: document_frequencies of at least the terms of texts. Weights are those of line_licenses.
    """
    texts = [(name, Counter(terms(text))) for name, text in texts]
    idf = {t: math.log((1 + n) / (1 + held.get(t, 0))) + 1 for _, counted in texts for t in counted}
    anchors = _anchors((" ".join(c.elements()) for _, c in texts), idf, threshold)
    sizes = [math.sqrt(sum((c * idf[t]) ** 2 for t, c in counted.items())) for _, counted in texts]
    rows = [(t, w, [counted[t] * w / size for (_, counted), size in zip(texts, sizes, strict=True)]) for t, w in sorted(idf.items())]
    weights = F.broadcast(files.sparkSession.createDataFrame(rows, "term string, weight double, parts array<double>"))
    blocks = files.select(block().alias("block")).where(F.rlike(F.lower("block"), F.lit(r"\b(" + "|".join(sorted(anchors)) + r")\b")))
    blocks = blocks.groupBy(F.md5("block").alias("id")).agg(F.first("block").alias("block"))
    counted = blocks.select("id", F.explode(F.regexp_extract_all(F.lower("block"), F.lit(TERM), F.lit(0))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    weighed = counted.join(weights, "term", "left").withColumn("w", F.col("c") * F.coalesce("weight", F.lit(math.log(1 + n) + 1)))
    sums = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *(F.sum(F.col("w") * F.get("parts", F.lit(i))).alias(f"d{i}") for i in range(len(texts))))
    # Of equal cosines the first name wins, as with lines.
    cosines = F.array(*(F.struct((-F.coalesce(f"d{i}", F.lit(0.0)) / F.col("norm")).alias("less"), F.lit(name).alias("name")) for i, (name, _) in enumerate(texts)))
    best = sums.select("id", F.array_min(cosines).alias("best")).where(F.col("best.less") <= -threshold)
    return best.select(F.col("id").alias("block_id"), F.col("best.name").alias("full_license"), (-F.col("best.less")).alias("full_cosine"))


def block() -> Column:
    """The whole text of a licence file; of any other, the comment of any length that it begins with, or null.

    Lines of one comment sign, or one bracketed comment up to its end; a bracket that is never closed begins none.
    """
    head = F.regexp_extract("text", COMMENT, 1)
    return F.when(is_licence_file(F.col("path")), F.col("text")).otherwise(F.when(head != "", head))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def license_scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.7) -> DataFrame:
    """doc_id, path, own_license, own_cosine, license, origin (header, inherited or none) and from_dir for every row of files (doc_id, path, text).

    A file's own licence is the most alike of its lines to templates and of its block() to FULL_TEXTS.
    A licence file (LICENSE, LICENCE, COPYING or NOTICE, any case, any suffix) with a licence of its own lends it to its
    directory; of several, the highest cosine and then the first name counts. Of a file's equal cosines the first name counts
    too. Texts of any length are scored line by line and block by block. Paths are split at slashes; the root is the empty
    directory. A null path lies in no directory and inherits nothing. Repeated rows stay repeated. An empty
    table gives an empty result.
    """
    files = files.select("doc_id", "path", "text")
    n, held = document_frequencies(files, sorted({t for text in (*templates.values(), *(x for _, x in FULL_TEXTS)) for t in terms(text)}))
    full, _ = stored(full_licenses(files, n, held))
    lines = _line_licenses(files, templates, threshold, n, held).withColumn("block_id", F.md5(block()))
    kept = ["doc_id", "path", "own_license", "own_cosine", directory(F.col("path")).alias("dir")]
    if full.head(1):
        lines = lines.join(full, "block_id", "left")
        fuller = F.col("full_license").isNotNull() & (F.col("own_cosine").isNull() | (F.col("full_cosine") > F.col("own_cosine")))
        lines = lines.withColumn("own_license", F.when(fuller, F.col("full_license")).otherwise(F.col("own_license")))
        lines = lines.withColumn("own_cosine", F.greatest("full_cosine", "own_cosine"))
    own, _ = stored(lines.select(*kept))
    speaks = own.where(is_licence_file(F.col("path")) & F.col("own_license").isNotNull())
    # A struct's largest value has the highest cosine; equal ones are settled by the name in a second step.
    top = speaks.groupBy("dir").agg(F.max("own_cosine").alias("own_cosine"))
    lent = speaks.join(top, ["dir", "own_cosine"]).groupBy("dir").agg(F.min("own_license").alias("lent")).withColumnRenamed("dir", "above")
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("above")))
    dirs = own.where("dir is not null").select("dir").distinct().select("dir", F.inline(above))
    # All directories have their upper ones in common, so lending directories are broadcast while they are few.
    lent, _ = stored(lent)
    if lent.count() <= MOST_BROADCAST:
        lent = F.broadcast(lent)
    nearest = dirs.join(lent, "above").groupBy("dir").agg(F.max_by(F.struct("above", "lent"), "depth").alias("near"))
    out = own.join(nearest, "dir", "left")
    origin = F.when(F.col("own_license").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    inherited = F.when(F.col("own_license").isNull(), F.col("near.above"))
    return out.select("doc_id", "path", "own_license", F.round("own_cosine", 4).alias("own_cosine"), F.coalesce("own_license", F.col("near.lent")).alias("license"), origin.alias("origin"), inherited.alias("from_dir"))


def document_files(docs: DataFrame) -> DataFrame:
    """The documents table as files: source/lang/d<doc_id div 64>/..., and every eighth one a LICENSE at one of three depths."""
    deep = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.expr("doc_id div 64")))
    level = F.when(F.expr("doc_id div 8 % 3 = 0"), F.col("source")).when(F.expr("doc_id div 8 % 3 = 1"), F.concat_ws("/", "source", "lang")).otherwise(deep)
    name = F.concat(F.lit("f"), F.col("doc_id"), F.lit(".txt"))
    path = F.when(F.expr("doc_id % 8 = 0"), F.concat(level, F.lit("/LICENSE"))).otherwise(F.concat(deep, F.lit("/"), name))
    return docs.select("doc_id", path.alias("path"), "text")


def oracle_sql(templates: dict[str, str] = TEMPLATES, threshold: float = 0.7) -> str:
    quote = lambda s: s.replace("'", "''")
    values = ", ".join(f"('{k}', '{quote(v.lower())}')" for k, v in templates.items())
    return rf"""
WITH tpl AS (SELECT name, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM (VALUES {values}) AS v(name, t)),
tt AS (SELECT name, term, count(*) AS c FROM tpl GROUP BY ALL),
f AS (SELECT doc_id, text, CASE WHEN doc_id % 8 = 0 THEN CASE doc_id // 8 % 3 WHEN 0 THEN source WHEN 1 THEN source || '/' || lang ELSE source || '/' || lang || '/d' || (doc_id // 64) END || '/LICENSE'
 ELSE source || '/' || lang || '/d' || (doc_id // 64) || '/f' || doc_id || '.txt' END AS path FROM documents),
dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{TERM}')) AS term FROM f),
idf AS (SELECT v.term, ln((1 + (SELECT count(*) FROM f))::DOUBLE / (1 + count(d.doc_id))) + 1 AS w FROM (SELECT DISTINCT term FROM tt) v LEFT JOIN dt d ON v.term = d.term GROUP BY v.term),
ln_ AS (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS line FROM f),
li AS (SELECT row_number() OVER () AS id, doc_id, line FROM ln_),
lt AS (SELECT id, doc_id, term, count(*) AS c FROM (SELECT id, doc_id, unnest(regexp_extract_all(line, '{TERM}')) AS term FROM li) GROUP BY ALL),
lw AS (SELECT id, doc_id, lt.term, c, coalesce(w, ln(1 + (SELECT count(*) FROM f)) + 1) AS w FROM lt LEFT JOIN idf ON lt.term = idf.term),
norm AS (SELECT id, sum((c * w) * (c * w)) AS s FROM lw GROUP BY id),
tn AS (SELECT name, sum((c * w) * (c * w)) AS s FROM tt JOIN idf ON tt.term = idf.term GROUP BY name),
dot AS (SELECT lw.id, lw.doc_id, tt.name, sum(lw.c * lw.w * tt.c * lw.w) AS d FROM lw JOIN tt ON lw.term = tt.term GROUP BY ALL),
cosn AS (SELECT doc_id, dot.name, d / (sqrt(norm.s) * sqrt(tn.s)) AS cosine FROM dot JOIN norm ON dot.id = norm.id JOIN tn ON dot.name = tn.name),
own AS (SELECT doc_id, arg_min(name, (-round(cosine, 9), name)) AS own_license, max(cosine) AS own_cosine FROM cosn WHERE cosine >= {threshold} GROUP BY doc_id),
files AS (SELECT f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own_license, own_cosine FROM f LEFT JOIN own ON f.doc_id = own.doc_id),
lent AS (SELECT dir, arg_min(own_license, (-round(own_cosine, 9), own_license)) AS lent FROM files WHERE path LIKE '%/LICENSE' AND own_license IS NOT NULL GROUP BY dir),
near AS (SELECT d.dir, arg_max(l.dir, length(l.dir)) AS from_dir, arg_max(l.lent, length(l.dir)) AS lent
 FROM (SELECT DISTINCT dir FROM files) d JOIN lent l ON d.dir = l.dir OR d.dir LIKE l.dir || '/%' GROUP BY d.dir)
SELECT doc_id, path, own_license, round(own_cosine, 4) AS own_cosine, coalesce(own_license, lent) AS license,
 CASE WHEN own_license IS NOT NULL THEN 'header' WHEN lent IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
 CASE WHEN own_license IS NULL THEN from_dir END AS from_dir
FROM files LEFT JOIN near ON files.dir = near.dir"""
