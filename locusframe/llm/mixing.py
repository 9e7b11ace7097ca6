"""Mixing sources to target weights: token budgets flow down a domain-language-source tree, then pick documents in each leaf.

A node's budget is shared among its children by weight, none above its capacity; what a child cannot take goes to its
siblings. As a node never gets more than its own children can take, a shortage reaches an ancestor's other branches only
after the siblings are full. A leaf's budget is spent on whole epochs of its documents and then on a prefix of one more
epoch in seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

LEAF = ["domain", "lang", "source"]
MOST_BROADCAST = 100_000  # leaves; with more of them the joins on leaves shuffle
DOMAINS = ("web", "books", "news", "code")
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "news": 2, "code": 1}
LANG_WEIGHTS = {"en": 6, "fr": 2, "de": 2, "es": 1}


def source_domain() -> Column:
    """The domain of a source: by the number at its end, else `other`."""
    number = F.expr(r"try_cast(regexp_extract(source, '[0-9]+$', 0) AS INT)")
    return F.coalesce(F.get(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS)), F.lit("other"))


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    listed = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.greatest(F.coalesce(F.try_element_at(listed, F.col(name)), F.lit(1)), F.lit(0)).cast("long")


def _share(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """children (name, cap, weight, budget of the parent) with their own `budget` instead; parts of a token are dropped.

    A child of weight 0 must have cap 0.
    In order of capacity by weight, a child is full if its share of what is left, among itself and those after it, reaches
    its capacity; the others share the rest by weight.
    """
    one = W.partitionBy(*parents) if parents else W.partitionBy()
    order = one.orderBy(F.coalesce(F.try_divide("cap", "weight"), F.lit(0.0)), name)
    wide = lambda c: c.cast("decimal(38,0)")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    after = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    full = wide(F.col("cap")) * after <= wide(F.col("budget") - before) * F.col("weight")
    df = children.withColumn("full", full)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(one), F.lit(0).cast("long"))
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(one)
    df = df.withColumn("taken", taken).withColumn("free", free)
    return df.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(budget - taken AS decimal(38,0)) * weight div free"))).drop("full", "taken", "free")


def leaf_budgets(leaves: DataFrame, percent: int, epochs: int, domain_weights: Mapping[str, int], lang_weights: Mapping[str, int], source_weights: Mapping[str, int]) -> DataFrame:
    """LEAF, tokens, docs and budget for each leaf of leaves (LEAF, tokens, docs): percent of all tokens, at most `epochs` of each leaf.

    A weight of 0 or less leaves its node out: its leaves have a capacity of 0, so others fill the budget.
    """
    weights = (("domain", domain_weights), ("lang", lang_weights), ("source", source_weights))
    wanted = F.least(*(_weight(name, own) for name, own in weights)) > 0
    caps = leaves.withColumn("cap", F.when(wanted, F.col("tokens") * epochs).otherwise(0))
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    whole = W.partitionBy()
    budget = F.least(F.expr(f"cast(sum(tokens) OVER () AS decimal(38,0)) * {percent} div 100"), F.sum("cap").over(whole))
    domains = _share(domains.withColumn("weight", _weight("domain", domain_weights)).withColumn("budget", budget), [], "domain").select("domain", "budget")
    langs = langs.join(domains, "domain").withColumn("weight", _weight("lang", lang_weights))
    langs = _share(langs, ["domain"], "lang").select("domain", "lang", "budget")
    own = caps.join(langs, ["domain", "lang"]).withColumn("weight", _weight("source", source_weights))
    return _share(own, ["domain", "lang"], "source").select(*LEAF, "tokens", "docs", "budget")


def _placed(docs: DataFrame, cuts: DataFrame, seed: str) -> DataFrame:
    """docs with their leaf's row of cuts, and the place (bucket, h, id) of each in the leaf's last, partial epoch."""
    joined = docs.join(cuts, LEAF)
    key = F.concat_ws("|", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    ident = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    return joined.withColumn("h", h).withColumn("id", ident).withColumn("bucket", F.expr("h div width"))


def _named(docs: DataFrame, domain: Column, columns: list[str]) -> DataFrame:
    names = [domain.alias("domain"), *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source"))]
    return docs.select("doc_id", *names, *columns)


def plan_mix(
    docs: DataFrame,
    percent: int = 60,
    epochs: int = 2,
    seed: str = "17",
    domain: Column | None = None,
    domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
    lang_weights: Mapping[str, int] = LANG_WEIGHTS,
    source_weights: Mapping[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: tokens (doc_id, LEAF, n_tokens) for every row of docs, and cuts, a row for each leaf that says what to take.

    A token is a word between ASCII white space; null texts have none. Null languages and sources are leaves named "". A
    leaf's documents come in order of md5(seed|epoch|doc_id), then doc_id; rows that share a doc_id are taken together. The
    partial epoch takes the longest prefix within what the whole epochs leave of the budget.

    The order is found by buckets of the hash: their sums place the cut in one bucket, and only that bucket is sorted.
    """
    text = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens")
    tokens, _ = stored(_named(docs, source_domain() if domain is None else domain, [text]))
    leaves = tokens.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    found = leaf_budgets(leaves, percent, epochs, domain_weights, lang_weights, source_weights or {})
    found = found.withColumn("epochs", F.coalesce(F.expr("budget div nullif(tokens, 0)"), F.lit(0)))
    found = found.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    # About 1000 documents to a bucket, in 1 to 2^20 buckets of the 32-bit hash.
    power = F.least(F.lit(20), F.ceil(F.log2(F.greatest(F.col("docs") / 1000, F.lit(1.0)))).cast("int"))
    found, _ = stored(found.withColumn("power", power).withColumn("width", F.expr("shiftleft(1L, 32 - power)")).drop("power"))
    small = found.count() <= MOST_BROADCAST
    placed = _placed(tokens, F.broadcast(found) if small else found, seed)
    sums = placed.groupBy(*LEAF, "bucket", "rest").agg(F.sum("n_tokens").alias("held"))
    up_to = F.sum("held").over(W.partitionBy(*LEAF).orderBy("bucket"))
    cut = sums.withColumn("up_to", up_to).where("up_to > rest AND up_to - held <= rest").select(*LEAF, F.col("bucket").alias("cut"), (F.col("rest") - F.col("up_to") + F.col("held")).alias("left"))
    near = placed.join(F.broadcast(cut) if small else cut, LEAF).where("bucket = cut")
    running = F.sum("n_tokens").over(W.partitionBy(*LEAF).orderBy("h", "id").rangeBetween(W.unboundedPreceding, W.currentRow))
    last = near.withColumn("running", running).where("running <= left").groupBy(*LEAF).agg(F.max(F.struct("h", "id")).alias("last"))
    cuts, _ = stored(found.join(cut, LEAF, "left").join(last, LEAF, "left").select(*LEAF, "budget", "epochs", "width", "cut", "last"))
    return tokens, F.broadcast(cuts) if small else cuts


TAKEN = "bucket < cut OR (bucket = cut AND last IS NOT NULL AND (h < last.h OR (h = last.h AND id <= last.id)))"


def _copies(docs: DataFrame, cuts: DataFrame, seed: str) -> DataFrame:
    copies = F.col("epochs") + F.when(F.coalesce(F.expr(TAKEN), F.lit(False)), 1).otherwise(0)
    return _placed(docs, cuts, seed).withColumn("copies", copies).where("copies > 0")


def mix_report(docs: DataFrame, seed: str = "17", **plan) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and epoch (from 0) for every document taken, once for each epoch that takes it.

    See plan_mix. An empty table gives an empty result; other columns are ignored.
    """
    tokens, cuts = plan_mix(docs, seed=seed, **plan)
    taken = _copies(tokens, cuts, seed)
    return taken.select("doc_id", *LEAF, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))


def mix_documents(docs: DataFrame, percent: int = 90, epochs: int = 1, seed: str = "17", domain: Column | None = None, **plan) -> DataFrame:
    """The rows of docs that the mix takes, all columns, repeated for further epochs. No text is shuffled.

    See plan_mix; documents without tokens are taken as their place in the order says.
    """
    _, cuts = plan_mix(docs, percent=percent, epochs=epochs, seed=seed, domain=domain, **plan)
    whole = docs.withColumn("__row", F.struct(*docs.columns))
    taken = _copies(_named(whole, source_domain() if domain is None else domain, ["__row"]), cuts, seed)
    return taken.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")


def oracle_sql(percent: int = 60, epochs: int = 2, seed: str = "17") -> str:
    """mix_report with the default weights in DuckDB's SQL."""
    case = lambda name, weights: f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"

    def share(source: str, parents: str, name: str, weight: str) -> str:
        part = f"PARTITION BY {parents}" if parents else ""
        return f"""
SELECT * EXCLUDE (budget, "full", taken, free), CASE WHEN "full" THEN cap ELSE ((budget - taken) * weight // free) END::BIGINT AS budget FROM (
SELECT *, coalesce(sum(CASE WHEN "full" THEN cap END) OVER ({part}), 0) AS taken, sum(CASE WHEN NOT "full" THEN weight END) OVER ({part}) AS free FROM (
SELECT *, cap::HUGEINT * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
 <= (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT * weight AS "full"
FROM (SELECT *, {weight} AS weight FROM ({source})) WINDOW o AS ({part} ORDER BY cap::DOUBLE / weight, {name})))"""

    domains = "SELECT domain, sum(cap)::BIGINT AS cap, sum(tokens)::BIGINT AS tokens FROM leaf GROUP BY domain"
    domains = f"SELECT *, least(sum(tokens) OVER () * {percent} // 100, sum(cap) OVER ())::BIGINT AS budget FROM ({domains})"
    langs = "SELECT l.domain, lang, sum(l.cap)::BIGINT AS cap, any_value(d.budget) AS budget FROM leaf l JOIN dom d ON l.domain = d.domain GROUP BY l.domain, lang"
    own = "SELECT l.*, g.budget FROM leaf l JOIN lng g ON l.domain = g.domain AND l.lang = g.lang"
    number = "TRY_CAST(regexp_extract(source, '[0-9]+$') AS INTEGER)"
    return f"""
WITH tok AS (SELECT doc_id, coalesce(CASE {number} % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'news' WHEN 3 THEN 'code' END, 'other') AS domain,
 coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {epochs} AS cap FROM tok GROUP BY ALL),
dom AS ({share(domains, "", "domain", case("domain", DOMAIN_WEIGHTS))}),
lng AS ({share(langs, "domain", "lang", case("lang", LANG_WEIGHTS))}),
bud AS ({share(own, "domain, lang", "source", "1")}),
cut AS (SELECT domain, lang, source, coalesce(budget // nullif(tokens, 0), 0) AS epochs, budget - coalesce(budget // nullif(tokens, 0), 0) * tokens AS rest, tokens FROM bud),
ord AS (SELECT t.*, epochs, rest, tokens, ('0x' || substr(md5('{seed}|' || epochs || '|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
 FROM tok t JOIN cut c ON t.domain = c.domain AND t.lang = c.lang AND t.source = c.source),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, coalesce(doc_id, -9223372036854775808) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM ord)
SELECT doc_id, domain, lang, source, n_tokens, unnest(generate_series(0, (epochs + CASE WHEN tokens > 0 AND running <= rest THEN 1 ELSE 0 END)::BIGINT - 1)) AS epoch
FROM run"""
