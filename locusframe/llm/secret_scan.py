"""Secret scans over a trigram index: regexes become Boolean trigram queries, and only their candidates are verified.

The index holds postings (trigram, doc_id) for the trigrams that the rules ask for, of the lower-cased texts. A rule's
query is a list of alternatives, each a set of trigrams that a matching text must hold; postings are intersected by
grouping. Rules without such trigrams scan every text.
"""

from __future__ import annotations

from itertools import product
from re import _constants as kind
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored


class Rule(NamedTuple):
    kind: str
    pattern: str  # means the same to Java, RE2 and Python
    group: int  # whose length must be at least `least`
    least: int


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
BASE = [
    Rule("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
]
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
]
RULES = BASE + MORE
MOST_BROADCAST = 1_000_000  # candidates, of some tens of bytes; more of them are joined by a shuffle
MOST_STRINGS = 64  # a run of a regex is cut where it could be more strings than this


def _runs(tree) -> list[set[str]]:
    """The runs of a regex's parse tree: each the set of lower-case strings of which a match holds one, with nothing between."""
    runs: list[set[str]] = [{""}]

    def add(strings: set[str] | None) -> None:
        if strings is None or len(strings) * len(runs[-1]) > MOST_STRINGS:
            runs.append({""})
        else:
            runs[-1] = {a + b for a, b in product(runs[-1], strings)}

    for op, arg in tree:
        if op is kind.LITERAL:
            add({chr(arg).lower()})
        elif op is kind.IN:
            chars = {chr(x).lower() if o is kind.LITERAL else None for o, x in arg}
            chars |= {chr(c).lower() for o, x in arg if o is kind.RANGE and x[1] - x[0] < 8 for c in range(x[0], x[1] + 1)}
            wide = any(o not in (kind.LITERAL, kind.RANGE) or (o is kind.RANGE and x[1] - x[0] >= 8) for o, x in arg)
            add(None if wide else chars - {None})
        elif op is kind.SUBPATTERN:
            inner = _runs(arg[-1])
            add(inner[0])
            for run in inner[1:]:
                add(None)
                add(run)
        elif op is kind.BRANCH:
            inner = [_runs(x) for x in arg[1]]
            add(set().union(*(x[0] for x in inner)) if all(len(x) == 1 for x in inner) else None)
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT):
            low, high, body = arg
            inner = _runs(body)
            if (low, high) == (0, 1) and len(inner) == 1:
                add({""} | inner[0])
            elif low == high == 1 and len(inner) == 1:
                add(inner[0])
            else:
                add(None)
        else:
            add(None)
    return runs


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives, each the trigrams of a lower-case string; every match holds one of the strings. Empty: no query, scan fully."""
    runs = [r for r in _runs(parser.parse(pattern)) if min(map(len, r)) >= 3]
    best = max(runs, key=lambda r: (min(map(len, r)), -len(r)), default=set())
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in best}
    return sorted(sorted(x) for x in sets if not any(y < x for y in sets))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for each of the trigrams that a text holds in lower case."""
    folded = F.lower(F.col("text"))
    held = let(folded, lambda t: F.filter(F.array(*map(F.lit, trigrams)), lambda x: F.contains(t, x)))
    return docs.where("text is not null").select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rules): for each doc_id the kinds of the rules with a trigram query that some text of it satisfies."""
    spark = docs.sparkSession
    rows = [(r.kind, i, t, 1 << k, (1 << len(alt)) - 1) for r in rules for i, alt in enumerate(trigram_query(r.pattern)) for k, t in enumerate(alt)]
    if not rows:
        return docs.select("doc_id", F.array(F.lit("")).alias("rules")).limit(0)
    terms = spark.createDataFrame(rows, "kind string, alternative int, trigram string, bit long, need long")  # as many rows as the rules have trigrams
    found = postings(docs, sorted({r[2] for r in rows})).join(F.broadcast(terms), "trigram")
    whole = found.groupBy("doc_id", "kind", "alternative", "need").agg(F.bit_or("bit").alias("have")).where("have = need")
    return whole.groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) in code points of the rule's matches, leftmost and non-overlapping, long enough."""
    pattern = F.lit(rule.pattern)

    def place(gaps: Column, found: Column, checked: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(gaps, i))
            end = start + F.length(F.get(found, i))
            own = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
            keep = F.length(F.get(checked, i)) >= rule.least
            return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))
        none = F.array().cast("array<int>")
        order = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(none)
        return F.aggregate(order, zero, step, lambda acc: acc["spans"])

    def whole(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, pattern, F.lit(0))
        return let(found, lambda m: place(gaps, m, F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else m))

    return F.when(F.rlike(text, pattern), let(F.split(text, rule.pattern, -1), whole)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, name: str = "secrets") -> DataFrame:
    """docs with a column `name`: sorted array of (start, kind, end); kind is the rule's place in rules.

    Offsets are in code points, end exclusive. A null text has none. Rows that share a doc_id are verified one by one, those
    without one by every rule; an existing column of that name is replaced. Spans that start alike are in the order of the
    rules. An empty table gives an empty result.
    """
    queried = [r for r in rules if trigram_query(r.pattern)]
    named = docs.where("doc_id is not null")
    found, _ = stored(candidates(named, queried).select("doc_id", F.col("rules").alias("__secret_rules")))
    # The candidates are ids alone: while they are few, no text is shuffled to meet them.
    df = named.join(F.broadcast(found) if found.count() <= MOST_BROADCAST else found, "doc_id", "left")
    every = F.array(*(F.lit(r.kind) for r in queried)).cast("array<string>")
    df = df.unionByName(docs.where("doc_id is null").withColumn("__secret_rules", every)).select(*docs.columns, "__secret_rules")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    for i, r in enumerate(rules):
        spans = _spans(text, r, i)
        if r in queried:
            spans = F.when(F.coalesce(F.array_contains("__secret_rules", r.kind), F.lit(False)), spans).otherwise(none)
        df = df.withColumn(f"__secret_{i}", spans)
    df = df.withColumn(name, F.sort_array(F.concat(*(f"__secret_{i}" for i in range(len(rules))))))
    return df.drop("__secret_rules", *(f"__secret_{i}" for i in range(len(rules))))


def spans_text(secrets: Column, rules: list[Rule]) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, rules: list[Rule] = RULES, base: int = len(BASE)) -> DataFrame:
    """doc_id, n_<kind> (longs) and base_sha256 of the first `base` rules, and spans of all rules, for every row of docs."""
    found = find_secrets(docs, rules)

    def count(i: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    own = spans_text(F.filter("secrets", lambda s: s["kind"] < base), rules)
    return found.select("doc_id", *counts, F.sha2(own, 256).alias("base_sha256"), spans_text(F.col("secrets"), rules).alias("spans"))


def mask_secrets(docs: DataFrame, rules: list[Rule] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs, all rows and columns, with every secret in text replaced by mask; overlapping ones become one.

    n_chars, if there, follows the new text where that has changed.
    """
    found = find_secrets(docs, rules, "__secrets")
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        apart = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["out"], before, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("__secrets", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))
    out = found.withColumn("text", F.when(F.size("__secrets") > 0, masked).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def oracle_sql(rules: list[Rule] = RULES, base: int = len(BASE)) -> str:
    """The same report in DuckDB's SQL, every rule scanning every text."""
    quote = lambda s: s.replace("'", "''")
    parts = ", ".join(f"string_split_regex(t, '{quote(r.pattern)}') AS g{i}, regexp_extract_all(t, '{quote(r.pattern)}') AS m{i}, regexp_extract_all(t, '{quote(r.pattern)}', {r.group}) AS c{i}" for i, r in enumerate(rules))
    each = []
    for i, r in enumerate(rules):
        start = f"list_sum([length(x) for x in g{i}[1:k]]) + coalesce(list_sum([length(x) for x in m{i}[1:k-1]]), 0)"
        each.append(f"[{{'s': ({start})::BIGINT, 'k': {i}, 'e': ({start} + length(m{i}[k]))::BIGINT}} for k in range(1, len(m{i}) + 1) if length(c{i}[k]) >= {r.least}]")
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    said = f"list_aggregate([{names}[x.k + 1] || ':' || x.s || ':' || x.e for x in %s], 'string_agg', ',')"
    counts = ", ".join(f"len([x for x in a if x.k = {i}])::BIGINT AS n_{r.kind}" for i, r in enumerate(rules[:base]))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, {parts} FROM d),
s AS (SELECT doc_id, list_sort({' || '.join(f'({x})' for x in each)}) AS a FROM p)
SELECT doc_id, {counts}, sha256(coalesce({said % f'[y for y in a if y.k < {base}]'}, '')) AS base_sha256, coalesce({said % 'a'}, '') AS spans FROM s"""
