"""Exact token counts at every prefix of a text by dynamic programming, for BPE with a mark on the last symbol of a word.

The tokens of a prefix are the tokens of a shorter prefix and one last token: of the vocabulary's tokens that end there,
the one that may stand beside the last token of the rest. So one pass over a word gives the last token and the count at
each of its prefixes, and a text's counts are sums over its words.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LONG_WORD = 64  # symbols; longer words keep no prefixes for others
CACHE_WORDS = 300_000  # distinct words, and pairs of tokens, that a task keeps before it starts anew


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixCounter(dict):
    """Token counts of words' prefixes under a tokenizer file's vocabulary, merges and end-of-word mark; as a dict, of pieces seen."""

    def __init__(self, spec: dict):
        super().__init__()
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = set(model["vocab"])
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.made = {a + b: i for (a, b), i in self.rank.items()}
        self.halves = {a + b: (a, b) for a, b in self.rank}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.symbols = byte_symbols()
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.beside: dict[tuple[str, str], bool] = {}
        self.shared: dict[str, tuple[str, int]] = {}

    def fits(self, left: str, right: str) -> bool:
        """Whether left and right stay two tokens when all their symbols are merged together.

        Merges are undone from the latest on, looking at the two tokens that meet at the border: a pair there whose merge
        comes before the last one undone would have been merged. Of equal merges the left one comes first.
        """
        if (found := self.beside.get((left, right))) is None:
            if len(self.beside) > CACHE_WORDS:
                self.beside.clear()
            a, b, before = left, right, 1 << 30
            made, rank = self.made, self.rank
            while True:
                if rank.get((a, b), 1 << 30) < before:
                    found = False
                    break
                ra, rb = made.get(a, -1), made.get(b, -1)
                if ra < 0 and rb < 0:
                    found = True
                    break
                if ra > rb:
                    a, before = self.halves[a][1], ra
                else:
                    b, before = self.halves[b][0], rb + 1
            self.beside[left, right] = found
        return found

    def at(self, prefix: str) -> tuple[str, int]:
        """Last token and number of tokens of a short prefix of a word's symbols, if the word went on; shared by all words."""
        if (found := self.shared.get(prefix)) is None:
            size = min(self.longest, len(prefix))
            while found is None:
                if (token := prefix[-size:]) in self.vocab:
                    left, n = self.at(prefix[:-size]) if size < len(prefix) else ("", 0)
                    if not left or self.fits(left, token):
                        found = token, n + 1
                size -= 1
            self.shared[prefix] = found
        return found

    def last(self, word: str, end: int, tails: list[str], mark: str) -> str:
        """The last token of word[:end], if mark follows it."""
        for size in range(min(self.longest, end), 0, -1):
            token = word[end - size : end] + mark
            if token in self.vocab and (size == end or self.fits(tails[end - size], token)):
                return token
        raise ValueError(f"no token ends at {end} of {word!r}")

    def prefixes(self, word: str) -> tuple[list[str], list[int]]:
        """Last token and number of tokens of each prefix of word's byte symbols, if the word went on."""
        tails, counts = [""], [0]
        for end in range(1, len(word) + 1):
            tails.append(self.last(word, end, tails, ""))
            counts.append(counts[end - len(tails[end])] + 1)
        return tails, counts

    def as_symbols(self, word: str) -> str:
        return "".join([self.symbols[b] for b in word.encode()])

    def word_counts(self, word: str) -> list[int]:
        """Tokens of every prefix of a word, by number of characters from 0, each as if the text ended there."""
        symbols = self.as_symbols(word)
        tails, counts = self.prefixes(symbols)
        ends = accumulate(len(c.encode()) for c in word)
        return [0, *(counts[e - len(self.last(symbols, e, tails, self.end).removesuffix(self.end))] + 1 for e in ends)] if self.end else [counts[e] for e in [0, *ends]]

    def count(self, word: str) -> int:
        """Tokens of a whole word."""
        symbols = self.as_symbols(word)
        if len(symbols) > LONG_WORD:
            return self.word_counts(word)[-1]
        if not self.end:
            return self.at(symbols)[1]
        for size in range(min(self.longest, len(symbols)), 0, -1):
            if (token := symbols[-size:] + self.end) in self.vocab:
                left, n = self.at(symbols[:-size]) if size < len(symbols) else ("", 0)
                if not left or self.fits(left, token):
                    return n + 1
        raise ValueError(f"no token ends {word!r}")

    def __missing__(self, piece: str) -> int:
        """Tokens of a piece of normalized text without spaces; kept for the next time."""
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.shared) > CACHE_WORDS:
            self.shared.clear()
        n = self[piece] = sum(map(self.count, self.words.findall(piece)))
        return n

    def normal(self, text: str) -> str:
        """The normalizer of the file: NFC, white space runs to one space, lower case letter by letter."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        return text.lower()

    def parts(self, text: str) -> Iterator[str]:
        """Words of a text and its special strings."""
        at = 0
        for m in self.cut.finditer(text) if "<|" in text else ():
            yield from self.words.findall(self.normal(text[at : m.start()]))
            yield m[0]
            at = m.end()
        yield from self.words.findall(self.normal(text[at:] if at else text))

    def totals(self, text: str) -> list[int]:
        """Tokens after each piece between spaces, or special string, of the normalized text, from 0."""
        if "<|" not in text:
            return list(accumulate(map(self.__getitem__, self.normal(text).split(" ")), initial=0))
        counts, at = [], 0
        for m in self.cut.finditer(text):
            counts += [*map(self.__getitem__, self.normal(text[at : m.start()]).split(" ")), 1]
            at = m.end()
        counts += map(self.__getitem__, self.normal(text[at:]).split(" "))
        return list(accumulate(counts, initial=0))


def read_spec(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def token_counts(docs: DataFrame, spec: dict, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and pieces_in_limit for every row of docs.

    n_tokens: tokens of the whole text, without begin, end or added special tokens; a special string inside a text is one
    token. pieces_in_limit: how many leading pieces between spaces of the normalized text hold at most limit tokens, from
    the same prefix counts. A null text is an empty one. Repeated rows stay repeated, an empty table gives an
    empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, fit = [], []
            for t in texts:
                totals = counter.totals(t)
                n.append(totals[-1])
                fit.append(bisect_right(totals, limit) - 1)
            columns = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n]), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "pieces_in_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, pieces_in_limit long")


def token_prefixes(docs: DataFrame, spec: dict) -> DataFrame:
    """(doc_id, word, word_no, before, counts): a row for each word or special string of each text.

    before: tokens of all words before it; counts[k]: tokens of its first k characters, as if the text ended there. So the
    count of any prefix is before + counts[k], and truncation or budget questions are look-ups in this table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(shared.value)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = list(counter.parts(text or ""))
                counts = [[*[0] * len(w), 1] if w in counter.special else counter.word_counts(w) for w in parts]
                before = list(accumulate((c[-1] for c in counts), initial=0))[:-1]
                columns = [pa.array([doc_id] * len(parts), pa.int64()), pa.array(parts, pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(before, pa.int64()), pa.array(counts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "word", "word_no", "before", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, word string, word_no long, before long, counts array<int>")
