"""Byte-level BPE by merge replay: one pass over the ranks merges every occurrence of a pair in all distinct pieces at once.

Each task gathers the distinct pieces of its texts. An inverted index leads from a merge rank to the positions of its pair;
ranks are taken in order, all positions of a rank are merged together, and only the pairs beside a merged one are looked
up again and put into the index. A piece is replayed once for a task, however often its texts hold it. One table of pieces
for the whole corpus would have to meet the texts again, which costs more shuffle than this operator may use; the README has
the figures.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

GAP, DEAD, NONE = -1, -2, 1 << 30
BATCH_BYTES = 3 << 20  # texts of about so many bytes are replayed together
CACHE_BYTES = 112 << 20  # bytes of parts and pieces that a task keeps before it starts anew


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """The pairs of a vocabulary: every split of a token into two tokens has the token's rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                    pairs[a << 32 | b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.byte_pairs = self.look_up(self.single[a], self.single[b])

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; NONE if the vocabulary lacks it or an end of a piece lies between."""
        if not len(self.keys):
            return np.full(len(a), NONE)
        key = (a << 32) | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Token ids of all pieces, none of them empty, one after another; where each piece's ids end."""
        raw = np.frombuffer(b"\0".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        tok = np.full(len(raw) + 2, GAP, np.int64)
        tok[1:-1] = self.single[raw]
        tok[np.cumsum(sizes + 1)[:-1]] = GAP
        nxt = np.arange(1, len(tok) + 1)
        prv = np.arange(-1, len(tok) - 1)
        rank = np.full(len(tok), NONE, np.int64)
        rank[1:-2] = self.byte_pairs[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        rank[(tok == GAP) | (np.append(tok[1:], GAP) == GAP)] = NONE
        index: dict[int, list[np.ndarray]] = {}
        ready: list[int] = []

        def post(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r < NONE], r[r < NONE]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.nonzero(np.diff(r))[0] + 1
            starts = [0, *cuts.tolist()]
            for k, i, j in zip(r[starts].tolist(), starts, [*starts[1:], len(at)], strict=True):
                if k not in index:
                    index[k] = []
                    heapq.heappush(ready, k)
                index[k].append(at[i:j])

        post(np.arange(len(tok) - 1))
        while ready:
            r = heapq.heappop(ready)
            at = np.concatenate(index.pop(r))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            if len(at) > 1:  # where a pair overlaps the next one of the same rank, every second one of the run merges
                start = np.concatenate([[True], nxt[at[:-1]] != at[1:]])
                within = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[within % 2 == 0]
            right = nxt[at]
            after = nxt[right]
            tok[at], tok[right] = r, DEAD
            nxt[at], prv[after] = after, at
            rank[right] = NONE
            before = prv[at]
            rank[at] = self.look_up(tok[at], tok[nxt[at]])
            rank[before] = self.look_up(tok[before], tok[at])
            post(np.concatenate([at, before]))
        alive = tok[1:-1][tok[1:-1] != DEAD]
        ends = np.nonzero(np.append(alive, GAP) == GAP)[0] - np.arange(len(pieces))
        return alive[alive != GAP].astype(np.int32), ends.tolist()


class Encoder:
    """Texts to token ids, as 32-bit integers in bytes. Keeps the ids of each distinct part between spaces, up to CACHE_BYTES."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.find = merges, regex.compile(pattern).findall
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, bytes] = {}  # pieces
        self.heads: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.wide: set[str] = set()
        self.held = 0  # about the bytes kept

    def learn(self, pieces: set[str]) -> None:
        """Replay the merges over all new pieces together."""
        if new := list(pieces.difference(self.known)):
            coded = [p.encode() for p in new]
            flat, ends = self.merges.replay(coded)
            raw, cuts = flat.tobytes(), [4 * e for e in ends]
            self.known.update(zip(new, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
            self.held += len(raw) + sum(map(len, coded)) + 180 * len(new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.

        A part is what stands between two spaces, with the space before it; a head is what stands before a text's first space.
        The pattern's pieces never reach over a space that has no white space beside it, so a part is split into pieces once
        and remembered. Texts with other spaces are split as a whole.
        """
        if self.held > CACHE_BYTES:
            self.reset()
        split = [t.split(" ") for t in texts]
        heads, tails = [p[0] for p in split], [p[1:] for p in split]
        single: list[tuple[dict[str, bytes], str, str]] = []
        several: list[tuple[dict[str, bytes], str, list[str]]] = []
        for known, space, new in ((self.heads, "", set(heads)), (self.parts, " ", set().union(*tails))):
            for x in new.difference(known):
                if x and not x[0].isspace() and not x[-1].isspace():
                    found = self.find(space + x)
                    if len(found) == 1:
                        single.append((known, x, found[0]))
                    else:
                        several.append((known, x, found))
                else:
                    known[x] = b""
                    self.wide.add(x)
                    self.held += 180 + 4 * len(x)
        whole = {i: self.find(texts[i]) for i, p in enumerate(split) if texts[i] and not self.wide.isdisjoint(p)} if self.wide else {}
        self.learn({x[2] for x in single}.union(*(x[2] for x in several), *whole.values()))
        ids = self.known.__getitem__
        for known, x, piece in single:
            known[x] = ids(piece)
            self.held += 160 + len(x)
        for known, x, found in several:
            raw = known[x] = b"".join(map(ids, found))
            self.held += 200 + 4 * len(x) + len(raw)
        head, part = self.heads.__getitem__, self.parts.__getitem__
        return [b"".join(map(ids, whole[i])) if i in whole else head(heads[i]) + b"".join(map(part, tails[i])) if texts[i] else b"" for i in range(len(texts))]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (doc_id, text) cut into slices of about BATCH_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // BATCH_BYTES
    for at in np.unique(group, return_index=True)[1].tolist():
        yield batch.slice(at, int((group == group[at]).sum()))


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids (array of int) for every row of docs.

    A text is split by pattern, each match is encoded by itself from the ranks, no special tokens exist, and the ids are
    decoded again. ids_sha256 is over the decimal ids joined by a space; decoded_sha256 over the decoded bytes. A null text
    is an empty one: no tokens, hashes of nothing. Repeated rows stay repeated, an empty table gives an empty result; other
    columns are ignored.
    """
    merges = docs.sparkSession.sparkContext.broadcast(Merges(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value, pattern)
        decimal, token = {r: str(r) for r in merges.value.bytes}.__getitem__, merges.value.bytes.__getitem__
        for part in (x for b in batches for x in _slices(b)):
            ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            n, said_sha, decoded_sha = [len(raw) // 4 for raw in ids], [], []
            for raw in ids:
                own = memoryview(raw).cast("i").tolist()
                said_sha.append(hashlib.sha256(" ".join(map(decimal, own)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(b"".join(map(token, own))).hexdigest())
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(said_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32), pa.int32())
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, text) from rows with doc_id and ids; null ids give a null text, ids that are no UTF-8 are replaced."""
    tokens = encoded.sparkSession.sparkContext.broadcast({r: t for t, r in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else b"".join(map(tokens.value.__getitem__, x)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
