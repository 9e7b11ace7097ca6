"""Words of Arrow text columns, split by byte tables: shared by the operators that count words inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 4 << 20  # bytes of text that are split at once; a longer text is a piece of its own


def _lower_table(separators: bytes) -> bytes:
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in separators:
        table[c] = 0x20
    return bytes(table)


#: A-Z in lower case, words end at ASCII white space.
WHITE = _lower_table(bytes((0x20, *range(0x09, 0x0E))))
#: A-Z in lower case, words are digits, a-z and all beyond ASCII.
ALPHANUMERIC = _lower_table(bytes(c for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c | 0x20 <= 0x7A and c >= 0x41)))


def pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about PIECE bytes of column `text`."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0), dtype=np.int64))
        at = 0
        while at < b.num_rows:
            past = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, past + PIECE, "right")))
            yield b.slice(at, to - at)
            at = to


def split_words(texts: pa.Array, table: bytes) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each text, all words in order); null and empty texts have none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    raw = texts.buffers()[2]
    data = bytes(memoryview(raw)[ends[0] : ends[-1]]).translate(table) if raw is not None else b""
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(plain)
    words = lists.flatten()
    real = np.asarray(pc.binary_length(words)) > 0
    before = np.concatenate([[0], np.cumsum(real)])
    bounds = np.asarray(lists.offsets)
    return np.diff(before[bounds - bounds[0]]), words.filter(pa.array(real))
