"""Sampled suffixes of texts: a position for each window of bytes, chosen by the window's content alone.

Of the ``GRAM``-byte strings in a window of ``length`` bytes, the one of the
smallest hash (the leftmost of equals) is its anchor. Equal windows have equal
anchors, wherever they stand, so only suffixes at anchors need sorting: about
one byte in 32 for windows of 100. Consecutive windows with one anchor make
an entry: its context is all their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import text_slices

#: Bytes of the string that an anchor starts with.
GRAM = 32
#: Windows handled at once, and entries compared with each other inside a task.
PIECE, MEET = 1 << 20, 150_000
_PLACE = np.uint64((1 << 23) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:len(x) - (width - step)], x[width - step:])


def entries(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram, context, row, start, windows) of the texts' entries; start counts from the row's first byte."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    padded = np.concatenate([data, np.zeros(GRAM + 8, np.uint8)])
    words = np.ndarray((n + GRAM,), "<u8", padded.tobytes(), 0, (1,)).copy()  # eight bytes from each place on
    h = _mixed(words)
    h = _mixed(h[:-8] ^ _turned(h[8:], 1))
    h = _mixed(h[:-16] ^ _turned(h[16:], 3))[:n]
    least = _least((h & ~_PLACE) | np.arange(n, dtype=np.uint64), length - GRAM + 1)
    # windows that lie inside one row
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(int(sizes.sum())) - first[row] + offsets[:-1][row]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    anchor = (least[start] & _PLACE).astype(np.int64)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    windows = np.diff(new, append=len(start))
    anchor, row, start = anchor[new], row[new], start[new]
    end = start + windows + length - 1
    context = _mixed((anchor - start).astype(np.uint64) + np.uint64(1)) ^ windows.astype(np.uint64)
    for i in range(0, length + length - GRAM, 8):
        context = _mixed(context ^ words[np.minimum(start + i, end - 8)])
    return h[anchor].view(np.int64), context.view(np.int64), row, start - offsets[:-1][row], windows


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[pa.RecordBatch, int, tuple[np.ndarray, ...]]]:
    """(rows, bytes before the piece, entries) of a batch (.., text); a long text is cut into pieces.

    Neighbouring pieces share ``length`` - 1 bytes, so each window lies in one piece.
    """
    for rows, data, offsets in text_slices(batch, "text", PIECE):
        for at in range(0, max(len(data) - length + 1, 1), PIECE) if rows.num_rows == 1 else (0,):
            piece = data[at:at + PIECE + length - 1] if rows.num_rows == 1 else data
            ends = np.array([0, len(piece)]) if rows.num_rows == 1 else offsets
            yield rows, at, entries(piece, ends, length)


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


SCHEMA = "gram long, context long, d long, tie long, start long, size long, removed boolean"


def _rows(columns, removed: bool) -> pa.RecordBatch:
    return pa.record_batch([*[pa.array(np.ascontiguousarray(c, np.int64)) for c in columns],
                            pa.array(np.full(len(columns[0]), removed))],
                           ["gram", "context", "d", "tie", "start", "size", "removed"])


def first_of_equal(parts, more: int) -> Iterator[pa.RecordBatch]:
    """Of entries (gram, context, d, tie, start, size) with equal hashes the first (d, tie, start).

    The bytes of the others, ``size`` + ``more`` from ``start`` on, come as
    rows with ``removed`` set, as maximal runs of each document.
    """
    gram, context, d, tie, start, size = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, tie, d, context, gram))
    gram, context, d, tie, start, size = (x[order] for x in (gram, context, d, tie, start, size))
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (d != d[head]) | (tie != tie[head]) | (start != start[head])  # not a copy of the first one's own row
    yield _rows([x[new] for x in (gram, context, d, tie, start, size)], False)
    if later.any():
        gram, d, tie, start, size = (x[later] for x in (gram, d, tie, start, size))
        order = np.lexsort((start, tie, d))
        gram, d, tie, start, size = (x[order] for x in (gram, d, tie, start, size))
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (tie[1:] != tie[:-1])]))
        doc = np.repeat(np.arange(len(first)), np.diff(first, append=len(d)))
        end = start + size + more
        # the documents one behind the other, with room between them
        room = np.concatenate([[0], np.cumsum(np.maximum.reduceat(end, first) + 1)])
        a, b = union(start + room[doc], end + room[doc])
        doc = np.searchsorted(room, a, side="right") - 1
        yield _rows([gram[first][doc], a, d[first][doc], tie[first][doc], a - room[doc], b - a], True)


def sampled(length: int):
    """Function from batches (d, tie, text) to entries, of equal ones in one task's input only the first."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for rows, at, (gram, context, row, start, size) in _pieces(batch, length):
                d, tie = (rows.column(i).to_numpy() for i in (0, 1))
                parts.append((gram, context, d[row], tie[row], start + at, size))
                held += len(gram)
                if held >= MEET:
                    yield from first_of_equal(parts, length - 1)
                    parts, held = [], 0
        if held:
            yield from first_of_equal(parts, length - 1)
    return find
