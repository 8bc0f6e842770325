"""Static range asymmetric numeral system over 16-bit token ids.

One frequency table (scaled to 2**16) is shared by the blocks of a segment.
Each block interleaves ``LANES`` coder states; a block's initial states and
the place of its words are its checkpoint, and a CRC-32 of its ids its
checksum, so any set of blocks can be decoded alone. All blocks of a
segment advance together in numpy, one id for each lane and step.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 16
TOTAL = 1 << SCALE
LOW = 1 << 16
LANES = 32
BLOCK_IDS = LANES * 512
MAGIC = b"SPWRANS1"
_HEAD = struct.Struct("<8sQQIIII")


def scaled(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols ascending, frequencies with sum 2**16, each at least 1)."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    c = counts[symbols].astype(np.float64)
    f = np.maximum(1, np.floor(c * TOTAL / c.sum())).astype(np.int64)
    over = int(f.sum()) - TOTAL
    if over < 0:
        f[np.argmax(c)] -= over
    while over > 0:  # take from the most frequent, which it costs least
        order = np.argsort(-f, kind="stable")
        take = np.minimum(f[order] - 1, np.maximum(1, f[order] >> 3))
        used = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
        f[order] -= used
        over -= int(used.sum())
    return symbols.astype(np.uint16), f.astype(np.uint32)


def encode(ids: np.ndarray) -> bytes:
    """Segment image of uint16 ids (one at least)."""
    n = len(ids)
    symbols, freq = scaled(ids)
    table_f = np.zeros(1 << 16, np.uint64)
    table_c = np.zeros(1 << 16, np.uint64)
    table_f[symbols] = freq
    table_c[symbols] = np.cumsum(freq) - freq
    blocks = -(-n // BLOCK_IDS)
    padded = np.full(blocks * BLOCK_IDS, symbols[0], np.uint16)
    padded[:n] = ids
    steps = BLOCK_IDS // LANES
    rows = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, -1))
    words = np.zeros(rows.shape, np.uint16)
    sent = np.zeros(rows.shape, bool)
    x = np.full(rows.shape[1], LOW, np.uint64)
    shift, low = np.uint64(SCALE), np.uint64(0xFFFF)
    for t in range(steps - 1, -1, -1):
        s = rows[t]
        f = table_f[s]
        full = x >= (f << shift)
        words[t] = x & low
        sent[t] = full
        x = np.where(full, x >> shift, x)
        q = x // f
        x = (q << shift) + (x - q * f) + table_c[s]
    by_block = lambda a: a.reshape(steps, blocks, LANES).transpose(1, 0, 2).reshape(blocks, -1)
    words, sent = by_block(words), by_block(sent)
    sums = np.array([zlib.crc32(ids[b * BLOCK_IDS:(b + 1) * BLOCK_IDS].astype("<u2").tobytes())
                     for b in range(blocks)], "<u4")
    table = zlib.compress(symbols.astype("<u2").tobytes() + (freq - 1).astype("<u2").tobytes(), 6)
    body = b"".join([table, sent.sum(axis=1).astype("<u4").tobytes(), sums.tobytes(),
                     x.astype("<u4").tobytes(), words[sent].astype("<u2").tobytes()])
    return _HEAD.pack(MAGIC, n, len(body), blocks, len(symbols), len(table), zlib.crc32(body)) + body


def decode(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first..last (all by default); raises ValueError on a damaged image."""
    magic, n, size, blocks, n_symbols, n_table, crc = _HEAD.unpack_from(image)
    body = memoryview(image)[_HEAD.size:_HEAD.size + size]
    if magic != MAGIC or len(body) != size or first == 0 and last is None and zlib.crc32(body) != crc:
        raise ValueError("not a whole segment")
    raw = zlib.decompress(body[:n_table])
    symbols = np.frombuffer(raw, "<u2", n_symbols)
    freq = np.frombuffer(raw, "<u2", n_symbols, 2 * n_symbols).astype(np.uint64) + np.uint64(1)
    at = n_table
    n_words = np.frombuffer(body, "<u4", blocks, at).astype(np.int64)
    sums = np.frombuffer(body, "<u4", blocks, at + 4 * blocks)
    states = np.frombuffer(body, "<u4", blocks * LANES, at + 8 * blocks).astype(np.uint64).reshape(blocks, LANES)
    words = np.frombuffer(body, "<u2", -1, at + 8 * blocks + 4 * blocks * LANES)
    last = blocks if last is None else min(last, blocks)
    ends = np.cumsum(n_words)
    at = (ends - n_words)[first:last]
    slot_symbol = np.repeat(symbols, freq.astype(np.int64))
    slot_f = np.repeat(freq, freq.astype(np.int64))
    slot_off = np.arange(TOTAL, dtype=np.uint64) - np.repeat(np.cumsum(freq) - freq, freq.astype(np.int64))
    words = np.concatenate([words, np.zeros(1, np.uint16)]).astype(np.uint64)
    x = states[first:last].copy()
    steps = BLOCK_IDS // LANES
    out = np.empty((steps, last - first, LANES), np.uint16)
    shift, low = np.uint64(SCALE), np.uint64(0xFFFF)
    for t in range(steps):
        slot = x & low
        out[t] = slot_symbol[slot]
        x = slot_f[slot] * (x >> shift) + slot_off[slot]
        need = x < LOW
        rank = np.cumsum(need, axis=1)
        place = np.where(need, at[:, None] + rank - 1, len(words) - 1)
        x = np.where(need, (x << shift) | words[place], x)
        at = at + rank[:, -1]
    ids = out.transpose(1, 0, 2).reshape(-1)[:max(0, min(n, last * BLOCK_IDS) - first * BLOCK_IDS)]
    for b in range(first, last):
        part = ids[(b - first) * BLOCK_IDS:(b - first + 1) * BLOCK_IDS]
        if zlib.crc32(part.astype("<u2").tobytes()) != sums[b]:
            raise ValueError(f"block {b} is damaged")
    return ids
