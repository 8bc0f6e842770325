"""128-bit keys of sequence prefixes, summed over parts of a sequence.

The key of a prefix is sum(digest_i * M^i) modulo the prime 2^61 - 1, in two
lanes with different M. Sums over parts of a sequence add up after one
multiplication, so a sequence may be cut anywhere between tasks, and a tail
that moves to other positions needs no new pass over its items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PRIME = (1 << 61) - 1
BASES = (0x1F83D9ABFB41BD6 % PRIME, 0x1BE0CD19137E217 % PRIME)
_P = np.uint64(PRIME)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b) -> np.ndarray:
    """a * b modulo the prime, for values below it."""
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    mid = a1 * b0 + a0 * b1
    high = (a1 * b1 << np.uint64(1)) + (mid >> np.uint64(30))
    return _fold(_fold(high + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31))) + _fold(a0 * b0))


def plus(a: np.ndarray, b) -> np.ndarray:
    return _fold(np.asarray(a, np.uint64) + np.asarray(b, np.uint64))


def minus(a: np.ndarray, b) -> np.ndarray:
    return _fold(np.asarray(a, np.uint64) + _P - np.asarray(b, np.uint64))


class Powers:
    """M^0, M^1, ... as far as asked for."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def __call__(self, exponents: np.ndarray) -> np.ndarray:
        while len(self.table) <= int(exponents.max(initial=0)):
            step = np.uint64(pow(self.base, len(self.table), PRIME))
            self.table = np.concatenate([self.table, times(self.table, step)])
        return self.table[exponents]


def _sums(x: np.ndarray) -> np.ndarray:
    """Running sums modulo the prime."""
    high = np.cumsum(x >> np.uint64(31))
    low = np.cumsum(x & np.uint64((1 << 31) - 1))
    return plus(times(_fold(high), np.uint64(1 << 31)), _fold(low))


def prefix_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (sequence, digest, chars) of a partition: (sequence, part, at, a, b, chars).

    ``at`` counts the sequence's rows in this partition from 1; a and b are
    its key lanes over them.
    """
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    powers = [Powers(b) for b in BASES]
    last, before, carry = None, 0, [np.uint64(0), np.uint64(0)]
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        seq = batch.column(0).to_numpy()
        raw = batch.column(1).cast(pa.binary(16))
        words = np.frombuffer(raw.buffers()[1], "<u8").reshape(-1, 2)[raw.offset:raw.offset + n]
        new = np.ones(n, bool)
        new[1:] = seq[1:] != seq[:-1]
        goes_on = last is not None and seq[0] == last
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        at = np.arange(n) - begin[group] + 1
        if goes_on:
            at[group == 0] += before
        lanes = []
        for lane in range(2):
            total = _sums(times(_fold(words[:, lane] >> np.uint64(3)), powers[lane](at)))
            base = np.concatenate([[np.uint64(0)], total])[begin]
            mine = minus(total, base[group])
            if goes_on:
                mine[group == 0] = plus(mine[group == 0], carry[lane])
            lanes.append(mine)
            carry[lane] = mine[-1]
        last, before = seq[-1], int(at[-1])
        yield pa.record_batch([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(at.astype(np.int64)),
                               *[pa.array(x.astype(np.int64)) for x in lanes], batch.column(2)],
                              ["sequence", "part", "at", "a", "b", "chars"])


def moved(whole, origin, offset, shift) -> list[np.ndarray]:
    """Lanes of offset + M^shift * (whole - origin); shift may be negative."""
    out = []
    for lane, base in enumerate(BASES):
        least = int(min(0, shift.min(initial=0)))
        table = np.array([pow(base, i, PRIME) for i in range(least, int(shift.max(initial=0)) + 1)], np.uint64)
        out.append(plus(times(minus(whole[lane], origin[lane]), table[shift - least]), offset[lane]))
    return out


def carried(n: int, a: int, b: int, more_n: int, more_a: int, more_b: int) -> tuple[int, int, int]:
    """(length, lanes) of a part (n, a, b) followed by another part."""
    return (n + more_n, (a + pow(BASES[0], n, PRIME) * more_a) % PRIME,
            (b + pow(BASES[1], n, PRIME) * more_b) % PRIME)
