"""Hierarchical multi-length packing of token ids into fixed windows.

Full windows of the largest context size are cut from long documents. Each
rest goes to the smallest tier that holds it. Tiers are packed from the
largest down: a window opens with a rest of its tier, its gap takes the
largest rests of shorter tiers that fit, and a rest is cut where none fits.
Each window is thus exactly as long as its tier, a power of two, and needs
no padding. The last rests of a task are cut into power-of-two sequences.
Windows of one tier form step groups of equal token totals.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokens import CACHE_PIECES, encoded_rows

#: Context sizes, ascending; the last is the window of long documents.
TIERS = (256, 512, 1024, 2048)
#: Tokens that a task packs at once.
ROUND_TOKENS = 1 << 20
#: Tokens of one training step.
STEP_TOKENS = 1 << 14

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, step_group long")


class Packer:
    """Packs the documents of one task, round by round; holds one round and under a window of rests."""

    def __init__(self, tiers: Sequence[int], step_tokens: int, first_id: int):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.next_id = self.first_id = first_id
        self.windows = {t: 0 for t in self.tiers}
        self.groups: dict[tuple[int, int], int] = {}
        self.docs: list[tuple] = []  # (doc_id, ids)
        self.rests: list[tuple[int, int, int]] = []  # (length, document, start), ascending
        self.pending = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append((doc_id, ids))
        d, n, top = len(self.docs) - 1, len(ids) // 2, self.tiers[-1]
        for start in range(0, n - top + 1, top):
            self._close(top, [(top, d, start)])
        if n % top:
            self.rests.append((n % top, d, n - n % top))
        self.pending += n

    def _close(self, tier: int, pieces: list[tuple[int, int, int]]) -> None:
        count = self.windows[tier]
        self.windows[tier] += 1
        group = (tier, count // max(1, self.step_tokens // tier))
        step = self.groups.setdefault(group, self.first_id + len(self.groups))
        at = 0
        for length, d, start in pieces:
            doc_id, ids = self.docs[d]
            part = np.frombuffer(ids, "<u2", length, 2 * start).astype("<u4")
            self.out.append((doc_id, start, length, zlib.crc32(part.tobytes()), len(ids) // 2,
                             self.next_id, at, tier, step))
            at += length
        self.next_id += 1

    def pack(self, last: bool) -> list[tuple]:
        """Pack what was added; the rests of an unfinished window wait unless this is the last round."""
        self.rests.sort()
        rests = self.rests
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, below = self.tiers[k], self.tiers[k - 1] if k else 0
            while rests and rests[-1][0] > below:
                pieces, gap = [rests.pop()], tier
                gap -= pieces[0][0]
                while gap and rests:
                    i = bisect_right(rests, (gap, len(self.docs), 0)) - 1
                    if i >= 0:
                        piece = rests.pop(i)
                    else:  # nothing fits: cut the longest of the shorter tiers, else the shortest rest
                        j = bisect_left(rests, (below + 1, -1, -1)) - 1
                        length, d, start = rests.pop(j if j >= 0 else 0)
                        piece = (gap, d, start)
                        insort(rests, (length - gap, d, start + gap))
                    pieces.append(piece)
                    gap -= piece[0]
                if gap:
                    return self._finish(pieces, last)
                self._close(tier, pieces)
        return self._finish([], last)

    def _finish(self, pieces: list[tuple[int, int, int]], last: bool) -> list[tuple]:
        if last:  # power-of-two sequences, the longest first
            total = sum(p[0] for p in pieces)
            while total:
                room = 1 << (total.bit_length() - 1)
                total -= room
                tier, head = next(t for t in self.tiers if t >= room), []
                while room:
                    length, d, start = pieces.pop(0)
                    cut = min(length, room)
                    head.append((cut, d, start))
                    if cut < length:
                        pieces.insert(0, (length - cut, d, start + cut))
                    room -= cut
                self._close(tier, head)
            pieces = []
        kept = sorted({p[1] for p in pieces})
        place = {d: i for i, d in enumerate(kept)}
        self.docs = [self.docs[d] for d in kept]
        self.rests = [(length, place[d], start) for length, d, start in pieces]
        self.pending = 0
        out, self.out = self.out, []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence.

    Columns as in ``SCHEMA``. Every id, the end id included, lies in exactly
    one piece; offsets run gapless from 0. Null and empty texts are the end
    id alone; repeated rows are documents of their own; null ids stay null.
    Sequence and step-group ids are unique over the table and the same in
    every run over the same input splits. Each task packs its own documents,
    so nothing is shuffled and no group of equal rows meets in one task.
    ``cache_pieces`` bounds the encoded pieces that a worker keeps.
    Empty input gives an empty result.
    """
    if any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers must be powers of two")

    def run(batches):
        from pyspark import TaskContext
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 32)
        for ids, tokens in encoded_rows(batches, vocabulary, end_id, cache_pieces):
            for doc_id, t in zip(ids.to_pylist(), tokens):
                packer.add(doc_id, t)
                if packer.pending >= ROUND_TOKENS:
                    if rows := packer.pack(False):
                        yield _batch(rows)
        if rows := packer.pack(True):
            yield _batch(rows)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, run, SCHEMA)
