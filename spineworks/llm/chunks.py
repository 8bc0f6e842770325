"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the bytes of a text. A chunk ends at the end of
a word where the top bits of the hash are zero, so cuts depend on the 32 bytes
before them alone and an insertion moves only the cuts near it. A word of more
than ``LONG_WORD`` bytes (text without spaces) is cut into short words in the
same way, at borders of characters, and at ``LARGEST`` bytes at the latest.

Chunks are short, so single ones are known from unrelated texts. What is
compared are runs: from each chunk on the shortest run of neighbouring chunks
that reaches ``min_words`` words, by 128-bit digest. The first place of a run
(the smallest doc_id, then the smallest offset) keeps it, the bytes of all
later ones go. So what goes stood, chunk next to chunk and ``min_words`` words
long or longer, in one earlier place; shorter repeats are common phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spineworks.operators.relations import split_by_bitmap

from . import sparse_suffixes
from .common import document_order, map_arrow, stage, text_slices, word_spans

#: A word end is a cut with probability 2**-CUT_BITS.
CUT_BITS = 2
#: Repeated runs shorter than this many words stay.
MIN_WORDS = 16
#: Bytes of a word from which it is cut, and of its parts at most; a border has probability 1 in 8.
LONG_WORD, LARGEST = 64, 1_024
WINDOW = 32
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_DIGEST = np.dtype([("hi", ">i8"), ("lo", ">i8")])


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Gear hash h = 2h + G[byte] (mod 2**32) after each byte, anew for each row."""
    h = GEAR[data]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    width = 1
    while width < WINDOW:  # windows of doubled width
        back = np.zeros_like(h)
        back[width:] = h[:-width] << np.uint32(width)
        back[place < width] = 0
        h = h + back
        width *= 2
    return h


def _split_long(data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with those of more than ``LONG_WORD`` bytes cut into parts."""
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if not len(long):
        return starts, ends
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[long]] = 1
    inside[ends[long] - 1] -= 1  # a border at the word's own end is none
    inside = np.cumsum(inside[:-1]).astype(bool)
    border = inside.copy()
    border[:-1] &= data[1:] & 0xC0 != 0x80
    at = np.flatnonzero(border & (h >> np.uint32(16) & np.uint32(7) == 0)) + 1
    starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
    more = []
    for i in np.flatnonzero(ends - starts > LARGEST):
        cuts = np.arange(starts[i] + LARGEST, ends[i], LARGEST)
        for _ in range(3):  # on to the next character
            cuts += data[np.minimum(cuts, len(data) - 1)] & 0xC0 == 0x80
        more.append(cuts[cuts < ends[i]])
    if more:
        at = np.concatenate(more)
        starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
    return starts, ends


def cut(data: np.ndarray, offsets: np.ndarray, cut_bits: int = CUT_BITS):
    """Chunks of all rows: (begin byte, end byte, words, first), ``first[d]:first[d+1]`` being those of row d."""
    starts, ends, _ = word_spans(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(len(offsets), np.int64)
    h = gear(data, offsets)
    starts, ends = _split_long(data, h, starts, ends)
    first = np.searchsorted(starts, offsets)
    last = h[ends - 1] >> np.uint32(32 - cut_bits) == 0
    last[first[1:][np.diff(first) > 0] - 1] = True  # a row's last word ends a chunk
    stop = np.flatnonzero(last)
    begin = np.concatenate([[0], stop[:-1] + 1])
    return starts[begin], ends[stop], stop - begin + 1, np.searchsorted(stop, first)


def runs(words: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first chunk, last chunk, row): from each chunk on the shortest run of ``min_words`` words inside the row."""
    total = np.concatenate([[0], np.cumsum(words)])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.searchsorted(total, total[:-1] + min_words, "left")
    begin = np.flatnonzero(end <= first[1:][row])
    return begin, end[begin] - 1, row[begin]


def _run_rows(cut_bits: int, min_words: int):
    """Batches (d, tie, text) to runs (digest in two longs, d, tie, start, size); see ``first_of_equal``."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                a, b, words, first = cut(data, offsets, cut_bits)
                begin, end, row = runs(words, first, min_words)
                if not len(begin):
                    continue
                raw, start, stop = data.tobytes(), a[begin], b[end]
                digests = b"".join([xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(start.tolist(), stop.tolist())])
                found = np.frombuffer(digests, _DIGEST)
                d, tie = (rows.column(i).to_numpy()[row] for i in (0, 1))
                parts.append((found["hi"].astype(np.int64), found["lo"].astype(np.int64), d, tie, start - offsets[row],
                              stop - start))
                held += len(begin)
                if held >= sparse_suffixes.MEET:
                    yield from sparse_suffixes.first_of_equal(parts, 0)
                    parts, held = [], 0
        if held:
            yield from sparse_suffixes.first_of_equal(parts, 0)
    return find


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (.., text, spots) to (.., text without the spots, starts, ends, words, removed_words)."""
    for batch in batches:
        for rows, data, offsets in text_slices(batch, "text"):
            n, text, spots = rows.num_rows, rows.column(rows.num_columns - 2), rows.column(rows.num_columns - 1)
            lists = spots.fill_null([])
            flat, at = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            row = np.repeat(np.arange(n), np.diff(at))
            start = flat.field("start").to_numpy(zero_copy_only=False) + offsets[row]
            a, b = (sparse_suffixes.union(start, start + flat.field("size").to_numpy(zero_copy_only=False))
                    if len(start) else (start, start))
            step = np.zeros(len(data) + 1, np.int64)
            np.add.at(step, a, 1)
            np.add.at(step, b, -1)
            stays = np.cumsum(step[:-1]) == 0
            kept = data[stays]
            ends = np.concatenate([[0], np.cumsum(stays)])[offsets]
            new = pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes()))
            new = pc.if_else(text.is_valid(), new, pa.scalar(None, pa.string()))
            words, left = (np.diff(word_spans(x, o)[2]) for x, o in ((data, offsets), (kept, ends)))
            where = np.searchsorted(offsets, a, "right") - 1
            per_row = pa.array(np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n))]).astype(np.int32))
            spans = [pa.ListArray.from_arrays(per_row, pa.array((x - offsets[where]).astype(np.int64))) for x in (a, b)]
            yield pa.record_batch([*[rows.column(i) for i in range(rows.num_columns - 2)], new, *spans,
                                   pa.array(words.astype(np.int64)), pa.array((words - left).astype(np.int64))],
                                  [*rows.schema.names[:-2], "text", "starts", "ends", "words", "removed_words"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                     cut_bits: int = CUT_BITS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, carried, text, starts, ends, words, removed_words), one for each row.

    text is what stays, starts and ends are the byte runs that went. A run is
    a repeat if it also starts earlier: in a smaller doc_id, or before it in
    the same text. Null ids come last; different texts of one id, or without
    id, are different documents in the order of a hash of theirs. Rows equal
    in id and text count as one document and do not remove each other's runs.
    A null text stays null; empty texts have no words. carried is a struct of
    the columns named in ``keep``, absent without any. Empty input gives an
    empty result.

    Runs cross one shuffle, as 16 bytes and a place; equal runs of one task's
    input are one row there, so a passage in very many documents is few rows.
    Texts without a repeat are never shuffled: a bitmap of the touched
    documents, of bounded size, lets the others pass.
    """
    text = F.col(text_col).cast("string")
    d, tie = document_order(docs, id_col, F.coalesce(text, F.lit("")))
    found = map_arrow(docs.select(d, tie, text.alias("text")), _run_rows(cut_bits, min_words), sparse_suffixes.SCHEMA)
    same = Window.partitionBy("gram", "context", "removed").orderBy("d", "tie", "start")
    repeats = found.withColumn("rank", F.rank().over(same)).where("removed or rank > 1")
    # equal keys of equal documents: their texts are equal, so their spots are
    spots = stage(repeats.groupBy("d", "tie").agg(F.collect_list(F.struct("start", "size")).alias("spots"))
                  .withColumn("spot_key", F.xxhash64("d", "tie")), "repeats")
    carried = [F.struct(*keep).alias("carried")] if keep else []
    rows = docs.select(d, tie, F.col(id_col).cast("long").alias("doc_id"), *carried, text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("d", "tie"))
    whole, touched = split_by_bitmap(rows, "key", spots, "spot_key")
    none = F.lit(None).cast(spots.schema["spots"].dataType).alias("spots")
    columns = ["doc_id", *(["carried"] if keep else []), "text"]
    out = whole.select(*columns, none).unionByName(touched.join(spots, ["d", "tie"], "left").select(*columns, "spots"))
    kept = f", carried {out.schema['carried'].dataType.simpleString()}" if keep else ""
    return map_arrow(out, _rewritten, f"doc_id long{kept}, text string, starts array<long>, ends array<long>, "
                     "words long, removed_words long")
