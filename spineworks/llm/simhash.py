"""SimHash near-duplicates by the generalised pigeonhole principle.

``fingerprints`` maps each text to 64 bits. ``linked`` finds all pairs of
distinct fingerprints within ``distance`` bits: the bits are grouped into
partitions of correlated bits, each partition i gets its own threshold t_i
with sum(t_i) = distance - partitions + 1 (a threshold of -1 leaves the
partition out), and any two fingerprints within ``distance`` differ in at
most t_i bits in some partition i. The thresholds minimise, by dynamic
programming, the estimated probes plus candidates. A probe meets the
fingerprints of its bucket, and each meeting is verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spineworks.operators.relations import split_by_bitmap

from .common import LOWER, WORD_BYTES, map_arrow, stage, text_slices, word_spans
from .components import components, forest

BITS = 64
#: Fingerprints of one bucket that a task holds at once; larger buckets are cut into blocks.
BLOCK = 4096
#: Cost of checking one candidate against that of moving one row.
CHECK_COST = 0.01
#: Candidate pairs checked in one numpy step.
SLAB = 1 << 20


def _shingle_hashes(data, offsets, width: int):
    """(hashes, first): XXH64 (seed 42) of each row's shingles."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    inside = WORD_BYTES[data]
    # one space after each word, so that a shingle is one slice of the compact text
    lengths = ends - starts
    new_starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] if len(starts) else starts
    compact = np.full(int(lengths.sum() + len(lengths)), 0x20, np.uint8)
    mask = np.ones(len(compact), bool)
    mask[new_starts + lengths] = False
    compact[mask] = data[inside]
    text, digest = compact.tobytes(), xxhash.xxh64_digest
    n_words = np.diff(first)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    shingle_first = np.concatenate([[0], np.cumsum(n)])
    index = np.arange(shingle_first[-1]) - np.repeat(shingle_first[:-1] - first[:-1], n)
    last = np.minimum(index + width, np.repeat(first[1:], n)) - 1
    begin, end = new_starts[index].tolist(), (new_starts[last] + lengths[last]).tolist()
    raw = b"".join([digest(text[i:j], 42) for i, j in zip(begin, end)])
    return np.frombuffer(raw, ">u8").astype(np.uint64), shingle_first


def fingerprint_batch(data, offsets, width: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each row."""
    hashes, first = _shingle_hashes(data, offsets, width)
    out = np.zeros(len(offsets) - 1, np.uint64)
    n = np.diff(first)
    rows = np.flatnonzero(n)
    if len(rows):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, first[rows], axis=0, dtype=np.int32)
        major = (2 * sums > n[rows, None]).astype(np.uint8)
        out[rows] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): the SimHash of each row's word shingles, as a signed long.

    Null or wordless text: 0. Fewer than ``width`` words: the one shorter
    shingle. Repeated shingles count each time. Whole texts of any length;
    one output row for each input row, null ids included.
    """
    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                fp = fingerprint_batch(data, offsets, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(fp)],
                                                 ["doc_id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_arrow(src, run, "doc_id long, text_hash long, fp long")


# --- partitions and thresholds -------------------------------------------------

def _bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints that have both bits set, over all of them."""
    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.float64)
        cell = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(total.ravel()[cell].astype(np.int64))], ["cell", "n"])

    out = np.zeros(BITS * BITS)
    for r in map_arrow(fps, run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]  # 4096 cells at most
    return out.reshape(BITS, BITS)


def bit_groups(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of (nearly) equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            nxt = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            free.remove(nxt)
        groups.append(sorted(group))
    return groups


def _within(both: np.ndarray, n: int, group: list[int], most: int) -> np.ndarray:
    """P(two fingerprints differ in at most r bits of the group) for r = 0..most, bits taken as independent."""
    p = np.diag(both)[group] / max(n, 1)
    law = np.zeros(most + 1)
    law[0] = 1
    for d in 2 * p * (1 - p):
        law[1:] = law[1:] * (1 - d) + law[:-1] * d
        law[0] *= 1 - d
    return np.cumsum(law)


def _variants(bits: int, radius: int) -> int:
    total, term = 0, 1
    for r in range(radius + 1):
        total += term
        term = term * (bits - r) // (r + 1)
    return total


def allocate(pairs: list[np.ndarray], sizes: list[int], n: int, distance: int) -> tuple[list[int], float]:
    """Thresholds by dynamic programming; ``pairs[i][t]`` are the candidates at threshold t."""
    parts, need = len(sizes), distance - len(sizes) + 1
    cost = lambda i, t: 0.0 if t < 0 else n * (1 + _variants(sizes[i], t)) + CHECK_COST * pairs[i][t]
    best = {0: (0.0, [])}
    for i in range(parts):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t in range(-1, distance + 1):
                v = (c + cost(i, t), [*ts, t])
                if total + t not in nxt or v < nxt[total + t]:
                    nxt[total + t] = v
        best = nxt
    return best[need][1], best[need][0]


def _mask(group: list[int]) -> int:
    return sum(1 << b for b in group)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def plan(fps: DataFrame, n: int, distance: int) -> tuple[list[tuple[int, int]], DataFrame]:
    """[(partition mask, threshold)] and the buckets (part, key, n) above BLOCK fingerprints."""
    both = _bit_counts(fps)
    model = {}
    for parts in range(2, distance + 2):
        groups = bit_groups(both, n, parts)
        laws = [_within(both, n, g, distance) for g in groups]
        _, c = allocate([n * n * law for law in laws], [len(g) for g in groups], n, distance)
        model[parts] = (c, groups, laws)
    _, groups, laws = min(model.values(), key=lambda x: x[0])
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("part"),
                                        F.col("fp").bitwiseAND(F.lit(_signed(_mask(g)))).alias("key"))
                               for i, g in enumerate(groups)])).alias("k")
    buckets = stage(fps.select(keys).groupBy("k.part", "k.key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    extra = {r["part"]: float(r["s"]) for r in
             buckets.groupBy("part").agg(F.sum(F.expr("cast(n as double) * n - n")).alias("s")).collect()}
    pairs = [(n + extra.get(i, 0.0)) * law / law[0] for i, law in enumerate(laws)]
    thresholds, _ = allocate(pairs, [len(g) for g in groups], n, distance)
    return [(_mask(g), t) for g, t in zip(groups, thresholds)], buckets.where(F.col("n") > BLOCK)


# --- probes --------------------------------------------------------------------

def _flips(mask: int, radius: int) -> np.ndarray:
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return np.array([sum(c) for r in range(radius + 1) for c in combinations(bits, r)], np.uint64)


def _probe_rows(parts: list[tuple[int, int]]):
    flips = {i: _flips(m, t) for i, (m, t) in enumerate(parts) if t >= 0}

    def run(batches):
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint64)
            for i, flip in flips.items():
                for at in range(0, len(fp), max(1, (1 << 18) // len(flip))):
                    f = fp[at:at + max(1, (1 << 18) // len(flip))]
                    home = f & np.uint64(parts[i][0])
                    key = np.concatenate([home, (home[:, None] ^ flip[None, :]).ravel()])
                    full = np.concatenate([f, np.repeat(f, len(flip))])
                    kind = (np.arange(len(key)) >= len(f)).astype(np.int8)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), i, np.int8)), pa.array(key.view(np.int64)),
                         pa.array(kind), pa.array(full.view(np.int64))], ["part", "key", "kind", "fp"])
    return run


def _meet(distance: int):
    """Probes against the fingerprints of their bucket, over rows sorted by (part, key, block, kind).

    Emits a spanning forest of each batch's verified links, never all pairs
    of a bucket; holds one bucket block at most beside the batch.
    """
    def run(batches):
        carry = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            part, key, block, kind, fp = (np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
            part = np.concatenate([carry[0], part.astype(np.int64)])
            key, block = np.concatenate([carry[1], key]), np.concatenate([carry[2], block.astype(np.int64)])
            kind = np.concatenate([np.zeros(len(carry[3]), np.int64), kind.astype(np.int64)])
            fp = np.concatenate([carry[3], fp])
            if not len(fp):
                continue
            change = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0) | (np.diff(block) != 0)) + 1
            first = np.concatenate([[0], change])
            size = np.diff(np.concatenate([first, [len(fp)]]))
            homes = np.add.reduceat(1 - kind, first)
            group = np.repeat(np.arange(len(first)), size)
            probe = np.flatnonzero(kind)
            n = homes[group[probe]]
            probe, n = probe[n > 0], n[n > 0]
            total = np.cumsum(n)
            found_a, found_b, at = [], [], 0
            while at < len(probe):
                done = total[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(total, done + SLAB, side="right")))
                m = n[at:end]
                p = np.repeat(probe[at:end], m)
                h = np.repeat(first[group[probe[at:end]]], m) + np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)
                x, y = fp[p], fp[h]
                ok = (np.bitwise_count((x ^ y).view(np.uint64)) <= distance) & (x != y)
                a, b = forest(x[ok], y[ok])
                found_a.append(a)
                found_b.append(b)
                at = end
            if found_a:
                a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            tail = slice(first[-1], first[-1] + homes[-1])
            carry = [part[tail], key[tail], block[tail], fp[tail]]
    return run


def linked(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links whose components are those of all fingerprint pairs within ``distance`` bits.

    ``fps`` has one column ``fp`` of distinct longs. Buckets above BLOCK
    fingerprints are cut into blocks that every probe of the bucket visits,
    so no task holds an unbounded bucket and none is dropped.
    """
    if not 0 <= distance < BITS:
        raise ValueError("distance must be in 0..63")
    n = fps.count()
    if n < 2 or distance == 0:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    parts, over = plan(fps, n, distance)
    rows = map_arrow(fps.select("fp"), _probe_rows(parts), "part byte, key long, kind byte, fp long")
    rows = rows.join(over.select("part", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")),
                     ["part", "key"], "left") if over.head(1) else rows.withColumn("blocks", F.lit(None).cast("int"))
    spread = (F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
              .when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
              .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = (rows.withColumn("block", F.explode(spread)) if over.head(1) else rows.withColumn("block", F.lit(0)))
    rows = rows.select("part", "key", "block", "kind", "fp").repartition("part", "key", "block")
    return map_arrow(rows.sortWithinPartitions("part", "key", "block", "kind"), _meet(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash, root), one row for each input row.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id
    reachable over links, the row's own included; null only if every
    document reached has a null id. text_hash: xxhash64 of the text; root:
    the class's smallest fingerprint, as a signed long. Repeated rows give repeated output rows.
    Empty input gives an empty result.
    """
    prints = stage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(linked(distinct.select("fp"), distance), "a", "b")
    rooted = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("v", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    lows = stage(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    classes = stage(rooted.join(lows, "root").select("fp", "component_id", "root"), "classes")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        "text_hash", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                width: int = 4, distance: int = 4) -> DataFrame:
    """Rows of ``docs``, all columns, one for each class: that of the smallest id (null ids last), then text hash."""
    found = stage(near_duplicates(docs, id_col, text_col, width, distance).select("doc_id", "text_hash", "root"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    best = stage(found.groupBy("root").agg(F.min(order).alias("b")).select(
        F.col("b.doc_id").alias("doc_id"), F.col("b.text_hash").alias("text_hash")).distinct(), "best")
    # only rows that some class drops, or that stand there more than once, have to meet their class
    rest = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).join(
        best.select(F.col("doc_id").alias("best_id"), F.col("text_hash").alias("best_hash")),
        F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_hash") == F.col("best_hash")), "left")
    stays = F.col("best_hash").isNotNull()
    doubtful = stage(rest.where(~stays | (F.col("rows") > 1)).select(
        "doc_id", "text_hash", stays.alias("stays"), F.xxhash64("doc_id", "text_hash").alias("pair")), "doubtful")
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"),
                      F.xxhash64(F.col(text_col).cast("string")).alias("own_hash"))
    row = row.withColumn("own_pair", F.xxhash64("own_id", "own_hash"))
    sure, possible = split_by_bitmap(row, "own_pair", doubtful, "pair")
    met = possible.join(doubtful, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    clear = met.where("stays is null").select("row")
    again = met.where("stays").dropDuplicates(["own_id", "own_hash"]).select("row")
    return sure.select("row").unionByName(clear).unionByName(again).select("row.*")
