"""Language-model scoring by cross-entropy difference.

Two matched bigram models share one vocabulary, the token ids of a public
tokenizer. The background model counts all documents; its bigram estimates are
interpolated with add-one unigrams. The target model counts the target
documents and falls back on the background model where it has seen little
(Dirichlet prior), so both spread their mass over unseen tokens alike and a
document without a leaning scores about 0 whatever the sizes of the two. Every
token and every bigram has a cell of its own, so counts are exact at any size.
They are written as a table; blocks of documents fetch the counts of the cells
they hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spineworks.operators.relations import split_by_bitmap

from .common import map_arrow, stage
from .tokens import encoded_rows

#: Weight of the background's bigram estimate.
BIGRAM_WEIGHT = 0.6
#: Tokens that the background model counts for in the target model: in all, and after one token.
PRIOR, PRIOR_AFTER = 50_000, 50
VOCABULARY = 1 << 16
#: Size of the default vocabulary, and its bigrams' cells.
SIZE = 50_257
CELLS = SIZE * SIZE
#: Tokens after which a block of documents ends, tokens scored at once, and rows of one Arrow batch.
BLOCK_TOKENS = 1 << 21
SLICE_TOKENS = 1 << 18
BATCH_ROWS = 1 << 16
#: Bytes of a row group of the written tokens, which a task holds in memory.
ROW_GROUP = 16 << 20


def _cells(ids: np.ndarray, size: int = SIZE) -> np.ndarray:
    """One number for each pair of neighbours, different pairs having different ones."""
    return ids[:-1].astype(np.int64) * size + ids[1:]


def _inside(ends: np.ndarray) -> np.ndarray:
    """Whether two neighbours stand in one document; documents end before ``ends``."""
    same = np.ones(max(int(ends[-1]) - 1, 0), bool)
    same[ends[:-1] - 1] = False
    return same


def _encode(vocabulary: str, end_id: int, block_tokens: int):
    """(block, model, doc_id, tokens) of rows (doc_id, text, model); a block holds rows of one task only."""
    def run(batches):
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            at = 0
            for ids, tokens in encoded_rows([batch], vocabulary, end_id):
                model = batch.column(batch.schema.get_field_index("model")).slice(at, len(tokens))
                at += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), block)), model, ids,
                                                  pa.array(tokens, pa.binary())], ["block", "model", "doc_id", "tokens"])
                held += sum(map(len, tokens)) // 2
                if held >= block_tokens:
                    block, held = block + 1, 0
    return run


def _count(size: int, block_tokens: int):
    """(cell, block, background, target) of rows (block, model, tokens): tokens at 0..65535, bigrams after them."""
    def counted(block, model, raw):
        ids = np.frombuffer(b"".join(raw), "<u2")
        single = np.bincount(ids)
        same = _inside(np.cumsum([len(t) // 2 for t in raw]))
        pairs, n = np.unique(_cells(ids, size)[same], return_counts=True)
        cell = np.concatenate([np.flatnonzero(single), VOCABULARY + pairs])
        n = np.concatenate([single[single > 0], n])
        for i in range(0, len(cell), BATCH_ROWS):
            part, none = n[i:i + BATCH_ROWS], np.zeros(len(n[i:i + BATCH_ROWS]), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[i:i + BATCH_ROWS]), pa.array(np.full(len(part), block)),
                 pa.array(none if model else part), pa.array(part if model else none)],
                ["cell", "block", "background", "target"])

    def run(batches):
        own, raw, held = None, [], 0
        for batch in batches:
            for block, model, tokens in zip(*[c.to_pylist() for c in batch.columns]):
                if raw and (own != (block, model) or held >= 2 * block_tokens):
                    yield from counted(*own, raw)
                    raw, held = [], 0
                own, held = (block, model), held + len(tokens)
                raw.append(tokens)
        if raw:
            yield from counted(*own, raw)
    return run


def _background(own: np.ndarray, pair: np.ndarray, total: float, size: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each token after the one before it, of each token alone), from their counts."""
    single = (own + 1.0) / (total + size)
    before = own[:-1]
    p = single.copy()
    p[1:] = np.where(before > 0, BIGRAM_WEIGHT * pair / np.maximum(before, 1) + (1 - BIGRAM_WEIGHT) * single[1:], single[1:])
    p[starts] = single[starts]  # a document's first token has none before it
    return p, single


def _target(own: np.ndarray, pair: np.ndarray, total: float, background: np.ndarray, single: np.ndarray,
            starts: np.ndarray) -> np.ndarray:
    """Probability of each token in the target model, with the background's as prior."""
    p = np.empty(len(own))
    p[1:] = (pair + PRIOR_AFTER * background[1:]) / (own[:-1] + PRIOR_AFTER)
    p[starts] = (own[starts] + PRIOR * single[starts]) / (total + PRIOR)
    return p


def losses(ids: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """-log p of each token of a document in the background model, from a table of all cells' counts."""
    return -np.log(_background(table[ids], table[VOCABULARY + _cells(ids, size)], table[:VOCABULARY].sum(dtype=float), size,
                               np.array([0]))[0])


def _score(size: int, totals: tuple[int, int]):
    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        cell, at = np.unique(counts.column("cell").to_numpy(), return_index=True)
        table = [counts.column(c).to_numpy()[at].astype(float) for c in ("target", "background")]
        tokens = rows.column("tokens").to_pylist()
        n = np.array([len(t) // 2 for t in tokens])
        means, row = [[], []], 0
        ends = np.cumsum(n)
        while row < len(n):
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] - n[row] + SLICE_TOKENS, "right")))
            ids = np.frombuffer(b"".join(tokens[row:stop]), "<u2")
            starts = np.cumsum(n[row:stop]) - n[row:stop]
            own = np.searchsorted(cell, ids.astype(np.int64))
            pair = np.zeros(max(len(ids) - 1, 0), np.int64)
            same = _inside(np.cumsum(n[row:stop]))
            pair[same] = np.searchsorted(cell, VOCABULARY + _cells(ids, size)[same])  # the others are not used
            near, wide = table
            base, single = _background(wide[own], wide[pair], totals[1], size, starts)
            for mean, p in zip(means, (_target(near[own], near[pair], totals[0], base, single, starts), base)):
                mean.append(np.add.reduceat(-np.log(p), starts) / n[row:stop])
            row = stop
        a, b = (np.concatenate(m) if m else np.zeros(0) for m in means)
        return pa.table([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(a - b)],
                        ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])
    return run


def score(docs: DataFrame, target: DataFrame, vocabulary: str, end_id: int = 50_256, size: int = SIZE,
          id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference), one for each row of ``docs``.

    Losses are means over a document's tokens, the end included; difference
    is target_loss - background_loss, lower being nearer to the target.
    Null and empty texts are the end token alone. ``target`` is a table of
    the same columns, or of ids alone: those of the target's rows in
    ``docs``. Where it is empty its model is the background's.

    Each text is encoded once and written. Its block's cells are summed
    before any shuffle, so a hot bigram has one row for each block, and only
    the two models' numbers of tokens go through the driver.
    """
    pick = lambda t, model: t.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                                     F.lit(model).alias("model"))
    own = text_col in target.columns
    texts = pick(docs, 0).unionByName(pick(target, 1)) if own else pick(docs, 0)
    tokens = stage(map_arrow(texts, _encode(vocabulary, end_id, block_tokens),
                             "block long, model int, doc_id long, tokens binary"), "tokens", **{"parquet.block.size": ROW_GROUP})
    counted = tokens.select("block", "model", "tokens")
    local = map_arrow(counted, _count(size, block_tokens), "cell long, block long, background long, target long")
    if not own:  # a model needs no blocks
        ids = target.select(F.col(id_col).cast("long").alias("target_id"))
        _, possible = split_by_bitmap(tokens, "doc_id", ids, "target_id")  # the other texts are not shuffled for it
        near = possible.join(ids, F.col("doc_id") == F.col("target_id"), "left_semi").select(
            F.lit(-1).cast("long").alias("block"), F.lit(1).alias("model"), "tokens")
        local = local.unionByName(map_arrow(near, _count(size, block_tokens), "cell long, block long, background long, target long"))
    local = stage(local, "local-counts")
    counts = stage(local.groupBy("cell").agg(F.sum("background").alias("background"), F.sum("target").alias("target")), "counts")
    total = counts.where(F.col("cell") < VOCABULARY).agg(F.sum("target"), F.sum("background")).first()
    wanted = local.where("background > 0").select("cell", "block").join(counts, "cell")
    return tokens.where("model = 0").select("block", "doc_id", "tokens").groupBy("block").cogroup(
        wanted.groupBy("block")).applyInArrow(
        _score(size, tuple(t or 0 for t in total)),
        "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id) of documents labelled quality 1 and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
