"""Quality classifier by co-training of two views.

View one sees a document's content (byte shares, repetition), view two its
metadata (language, source, length). Each starts from a bounded sample of
labelled rows. Round after round each marks those of all unlabelled rows that
it is sure of, and the other learns from those marks. Both are then
calibrated on labelled rows that neither was fitted on, and their log odds
are added. Unlabelled rows stay on the executors: the metadata view learns
from counts by language, source, length and mark, the content view from sums
for its Newton steps. All marks of one source and class weigh as GROUP rows
at most, so a large source does not drown a small one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage, text_slices, word_spans

#: Labelled documents that the fit may use (those of smallest hashed id).
LABELLED = 12_000
ROUNDS = 4
#: Newton steps of the content view in a round.
STEPS = 3
#: A mark needs this probability.
SURE = 0.95
#: Weight, in rows, that the marks of one source and class have at most.
GROUP = 200
#: Penalties of the views' weights.
CONTENT_RIDGE, METADATA_RIDGE = 0.05, 2.0
#: Partial sums that reach the driver.
SUMS = 16
#: Every third labelled row calibrates.
HOLD_OUT = 3
LENGTHS = 24
FEATURES = 262
_MIX = np.random.default_rng(9).integers(1, 1 << 62, 256, dtype=np.int64)


def content_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 262 numbers for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    share = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    length = np.bincount(np.repeat(np.arange(n), words), ends - starts, n) / np.maximum(words, 1)
    same, distinct, ended = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(starts):
        # the place inside a word weighs its bytes
        place = np.arange(len(data)) - starts[np.maximum(np.searchsorted(starts, np.arange(len(data)), "right") - 1, 0)]
        total = np.concatenate([[0], np.cumsum(_MIX[data] * (2 * (place & 7) + 1))])
        word = total[ends] - total[starts]
        doc = np.repeat(np.arange(n), words)
        pair = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        same = np.bincount(doc[1:][pair], minlength=n) / np.maximum(words, 1)
        order = np.lexsort((word, doc))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(word[order]) != 0) | (np.diff(doc[order]) != 0)
        distinct = np.bincount(doc[order][new], minlength=n) / np.sqrt(np.maximum(words, 1))
        ended = np.bincount(doc[data[ends - 1] < 0x30], minlength=n) / np.maximum(words, 1)
    extra = np.stack([same, distinct / 10, ended, length / 10, np.log1p(words) / 10, (words == 0).astype(float)], axis=1)
    return np.hstack([np.sqrt(share), extra])


def length_class(n_chars: int | None) -> int:
    """Logarithmic length; nulls and negative ones have their own class."""
    return 0 if n_chars is None or n_chars < 0 else min(LENGTHS - 1, 1 + int(n_chars).bit_length())


def metadata_z(columns: list[list], model) -> np.ndarray:
    """Log odds by language, source and length class; values that the model has not met weigh nothing."""
    shift, tables = model
    return shift + sum(np.array([t.get(v, 0.0) for v in c], float) for c, t in zip(columns, tables))


def fit_metadata(columns: list[list], y: np.ndarray, weight: np.ndarray, sweeps: int = 60):
    """(shift, weights of each column's values) of the ridge-penalised loss, one column after another.

    A column's values exclude each other, so its Hessian is diagonal and the
    fit is linear in the number of values.
    """
    names = [{v: i for i, v in enumerate(dict.fromkeys(c))} for c in columns]
    codes = [np.array([n[v] for v in c], np.int64) for c, n in zip(columns, names)]
    names, codes = [{None: 0}, *names], [np.zeros(len(y), np.int64), *codes]
    w = [np.zeros(len(n)) for n in names]
    z = np.zeros(len(y))
    for _ in range(sweeps):
        most = 0.0
        for v, code in enumerate(codes):
            p, ridge = odds(z), METADATA_RIDGE if v else 1e-6
            g = np.bincount(code, weight * (p - y), len(w[v])) + ridge * w[v]
            h = np.bincount(code, weight * np.maximum(p * (1 - p), 1e-6), len(w[v])) + ridge
            step = np.clip(g / h, -2, 2)
            w[v] -= step
            z -= step[code]
            most = max(most, float(np.abs(step).max()))
        if most < 1e-6:
            break
    return float(w[0][0]), [dict(zip(n, x.tolist())) for n, x in zip(names[1:], w[1:])]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps on the ridge-penalised loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = odds(x @ w)
        g = x.T @ (p - y) + penalty * w
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def odds(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _z(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _steps(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the loss, in one array of (features + 1) columns."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = odds(x @ w)
    return np.vstack([x.T @ (weight * (p - y)), (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)


def _content_marks(w: np.ndarray):
    """(lang, source, length, mark, n) of the rows that the content view is sure of."""
    def run(batches):
        for batch in batches:
            p = odds(_z(_matrix(batch.column(3)), w))
            mark = pa.array(np.where(p >= SURE, 1, 0).astype(np.int32))
            table = pa.table([*batch.columns[:3], mark], ["lang", "source", "length", "mark"])
            found = table.filter(pa.array((p >= SURE) | (p <= 1 - SURE))).group_by(table.column_names).aggregate([([], "count_all")])
            yield from found.rename_columns([*table.column_names, "n"]).combine_chunks().to_batches()
    return run


def _content_sums(w: np.ndarray, marks: dict):
    """(part, sums): a task's sums for a Newton step over the rows that the metadata view has marked."""
    def run(batches):
        total = np.zeros((FEATURES + 2, FEATURES + 1))
        for batch in batches:
            found = [marks.get(k) for k in zip(*[c.to_pylist() for c in batch.columns[:3]])]
            at = [i for i, m in enumerate(found) if m]
            if at:
                y, weight = np.array([found[i] for i in at]).T
                total += _steps(_matrix(batch.column(3).take(pa.array(at))), y, weight, w)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())],
                                         ["part", "sums"])
    return run


def _add(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    total = sum(np.frombuffer(v) for v in table.column("sums").to_pylist())
    return pa.table([table.column("part")[:1], pa.array([total.tobytes()], pa.binary())], ["part", "sums"])


def _group_weights(source: list, mark: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weight of one row of each entry, so that no source and class weighs more than GROUP rows."""
    size: dict = {}
    for k, m in zip(zip(source, mark.tolist()), n.tolist()):
        size[k] = size.get(k, 0) + m
    return np.array([min(1.0, GROUP / size[k]) for k in zip(source, mark.tolist())], float)


def co_train(content: np.ndarray, metadata: list[list], y: np.ndarray, free: DataFrame, rounds: int = ROUNDS):
    """((weights, calibration (slope, shift)) of content, the same of metadata, prior log odds); None without both classes.

    free: (lang, source, length, x) of all unlabelled rows.
    """
    held = np.arange(len(y)) % HOLD_OUT == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return None
    pick = lambda keep: [[v for v, k in zip(c, keep) if k] for c in metadata]
    x, known, own = content[~held], pick(~held), y[~held]
    one = np.ones(len(own))
    near, far = fit_logistic(x, own, CONTENT_RIDGE), fit_metadata(known, own, one)
    kinds = free.groupBy("lang", "source", "length").agg(F.count("*").alias("n")).toArrow().sort_by(
        [(c, "ascending") for c in ("lang", "source", "length")])
    kinds, rows = [kinds.column(c).to_pylist() for c in ("lang", "source", "length")], kinds.column("n").to_numpy()
    penalty = np.full(FEATURES + 1, CONTENT_RIDGE)
    penalty[-1] = 1e-6
    for _ in range(rounds if len(rows) else 0):
        told = map_arrow(free, _content_marks(near), "lang string, source string, length int, mark int, n long").groupBy(
            "lang", "source", "length", "mark").agg(F.sum("n").alias("n")).toArrow().sort_by(
            [(c, "ascending") for c in ("lang", "source", "length", "mark")])
        p = odds(metadata_z(kinds, far))
        sure = np.flatnonzero((p >= SURE) | (p <= 1 - SURE))
        mark = (p[sure] >= SURE).astype(int)
        weight = _group_weights([kinds[1][i] for i in sure], mark, rows[sure])
        weight *= min(1.0, len(own) / max(float(weight @ rows[sure]), 1.0))  # the labelled rows weigh as much at least
        marks = {(kinds[0][i], kinds[1][i], kinds[2][i]): m for i, *m in zip(sure, mark.tolist(), weight.tolist())}
        for _ in range(STEPS):
            sums = _steps(x, own, one, near)
            if marks:
                found = map_arrow(free, _content_sums(near, marks), "part long, sums binary").groupBy(
                    F.pmod("part", F.lit(SUMS))).applyInArrow(_add, "part long, sums binary").toArrow()
                sums = sums + np.frombuffer(_add(found).column("sums")[0].as_py()).reshape(sums.shape)
            step = np.linalg.solve(sums[1:] + np.diag(penalty), sums[0] + penalty * near)
            near = near - step * min(1, 5 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-3:
                break
        told_y, n = told.column("mark").to_numpy(), told.column("n").to_numpy()
        told = [told.column(c).to_pylist() for c in ("lang", "source", "length")]
        far = fit_metadata([a + b for a, b in zip(known, told)], np.concatenate([own, told_y]),
                           np.concatenate([one, n * _group_weights(told[1], told_y, n)]))
    calibrate = lambda z: fit_logistic(z[:, None], y[held], 0.1)
    prior = float(np.log(y.mean() / (1 - y.mean())))
    return (near, calibrate(_z(content[held], near))), (far, calibrate(metadata_z(pick(held), far))), prior


def predict(model, content: np.ndarray, metadata: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content probability, metadata probability, combined probability)."""
    if model is None:
        half = np.full(len(content), 0.5)
        return half, half, half
    (near, near_fit), (far, far_fit), prior = model
    a, b = _z(_z(content, near)[:, None], near_fit), _z(metadata_z(metadata, far)[:, None], far_fit)
    return odds(a), odds(b), odds(a + b - prior)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> list:
    have = set(docs.columns)
    column = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
            column("lang", "string"), column("source", "string"), column("n_chars", "long")]


def _views(rows, data, offsets) -> tuple[np.ndarray, list[list]]:
    column = lambda c: rows.column(rows.schema.get_field_index(c)).to_pylist()
    return content_features(data, offsets), [column("lang"), column("source"), [length_class(n) for n in column("n_chars")]]


def _featured(docs: DataFrame) -> DataFrame:
    """(doc_id, y, lang, source, length, x) of rows (doc_id, text, lang, source, n_chars, y)."""
    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                x, (lang, source, length) = _views(rows, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(rows.schema.get_field_index("y")), pa.array(lang, pa.string()),
                     pa.array(source, pa.string()), pa.array(length, pa.int32()),
                     pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())],
                    ["doc_id", "y", "lang", "source", "length", "x"])

    return map_arrow(docs, run, "doc_id long, y int, lang string, source string, length int, x binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          labelled: int = LABELLED, rounds: int = ROUNDS):
    """The two models, fitted on at most ``labelled`` labelled documents and all unlabelled ones; None where a class is missing.

    Labels with null id or quality are ignored; an id with several counts as
    good if any is; a label without document has no effect. Labelled
    documents with one id count once (the smallest row); unlabelled rows all
    count, also those without id. Their features are written once.
    """
    spark = docs.sparkSession
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).dropna()
    good = good.groupBy("doc_id").agg(F.max("y").alias("y"))
    source = docs.select(*_columns(docs, id_col, text_col))
    chosen = good.join(source.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    wanted = spark.createDataFrame(chosen.toArrow())  # labelled rows at most
    sample = source.join(F.broadcast(wanted), "doc_id")
    one = sample.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars", "y")).alias("r"))
    found = _featured(one.select("doc_id", "r.*")).toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    free = _featured(source.withColumn("y", F.lit(None).cast("int"))).join(good.select("doc_id"), "doc_id", "left_anti")
    free = stage(free.select("lang", "source", "length", "x"), "unlabelled")
    y = (found.column("y").to_numpy() > 0).astype(int)
    return co_train(_matrix(found.column("x")), [found.column(c).to_pylist() for c in ("lang", "source", "length")],
                    y, free, rounds)


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
          threshold: float = 0.5) -> DataFrame:
    """(doc_id, content_score, metadata_score, score, accepted), one for each row; with ``keep`` also text and carried.

    accepted: score >= threshold. Null texts count as empty, null metadata
    as a value of its own. Without a model every score is 0.5. carried is a
    struct of the columns named in ``keep``. Empty input gives an empty
    result.
    """
    src = docs.select(*_columns(docs, id_col, text_col), *([F.struct(*keep).alias("carried")] if keep else []))
    names = ["doc_id", "content_score", "metadata_score", "score", "accepted"]

    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                a, b, both = predict(model, *_views(rows, data, offsets))
                more = [rows.column(rows.schema.get_field_index(c)) for c in ("text", "carried")] if keep else []
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= threshold), *more],
                    [*names, *(("text", "carried") if keep else ())])

    more = f", text string, carried {src.schema['carried'].dataType.simpleString()}" if keep else ""
    return map_arrow(src, run, "doc_id long, content_score double, metadata_score double, score double, "
                     f"accepted boolean{more}")
