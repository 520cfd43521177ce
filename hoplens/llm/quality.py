"""Quality classifier: a factorisation machine (operator 3).

Features of a text are its hashed words (with damped counts), structure
statistics cut into bins, and the declared length as metadata. The score is
sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is
computed in linear time as half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2.

The model is fitted on a bounded sample of labelled documents: executors turn
their texts into sparse features and only those reach the driver. Scoring maps
every whole text on the executors, with the model (a few MB, of fixed size) in
the task. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hoplens.llm.common import SPACES, small, stage, utf8, word_bounds, word_hashes

#: Hashed words; bins of each statistic; rank of the pairwise part.
WORDS, BINS, RANK = 1 << 16, 16, 8
#: Labelled documents that the model is fitted on, at most (by hash of the id).
MAX_TRAIN = 8000
#: Bytes of their features, about, that the fit reads.
TRAIN_BYTES = 256 << 20
#: A score from here on predicts label 1.
CUT = 0.3
#: Passes over the sample (more over a small one, to STEPS batches), and the step size.
EPOCHS, STEPS, BATCH, RATE, DECAY = 6, 300, 64, 0.1, 1e-4

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MARK = ~(_LETTER | _DIGIT | SPACES)
_MARK[:32] = False
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:?'-"]] = True

STATS = ("log_words", "word_length", "upper", "digit", "mark", "odd_mark", "high_byte", "distinct",
         "repeat_next", "top_word", "lone_mark", "line_words", "repeated_lines", "log_declared")


def _mean(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean of ``values`` per text (0 for empty texts)."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (sums[offs[1:]] - sums[offs[:-1]]) / np.maximum(1, np.diff(offs))


def features(column: pa.Array, declared: np.ndarray):
    """Of each text: sparse words (first entry per text, buckets, values) and
    the table of statistics [text, STATS]."""
    data, offs = utf8(column)
    hashes, first = word_hashes(data, offs)
    s, e, _ = word_bounds(data, offs)
    n = len(offs) - 1
    bucket = (hashes >> np.uint64(48)).astype(np.int64)
    words, chars = np.diff(first), np.diff(offs)
    stats = np.zeros((n, len(STATS)))
    put = lambda name, x: stats.__setitem__((slice(None), STATS.index(name)), x)
    put("log_words", np.log1p(words))
    put("word_length", _mean(e - s, first))
    for name, of in (("upper", _UPPER), ("digit", _DIGIT), ("mark", _MARK), ("odd_mark", _MARK & ~_END)):
        put(name, _mean(of[data], offs))
    put("high_byte", _mean(data >= 128, offs))
    put("log_declared", np.where(np.isnan(declared), -1, np.log1p(np.maximum(0, np.nan_to_num(declared)))))
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    put("repeat_next", _mean(same, first))
    # words without any letter or digit
    solid = np.concatenate([[0], np.cumsum(_LETTER[data] | _DIGIT[data], dtype=np.int64)])
    put("lone_mark", _mean(solid[e] == solid[s], first))
    lines = (data == 10)
    put("line_words", words / (1 + np.add.reduceat(np.append(lines, False), offs[:-1]) * (chars > 0))
        if n else 0)
    at, buckets, values = np.zeros(n + 1, np.int64), [], []
    breaks = np.flatnonzero(lines)
    for i in range(n):
        u, count = np.unique(bucket[first[i]:first[i + 1]], return_counts=True)
        x = np.log1p(count)
        buckets.append(u)
        values.append(x / max(1.0, np.sqrt((x * x).sum())))
        at[i + 1] = at[i] + len(u)
        if len(u):
            stats[i, STATS.index("distinct")] = len(u) / words[i]
            stats[i, STATS.index("top_word")] = count.max() / words[i]
            lo, hi = np.searchsorted(breaks, (offs[i], offs[i + 1]))
            if hi > lo:
                raw = data[offs[i]:offs[i + 1]].tobytes().split(b"\n")
                stats[i, STATS.index("repeated_lines")] = 1 - len(set(raw)) / len(raw)
    cat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
    return at, cat(buckets, np.int64), cat(values, np.float32), stats


class FactorisationMachine:
    """Weights and factors over WORDS hashed words, then BINS per statistic."""

    def __init__(self, bias: float = 0.0, edges: np.ndarray | None = None):
        self.bias = bias
        self.edges = edges  # [statistic, BINS - 1]
        self.weight = np.zeros(WORDS + BINS * len(STATS), np.float32)
        self.factor = np.zeros((len(self.weight), RANK), np.float32)

    def rows(self, at, bucket, value, stats):
        """Add the statistics' bins to the sparse rows."""
        n, k = stats.shape
        if self.edges is None:
            return at, bucket, value
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(k)], 1)
        own = WORDS + np.arange(k) * BINS + bins
        at2 = at + np.arange(n + 1) * k
        spot = np.zeros(at2[-1], bool)
        spot[(at2[1:, None] - k + np.arange(k)).ravel()] = True
        b2, v2 = np.empty(at2[-1], np.int64), np.empty(at2[-1], np.float32)
        b2[spot], v2[spot] = own.ravel(), 1 / np.sqrt(k)
        b2[~spot], v2[~spot] = bucket, value
        return at2, b2, v2

    def margins(self, at, bucket, value):
        """Score before the sigmoid, and the factor sums that training needs."""
        add = lambda x: np.add.reduceat(np.concatenate([x, np.zeros_like(x[:1])]), at[:-1])
        if not len(bucket):
            return np.full(len(at) - 1, self.bias), np.zeros((len(at) - 1, RANK), np.float32)
        vx = self.factor[bucket] * value[:, None]
        empty = (np.diff(at) == 0)[:, None]
        total = np.where(empty, 0, add(vx))
        linear = np.where(empty[:, 0], 0, add(self.weight[bucket] * value))
        pairs = (total ** 2).sum(1) - np.where(empty[:, 0], 0, add((vx ** 2).sum(1)))
        return self.bias + linear + 0.5 * pairs, total

    def scores(self, at, bucket, value, stats) -> np.ndarray:
        m = self.margins(*self.rows(at, bucket, value, stats))[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(m, -40, 40)))

    def fit(self, at, bucket, value, label, seed: int = 0) -> None:
        """AdaGrad over shuffled batches; rows already hold their bins."""
        rng = np.random.default_rng(seed)
        used = np.unique(bucket)
        self.factor[used] = rng.normal(0, 0.05, (len(used), RANK)).astype(np.float32)
        gw, gv, gb = np.full(len(self.weight), 1e-3, np.float32), np.full(self.factor.shape, 1e-3, np.float32), 1e-3
        n = len(label)
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // n))):
            order = rng.permutation(n)
            for lo in range(0, n, BATCH):
                pick = order[lo:lo + BATCH]
                size = at[pick + 1] - at[pick]
                sub = np.concatenate([[0], np.cumsum(size)])
                where = np.arange(sub[-1]) + np.repeat(at[pick] - sub[:-1], size)
                b, x = bucket[where], value[where]
                margin, total = self.margins(sub, b, x)
                miss = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label[pick]) / len(pick)
                each = (np.repeat(miss, size) * x).astype(np.float32)
                slope = each[:, None] * (np.repeat(total, size, 0) - self.factor[b] * x[:, None])
                hit, inverse = np.unique(b, return_inverse=True)
                dw = np.bincount(inverse, each, len(hit)) + DECAY * self.weight[hit] / n
                order_b = np.argsort(inverse, kind="stable")
                starts = np.searchsorted(inverse[order_b], np.arange(len(hit)))
                dv = np.add.reduceat(slope[order_b], starts) + DECAY * self.factor[hit] / n
                gw[hit] += dw ** 2
                gv[hit] += dv ** 2
                self.weight[hit] -= RATE * dw / np.sqrt(gw[hit])
                self.factor[hit] -= RATE * dv / np.sqrt(gv[hit])
                db = float(miss.sum())
                gb += db ** 2
                self.bias -= RATE * db / gb ** 0.5


def held_out(doc_id) -> F.Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN,
                  train_bytes: int = TRAIN_BYTES) -> list:
    """Features of the documents that ``train`` reads: one row per id, of
    repeated ids the least (n_chars, features), in order of the id's hash as far
    as ``train_bytes`` (the row that passes it is the last)."""
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
             .where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
             .groupBy("_id").agg(F.min("_y").alias("_y"))
             .orderBy(F.xxhash64("_id"), "_id").limit(max_train))
    rows = (docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"),
                        F.col("n_chars").cast("double").alias("n_chars"))
            .join(F.broadcast(known), "_id").select("_id", "_y", "text", "n_chars"))  # max_train rows

    def sparse(batches):
        for b in small(batches, 2):
            declared = b.column(3).to_numpy(zero_copy_only=False).astype(float)
            at, bucket, value, stats = features(b.column(2), declared)
            cut = lambda x, kind: [x[at[i]:at[i + 1]].astype(kind).tobytes() for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cut(bucket, np.uint16), pa.binary()),
                 pa.array(cut(value, np.float16), pa.binary()),
                 pa.array([r.tobytes() for r in stats], pa.binary())],
                names=["_id", "_y", "bucket", "value", "stats"])

    names = ["stats", "bucket", "value"]
    # texts of a repeated id become features where they lie; the least of them is found with partial aggregates
    got = (rows.mapInArrow(sparse, "_id long, _y int, bucket binary, value binary, stats binary")
           .groupBy("_id", "_y").agg(F.min(F.struct(*names)).alias("least")))
    got = stage(got.select("_id", "_y", "least.*"), "training")
    order = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1)
    size = sum(F.octet_length(c) for c in names)
    within = (got.select("_id", F.coalesce(F.sum(size).over(order), F.lit(0)).alias("before"))  # max_train narrow rows
              .where(F.col("before") < train_bytes).select("_id"))
    return got.join(F.broadcast(within), "_id").collect()


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = 0) -> FactorisationMachine:
    """Fit on at most ``max_train`` labelled documents outside the held-out
    fifth (``training_rows``): those with the smallest hash of the id. A document with several
    labels has the smallest; one without a 0 or 1 is not used. With labels of
    one class only, every score is the smoothed share of label 1."""
    got = training_rows(docs, labels, max_train)
    got.sort(key=lambda r: (r["_id"], bytes(r["bucket"]), bytes(r["stats"])))
    label = np.array([r["_y"] for r in got], float)
    ones = float(label.sum())
    share = (ones + 1) / (len(label) + 2)
    model = FactorisationMachine(float(np.log(share / (1 - share))))
    if ones in (0.0, float(len(label))):
        return model
    bucket = [np.frombuffer(r["bucket"], np.uint16).astype(np.int64) for r in got]
    value = np.concatenate([np.frombuffer(r["value"], np.float16) for r in got]).astype(np.float32)
    stats = np.stack([np.frombuffer(r["stats"]) for r in got])
    at = np.concatenate([[0], np.cumsum([len(b) for b in bucket])])
    model.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    model.fit(*model.rows(at, np.concatenate(bucket), value, stats), label, seed)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT, max_train: int = MAX_TRAIN,
                    seed: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts are scored by their statistics; a null n_chars is a
    value of its own; a null doc_id is not held out. Repeated rows are scored
    alike. An empty table gives an empty result.
    """
    model = train(docs, labels, max_train, seed)

    def score(batches):
        for b in small(batches, 1):
            got = features(b.column(1), b.column(2).to_numpy(zero_copy_only=False).astype(float))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(*got), pa.float64())],
                                             names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       F.col("n_chars").cast("double"))
    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT, **params) -> DataFrame:
    """The documents whose score reaches ``cut``, with all columns of ``docs``:
    the filter works on the batches themselves, so no join is needed."""
    model = train(docs, labels, **params)

    # the row is one struct, so that no helper column has the name of an input column, and its text
    # goes to the worker once: another column has it only where it is no string yet
    own = [i for i, f in enumerate(docs.schema) if f.name == "text" and isinstance(f.dataType, StringType)][:1]

    def keep(batches):
        views = (pa.RecordBatch.from_arrays([b.column(0).field(own[0]) if own else b.column(2), *b.columns[:2]],
                                            names=["text", "row", "n"]) for b in batches)
        for b in small(views, 0):
            got = features(b.column(0), b.column(2).to_numpy(zero_copy_only=False).astype(float))
            yield pa.RecordBatch.from_arrays([b.column(1)], names=["_row"]).filter(pa.array(model.scores(*got) >= cut))

    cast = [] if own else [F.col("_row.text").cast("string").alias("_text")]
    out = docs.select(F.struct("*").alias("_row")).select("_row", F.col("_row.n_chars").cast("double").alias("_n"), *cast)
    return out.mapInArrow(keep, StructType([StructField("_row", docs.schema)])).select("_row.*")
