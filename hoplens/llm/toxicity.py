"""Toxicity by compression distance (operator 11).

Two zstandard dictionaries are trained apart: one on windows of ordinary text,
one on toxic text. A text is cut into windows of about 128 bytes; each window
is compressed once with the ordinary dictionary alone and once with the toxic
one in front of it, and the bytes that the toxic dictionary saves are the
window's gain. As both runs know the same ordinary language, a window of
ordinary text gains nothing, whatever its language, and a window with a toxic
expression gains some bytes.

Toxic documents consist of ordinary language for the most part. The toxic
dictionary is therefore trained on those stretches of their text whose short
byte strings are much more frequent among toxic documents than among ordinary
ones (by documents, equal texts counted once); without such stretches it stays
empty.

The gains of a document become a few numbers: mean gain, share and number of
the windows that reach each of several thresholds, and the largest gain. Their
weights are calibrated by a regularised logistic fit on labelled documents that
the dictionaries have not seen, weighted to the classes' shares among all
labels. Fitting takes place in one task, on a sample bounded by MAX_TRAIN
documents a class and WINDOWS windows a document; scoring reads whole texts.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.llm.common import SPACES, small, utf8
from hoplens.llm.quality import held_out

#: Labelled documents of each class that are fitted on; windows of each, chosen at random.
MAX_TRAIN, WINDOWS = 2000, 256
#: Bytes between window starts (a window starts with the first word of its cell); longer windows are cut at LONGEST.
CELL, LONGEST = 128, 512
#: Sizes of the dictionaries in bytes, and the compression level.
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 1 << 16, 1 << 12, 6
#: Byte strings that mark a toxic stretch: length, least log odds against ordinary documents, least documents.
GRAM, LOG_ODDS, LEAST_DOCS, GRAM_BITS = 5, 2.5, 4, 22
#: Gains, in bytes, at which windows are counted.
STEPS = (2, 3, 4, 5, 6)
#: Weight of the penalty in the logistic fit; score from which a document counts as toxic.
PENALTY, CUT = 3e-4, 0.5


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all windows, and the first window of each text
    (len + 1). All bytes from a text's first word on belong to one window."""
    word = ~SPACES[data]
    word[1:] &= SPACES[data[:-1]]
    at = offs[:-1][offs[:-1] < offs[1:]]
    word[at] = ~SPACES[data[at]]
    start = np.flatnonzero(word)
    text = np.searchsorted(offs, start, "right") - 1
    cell = (start - offs[text]) // CELL
    first = np.ones(len(start), bool)
    first[1:] = (text[1:] != text[:-1]) | (cell[1:] != cell[:-1])
    start, text = start[first], text[first]
    end = np.concatenate([start[1:], np.zeros(min(1, len(start)), np.int64)])
    last = np.ones(len(start), bool)
    last[:-1] = text[1:] != text[:-1]
    end[last] = offs[text[last] + 1]
    parts = -(-(end - start) // LONGEST)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    lo = np.repeat(start, parts) + nth * LONGEST
    size = np.minimum(np.repeat(end, parts) - lo, LONGEST)
    return lo, size, np.searchsorted(np.repeat(text, parts), np.arange(len(offs)))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if content else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **held)


def lengths(press: zstandard.ZstdCompressor, data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Compressed bytes of each window."""
    if not len(lo):
        return np.zeros(0, np.int64)
    cuts = np.stack([lo, size], 1).astype(np.uint64).tobytes()
    out = press.multi_compress_to_buffer(zstandard.BufferWithSegments(data.tobytes(), cuts), threads=1)
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


def numbers(gain: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row per text of what the logistic fit reads; zeros without windows."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    out = [np.bincount(text, gain, len(n)) / (n + 4)]
    for step in STEPS:
        hits = np.bincount(text, gain >= step, len(n))
        out += [hits / (n + 4), np.log1p(hits)]
    most = np.zeros(len(n))
    np.maximum.at(most, text, gain)
    return np.stack([*out, most], 1)


class CompressionModel:
    """Dictionaries and calibration; ``weight`` is None where the labels hold
    one class only, and then every score is the smoothed share."""

    def __init__(self, ordinary: bytes, toxic: bytes, share: float):
        self.ordinary, self.toxic, self.share, self.weight = ordinary, toxic, share, None

    def presses(self):
        return compressor(self.ordinary), compressor(self.toxic + self.ordinary)

    def numbers(self, presses, data, offs):
        lo, size, first = windows(data, offs)
        gain = (lengths(presses[0], data, lo, size) - lengths(presses[1], data, lo, size)) if self.toxic \
            else np.zeros(len(lo))
        return numbers(gain, first)

    def calibrate(self, rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Weighted logistic regression by Newton's method."""
        self.mean, self.spread = rows.mean(0), rows.std(0) + 1e-9
        x = np.column_stack([(rows - self.mean) / self.spread, np.ones(len(rows))])
        ridge = np.full(x.shape[1], PENALTY * weight.sum())
        ridge[-1] = 1e-6
        w = np.zeros(x.shape[1])
        w[-1] = np.log(self.share / (1 - self.share))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            hessian = (x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(ridge)
            pull = ridge * w
            pull[-1] = 0
            w -= np.linalg.solve(hessian, x.T @ (weight * (p - label)) + pull)
        self.weight = w

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.full(len(rows), self.share)
        x = np.column_stack([(rows - self.mean) / self.spread, np.ones(len(rows))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weight, -40, 40)))


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the samples are too few for the trainer, they
    are the dictionary themselves."""
    if sum(map(len, samples)) > 4 * size and len(samples) > 16:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def grams(text: bytes) -> np.ndarray:
    """Hashed places of all byte strings of GRAM bytes."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(a) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0x9E3779B1) + a[j:j + n] + np.uint64(1)
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def toxic_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The stretches of toxic texts that ordinary texts do not have."""
    def counts(texts):
        held = np.zeros(1 << GRAM_BITS, np.int32)
        for t in texts:
            held[np.unique(grams(t))] += 1
        return held

    t, o = counts(toxic), counts(ordinary)
    odds = np.log((t + .5) / (len(toxic) + 1)) - np.log((o + .5) / (len(ordinary) + 1))
    marked = (odds > LOG_ODDS) & (t >= LEAST_DOCS)
    out = []
    for text in toxic:
        step = np.diff(np.concatenate([[0], marked[grams(text)].astype(np.int8), [0]]))
        cuts = {text[i:j + GRAM - 1] for i, j in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))}
        out += sorted(c.ljust(8) for c in cuts)  # the trainer takes no sample below 8 bytes
    return out


def fit(rows: list[tuple[int, int, list[bytes]]], share: float, seed: int = 0) -> CompressionModel:
    """``rows``: (id, label, windows). Two of three documents, by their text,
    train the dictionaries, the others calibrate."""
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    if len({y for _, y, _ in rows}) < 2:
        return CompressionModel(b"", b"", share)
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(rows)) % 3 > 0
    held: tuple[dict, dict] = ({}, {})  # equal texts once
    for row, train in zip(rows, part):
        if train:
            held[row[1]][b"".join(row[2])] = row[2]
    cut = [w for ws in held[0].values() for w in ws if len(w) >= 8]
    cut = [cut[i] for i in np.sort(rng.permutation(len(cut))[:60000])]
    model = CompressionModel(dictionary(cut, ORDINARY_BYTES),
                             dictionary(toxic_stretches(list(held[1]), list(held[0])), TOXIC_BYTES), share)
    rest = [r for r, train in zip(rows, part) if not train]
    label = np.array([y for _, y, _ in rest], float)
    if 0 < label.sum() < len(label):
        texts = [b"".join(ws) for _, _, ws in rest]
        offs = np.cumsum([0, *map(len, texts)])
        weight = np.where(label == 1, share / label.sum(), (1 - share) / (len(label) - label.sum())) * len(label)
        model.calibrate(model.numbers(model.presses(), np.frombuffer(b"".join(texts), np.uint8), offs), label, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = 0) -> CompressionModel:
    """Fit on at most ``max_train`` documents of each label outside the held-out
    fifth, those with the smallest hash of the id, in one task. A document with
    several labels has the smallest, one without a 0 or 1 is not used; of rows
    that share an id the one with the greatest sample stands for all."""
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y"))
             .where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
             .groupBy("_id").agg(F.min("_y").alias("_y")))
    count = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = (count.get(1, 0) + 1) / (sum(count.values()) + 2)
    if len(count) < 2:
        return CompressionModel(b"", b"", share)
    few = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_train) for y in (0, 1)]
    rows = (docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(few[0].unionByName(few[1])), "_id").select("_id", "_y", "text"))  # 2 max_train rows

    def sample(batches):
        for b in small(batches, 2):
            data, offs = utf8(b.column(2))
            lo, size, first = windows(data, offs)
            out = []
            for i, doc in enumerate(b.column(0).to_pylist()):
                pick = np.arange(first[i], first[i + 1])
                if len(pick) > WINDOWS:
                    pick = np.sort(np.random.default_rng((seed, doc & 0xFFFFFFFF)).permutation(pick)[:WINDOWS])
                out.append([data[lo[k]:lo[k] + size[k]].tobytes() for k in pick])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.binary()))],
                                             names=["_id", "_y", "cuts"])

    cuts = (rows.mapInArrow(sample, "_id long, _y int, cuts array<binary>")
            .groupBy("_id", "_y").agg(F.max("cuts").alias("cuts")))

    def fitted(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(fit(rows, share, seed)))], pa.binary())], names=["m"])

    model = CompressionModel(b"", b"", share)
    vars(model).update(pickle.loads(bytes(cuts.repartition(1).mapInArrow(fitted, "m binary").first()["m"])))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT, max_train: int = MAX_TRAIN,
                    seed: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts have no window and are scored as such; a null doc_id
    is not held out. Repeated rows are scored alike. With labels of one class,
    or none, every score is the smoothed share of label 1. An empty table gives
    an empty result; other columns are not looked at.
    """
    model = train(docs, labels, max_train, seed)

    def score(batches):
        presses = model.presses()
        for b in small(batches, 1):
            rows = model.numbers(presses, *utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(rows), pa.float64())],
                                             names=["doc_id", "score"])

    out = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
           .mapInArrow(score, "doc_id long, score double"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= cut).cast("int").alias("predicted"))
