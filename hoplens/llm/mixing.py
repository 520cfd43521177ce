"""Mixing sources to target weights by the cube method (operator 1).

A document of a source with target t and total size s is wanted e = t / s
times. It is taken floor(e) times for certain, and once more with inclusion
probability pi = e - floor(e). The cube method turns those fractions into 0 or
1: it moves the vector of probabilities along directions that keep two totals
of the source, its documents and its words, until at most two documents are
undecided (flight); these are landed so that the words come nearest the target.

At scale each source is cut into blocks of bounded size, by a hash of its
documents' ids, so a source with a third of all rows is many small tasks. A
block's flight leaves at most two documents undecided; those meet in fewer
blocks, level by level, until one block per source lands. Only (id, source,
size) travel, never texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.llm.common import sieved, small, stage, unsieved, whole_rows, with_identity, word_counts

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source's target, and no document's share, exceeds this many times its size.
MAX_REPEATS = 3.0
#: Documents of a source that one task decides on at once.
BLOCK = 4096
#: Documents of a source that the last flight leaves to the landing; it tries all their subsets.
LANDING = 14


def sized(docs: DataFrame) -> DataFrame:
    """(_k, _dup, doc_id, source, size) of all documents; size = words of the
    whole text, 0 for null."""
    def count(batches):
        for b in small(batches, 4):
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(word_counts(b.column(4)), pa.int64())],
                names=["_k", "_dup", "doc_id", "source", "size"])

    rows = with_identity(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"),
                                     F.col("text").cast("string")), "doc_id", "text", "source")
    return rows.select("_k", "_dup", "doc_id", "source", "text").mapInArrow(
        count, "_k long, _dup int, doc_id long, source string, size long")


def ranked(sources: DataFrame) -> DataFrame:
    """Number distinct sources 0, 1, ... by code point, null last: a sorted
    table's row numbers within its files' partitions plus the partitions'
    offsets, which are all that reaches the driver."""
    at = F.monotonically_increasing_id()
    rows = stage(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", at), "sources")
    parts = sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright("_at", 33).alias("p")).count().collect())
    low, offsets = 0, []
    for p, n in parts:
        offsets.append((p, low))
        low += n
    offset = rows.sparkSession.createDataFrame(offsets, "_p long, _low long")
    return (rows.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(offset), "_p")
            .select("source", "source_docs", "source_size",
                    (F.col("_low") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("rank")))


def water_level(sources: DataFrame, cap: float) -> float:
    """The level x at which the targets min(weight * x, cap * size) add up to
    the total size: what is above a source's cap is shared again by weight
    until none is above. Each round is one sum over the sources' table."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, -1
    while total:
        over = F.col("weight") * F.lit(level) >= cap * F.col("source_size")
        n, full, open_weight = sources.agg(
            F.sum(over.cast("long")), F.sum(F.when(over, cap * F.col("source_size")).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == seen or not open_weight:
            break
        seen, level = n, (total - full) / open_weight
    return level


def mix_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = MAX_REPEATS) -> DataFrame:
    """(source, source_docs, source_size, weight, target), stored."""
    per = sizes.groupBy("source").agg(F.count("*").alias("source_docs"), F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.col("rank") % len(weights) + 1).cast("int"))
    rows = stage(ranked(per).withColumn("weight", w), "targets")
    level = water_level(rows, cap)
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(level),
                                             F.lit(cap) * F.col("source_size")))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int = 2) -> np.ndarray:
    """Move ``pi`` until at most ``leave`` (two or more) entries are strictly between 0 and 1.

    Of three undecided documents there is a direction u that keeps both sums,
    sum(u) = 0 and sum(u * size) = 0: the cross product of the constraint
    rows, (s2 - s1, s0 - s2, s1 - s0). The step along u or -u goes on to the
    wall of the cube, with probabilities that keep the expectation. The entry
    that meets the wall is set to it, so each step decides one at least, and a
    probability however near to 0 or 1 is undecided until then. Large documents
    come first, so what is left is small.
    """
    order = np.lexsort((np.arange(len(pi)), -size))
    todo = [int(i) for i in order if 0 < pi[i] < 1]
    draws = rng.random(len(todo) + 1)
    p, s = pi.tolist(), size.tolist()
    hand, at, step = todo[:3], 3, 0
    while len(hand) == 3 and len(hand) + len(todo) - at > leave:
        a, b, c = hand
        u = (float(s[c] - s[b]), float(s[a] - s[c]), float(s[b] - s[a]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        ways = [((1 - p[i]) / x, p[i] / x) if x > 0 else (p[i] / -x, (1 - p[i]) / -x) if x < 0
                else (math.inf, math.inf) for i, x in zip(hand, u)]
        up, down = min(w[0] for w in ways), min(w[1] for w in ways)
        rise = draws[step] * (up + down) < down
        move = up if rise else -down
        step += 1
        left = []
        for i, x, way in zip(hand, u, ways):
            if way[0 if rise else 1] == abs(move):
                p[i] = 1.0 if (x > 0) == rise else 0.0
            else:
                p[i] = min(1.0, max(0.0, p[i] + move * x))
            if 0 < p[i] < 1:
                left.append(i)
        hand = left
        while len(hand) < 3 and at < len(todo):
            hand.append(todo[at])
            at += 1
    return np.array(p)


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Land the problem that the flight left: of all subsets of the undecided
    documents that whose words are nearest their expectation, then that whose
    number is, then the first."""
    out = pi.copy()
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    assert len(open_) <= LANDING, f"{len(open_)} documents are undecided after the flight"
    if len(open_):
        taken = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        words = np.abs(taken @ size[open_] - (pi[open_] * size[open_]).sum())
        number = np.abs(taken.sum(1) - pi[open_].sum())
        out[open_] = taken[np.lexsort((number.round(9), words.round(6)))[0]]
    return out


def decision(seed: int, level: int, last: bool, keep: list[str]):
    """The flight of one block (and its landing, on the last level) as a
    function of its key and rows."""
    def decide(key, pdf):
        pdf = pdf.sort_values(["size", "_k", "_dup"], ascending=[False, True, True])
        salt = [ord(c) for c in key[0]] if key[0] is not None else [1 << 24]
        rng = np.random.default_rng([seed, level, int(key[1]), *salt])
        size = pdf["size"].to_numpy(np.float64)
        pi = flight(pdf["pi"].to_numpy(np.float64), size, rng, LANDING if last else 2)
        pdf["pi"] = land(pi, size) if last else pi
        return pdf[keep]

    return decide


def cube_mix(docs: DataFrame, weights=WEIGHTS, cap: float = MAX_REPEATS, block: int = BLOCK,
             seed: int = 0) -> DataFrame:
    """One row per document: _k, _dup, doc_id, source, size, source_size,
    target (its source's), copies (how often it is taken), taken (words).

    Null text has size 0; null sources form one source, the last. An empty
    document moves only its source's number of documents. A source without
    words has target 0 and takes nothing. Rows that share a doc_id are
    documents of their own; an empty table gives an empty result. Reruns agree:
    draws depend on the seed, source, block and level alone, and a block's
    rows are put in order before it flies.
    """
    sizes = stage(sized(docs), "sizes")
    targets = stage(mix_targets(sizes, weights, cap), "mix")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .drop("_s").withColumn("share", share).withColumn("sure", F.floor("share"))
            .withColumn("pi", F.col("share") - F.col("sure"))
            .withColumn("in_source", F.col("source_docs")))
    keep = ["_k", "_dup", "doc_id", "source", "size", "source_size", "target", "sure", "pi", "in_source"]
    rows = rows.select(*keep)
    most = targets.agg(F.max("source_docs")).first()[0] or 0
    schema = ("_k long, _dup int, doc_id long, source string, size long, source_size long, "
              "target double, sure long, pi double, in_source long")
    done: list[DataFrame] = []
    level = 0
    while True:
        last = most <= block
        n = F.greatest(F.lit(1), F.ceil(F.col("in_source") / block)).cast("long")

        cut = F.pmod(F.xxhash64("_k", "_dup", F.lit(level)), n)
        out = rows.withColumn("_block", cut).groupBy("source", "_block").applyInPandas(
            decision(seed, level, last, keep), schema)
        if last:
            done.append(out)
            break
        out = stage(out, "flight")
        open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
        done.append(out.where(~open_))
        most = 2 * math.ceil(most / block)
        rows = out.where(open_).withColumn("in_source", 2 * F.ceil(F.col("in_source") / block))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("sure") + F.round("pi")).cast("long")
    return out.select("_k", "_dup", "doc_id", "source", "size", "source_size", "target",
                      copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents of the mix, each as often as it is taken; all columns of
    ``docs``, of any name, are kept as they are."""
    other = stage(cube_mix(docs, **params).where("copies <> 1").select("_k", "_dup", "copies"), "other")
    rows = whole_rows(docs, "doc_id", "text", "source")
    # most documents are taken once: only rows that are not, and few besides, are shuffled
    moved = sieved(rows, other, "_k", "_dup").join(other, ["_k", "_dup"], "left").where("copies is null or copies > 0")
    times = F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))
    return unsieved(rows, other, "_k", "_dup").select("_row").unionByName(
        moved.withColumn("_copy", F.explode(times)).select("_row")).select("_row.*")
