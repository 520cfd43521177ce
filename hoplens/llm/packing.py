"""Variable-capacity best-fit packing (operator 6).

Sequences of several permitted lengths are filled with whole documents. A
document's length is its number of words; one longer than the largest capacity
is cut into pieces of that capacity and a rest. Pieces go, longest first, into
the open bin that they fill best, whatever its capacity. Where none fits, the
bin size that costs least is opened: its cost less what its free room is worth.
That worth is a price per free word; the block is packed at several prices and
the cheapest whole packing stays, so the sizes are chosen jointly. At the end
every bin is downsized to the smallest permitted length that holds it.

Blocks of bounded size are packed one by one, streamed in a fixed order from
hash-dealt partitions, so no task holds more than a block of (id, length)
rows, and a block has at most a few bins that larger blocks would fill better.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.llm.common import small, stage, word_counts

#: Permitted sequence lengths, in words.
CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its length.
OVERHEAD = 16
#: Prices of a free word that a block is packed at.
PRICES = (0.0, 0.5, 0.8, 0.9, 0.95, 1.0)
#: Pieces packed together.
BLOCK = 8192
#: Partitions at most; each takes its blocks one after the other.
PARTITIONS = 4096
#: Equal pieces that are numbered at once.
COPIES = 4096


def bin_cost(capacity: int, overhead: int = OVERHEAD) -> int:
    return capacity + overhead


def downsized(fill: int, capacities) -> int:
    """The smallest permitted capacity that holds ``fill``."""
    return min(c for c in capacities if c >= fill)


def pack_at(lengths, capacities, price: float, overhead: int = OVERHEAD):
    """Best fit of ``lengths`` (longest first) at a price of a free word.
    Returns the bin of each piece and the words in each bin."""
    rooms: list[tuple[int, int]] = []  # (free words, bin), sorted
    bins, fill = [], []
    for n in lengths:
        i = bisect_left(rooms, (n, -1))
        if i < len(rooms):
            room, b = rooms.pop(i)
        else:
            room = min((c for c in capacities if c >= n),
                       key=lambda c: (bin_cost(c, overhead) - price * (c - n), c))
            b = len(fill)
            fill.append(0)
        fill[b] += n
        bins.append(b)
        if room > n:
            insort(rooms, (room - n, b))
    return bins, fill


def pack_block(lengths, capacities=CAPACITIES, overhead: int = OVERHEAD, prices=PRICES):
    """The cheapest packing over all prices, downsized: bin and start of each
    piece, capacity of each bin."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    best = None
    for price in prices:
        bins, fill = pack_at([lengths[i] for i in order], capacities, price, overhead)
        caps = [downsized(f, capacities) for f in fill]
        cost = sum(bin_cost(c, overhead) for c in caps)
        if best is None or cost < best[0]:
            best = cost, bins, caps
    _, bins, caps = best
    bin_of, start, used = [0] * len(lengths), [0] * len(lengths), [0] * len(caps)
    for i, b in zip(order, bins):
        bin_of[i], start[i] = b, used[b]
        used[b] += lengths[i]
    return bin_of, start, caps


def pieces(docs: DataFrame, capacities=CAPACITIES) -> DataFrame:
    """(doc_id, piece, first_word, n_words, copy): whole documents, or pieces of
    the largest capacity and a rest. Equal pieces of rows that share an id are
    counted before they are shuffled, and then numbered by ``copy``."""
    top = max(capacities)

    def cut(batches):
        for b in small(batches, 1):
            n = word_counts(b.column(1))
            many = np.maximum(1, -(-n // top))
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            first = piece * top
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(piece, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(np.minimum(n[row] - first, top), pa.int64())],
                names=["doc_id", "piece", "first_word", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "doc_id long, piece long, first_word long, n_words long")
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    # in two steps, so that no array grows with the number of copies
    some = counted.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES))).alias("lo"))
    upto = F.least(F.col("lo") + COPIES, F.col("n")) - 1
    return some.select(*rows.columns, F.explode(F.sequence(F.col("lo"), upto, F.lit(1))).alias("copy"))


def pack_documents(docs: DataFrame, capacities=CAPACITIES, overhead: int = OVERHEAD,
                   prices=PRICES, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, piece, first_word (of the text), n_words,
    bin_id, bin_capacity, bin_start (word offset in the bin).

    Null and empty texts have one piece of 0 words, which is in no bin: bin_id
    and bin_start are null, bin_capacity 0. Rows that share a doc_id are packed
    each on its own. An empty table gives no rows. Reruns agree: blocks are cut
    by a hash of the id and packed in order of the id.
    """
    capacities = tuple(sorted(set(int(c) for c in capacities)))
    if not capacities or capacities[0] < 1:
        raise ValueError("capacities must be positive")
    rows = stage(pieces(docs, capacities), "pieces")
    full = rows.where("n_words > 0")
    shards = max(1, -(-full.count() // block))
    order = ["doc_id", "piece", "n_words", "copy"]
    shard = F.pmod(F.xxhash64(*order), F.lit(shards)).alias("_shard")
    dealt = (full.select(shard, "*").repartition(min(shards, PARTITIONS), "_shard")
             .sortWithinPartitions("_shard", *order))
    names = ["doc_id", "piece", "first_word", "n_words", "bin_id", "bin_capacity", "bin_start"]

    def packed(pdf: pd.DataFrame, shard: int, first_bin: int) -> tuple[pd.DataFrame, int]:
        bins, start, caps = pack_block(pdf["n_words"].tolist(), capacities, overhead, prices)
        bins = np.array(bins)
        out = pdf[["doc_id", "piece", "first_word", "n_words"]].assign(
            bin_id=(shard << 32) + first_bin + bins, bin_capacity=np.array(caps)[bins], bin_start=start)
        return out[names], first_bin + len(caps)

    def run(frames):
        held, shard, bins = [], None, 0

        def flush():
            nonlocal bins
            pdf = pd.concat(held, ignore_index=True)
            held.clear()
            out, bins = packed(pdf, shard, bins)
            return out

        for frame in frames:
            for s, part in frame.groupby("_shard", sort=False):
                if s != shard:
                    if held:
                        yield flush()
                    shard, bins = int(s), 0
                while len(part):
                    room = 2 * block - sum(map(len, held))
                    held.append(part.iloc[:room])
                    part = part.iloc[room:]
                    if sum(map(len, held)) >= 2 * block:
                        yield flush()
        if held:
            yield flush()

    schema = ("doc_id long, piece long, first_word long, n_words long, bin_id long, "
              "bin_capacity long, bin_start long")
    empty = rows.where("n_words = 0").select(
        "doc_id", "piece", "first_word", "n_words", F.lit(None).cast("long").alias("bin_id"),
        F.lit(0).cast("long").alias("bin_capacity"), F.lit(None).cast("long").alias("bin_start"))
    return dealt.mapInPandas(run, schema).unionByName(empty)
