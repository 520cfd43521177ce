"""Near-duplicate documents by ProbMinHash (operator 4).

A document is its five-word shingles, weighted by how often they occur. Each
shingle is a Poisson process whose rate is its weight; its arrivals, drawn from
the shingle's hash alone, each go to a random register, and a register keeps
the shingle that arrives first. Arrivals later than the latest register change
nothing, so a shingle stops there. Two documents agree in a register with the
probability Jaccard similarity of their weighted shingles.

Documents with the same words are one class. Classes that agree in a band of
registers are candidates. A band's bucket is not expanded into all pairs: its
members are compared with the bucket's most central class (that whose buckets
are the largest), in the exact probability Jaccard similarity; links that are
found join groups (distributed components). Where a bucket still has members of
different groups, each that is outside the bucket's largest group is compared
with all members of other groups, exactly and without exception, in blocks of
bounded size. The groups are those of all pairs: a pair that is left out has
both ends in one group already. Only texts of classes that are compared, and
bands of shared buckets, enter a shuffle (``sieved``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoplens.llm.common import (connected_components, mix, packed, sieved, small, stage, unpacked, utf8,
                                whole_rows, with_identity, without, word_hashes)

WORDS, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.99993.
BANDS, ROWS = 24, 5
#: Documents that are compared with one other in a group, and with each other in a block.
FAN, BLOCK = 256, 256
#: Bytes of compressed text that a task opens at once.
SLICE = 1 << 18


def shingles(words: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their weights. A text of fewer
    words has one shingle, of all of them; one without words has none."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0)
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - n + 1 + i]
    u, count = np.unique(mix(h), return_counts=True)
    return u, count.astype(np.float64)


def _draws(elements: np.ndarray, seed: int) -> np.ndarray:
    return mix(elements ^ np.uint64(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (1 << 64) - 1))


def probminhash(elements: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The element that arrives first in each register."""
    first = np.full(registers, np.inf)
    winner = np.zeros(registers, np.uint64)
    elements, rate, time = elements, weights, np.zeros(len(elements))
    step = 0
    while len(elements):
        u = (_draws(elements, 2 * step) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        time = time - np.log1p(-u) / rate  # the next arrival
        early = time < first.max()  # later ones can change no register
        elements, rate, time = elements[early], rate[early], time[early]
        at = (_draws(elements, 2 * step + 1) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        winner[at[won]] = elements[won]
        step += 1
    return winner


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact: sum over shared i of 1 / sum_j max(x_j / x_i, y_j / y_i). The
    inner sum takes x_j where x_j / y_j >= x_i / y_i, else y_j; with all
    elements in order of that ratio it is two running sums."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    sx, sy = x[i], y[j]
    ratio = sx / sy
    order = np.argsort(ratio, kind="stable")
    r = ratio[order]
    only_x, only_y = x.sum() - sx.sum(), y.sum() - sy.sum()
    x_from = np.concatenate([np.cumsum(sx[order][::-1])[::-1], [0]]) + only_x
    y_to = np.concatenate([[0], np.cumsum(sy[order])]) + only_y
    cut = np.searchsorted(r, r, "left")
    return float((1 / (x_from[cut] / sx[order] + y_to[cut] / sy[order])).sum())


def _class_key(words: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(words.tobytes())


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(_k, _dup, doc_id, words, bands): a key of the sequence of words (null
    without words) and the bands' values, of every whole text."""
    def sign(batches):
        for b in small(batches, 3):
            data, offs = utf8(b.column(3))
            hashes, first = word_hashes(data, offs)
            keys, values = [], []
            for i in range(len(offs) - 1):
                words = hashes[first[i]:first[i + 1]]
                if not len(words):
                    keys.append(None)
                    values.append(None)
                    continue
                keys.append(_class_key(words))
                sig = probminhash(*shingles(words), bands * rows).reshape(bands, rows)
                band = np.zeros(bands, np.uint64)
                for r in range(rows):
                    band = mix(band + sig[:, r])
                values.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.int64()))],
                names=["_k", "_dup", "doc_id", "words", "bands"])

    out = with_identity(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id", "text")
    return out.select("_k", "_dup", "doc_id", "text").mapInArrow(
        sign, "_k long, _dup int, doc_id long, words binary, bands array<long>")


def verified(texts: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of classes whose similarity reaches the threshold.

    Each b meets the text of its a in a group of at most about FAN: a hub's
    partners are dealt to as many groups as they need, each with a copy of the
    hub's text. ``texts`` has (id, z) of the documents.
    """
    fan = stage(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("parts")), "fan")
    dealt = pairs.join(fan, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    hubs = fan.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    wanted = dealt.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("role")).unionByName(
        hubs.select(F.col("a").alias("id"), "a", "part", F.lit(0).alias("role")))
    rows = (texts.join(wanted, "id").select("a", "part", "role", "id", "z")
            .repartition("a", "part").sortWithinPartitions("a", "part", "role", "id"))

    def compare(batches):
        hub, base = None, None
        for b in small(batches, 4, SLICE):
            data, offs = unpacked(b.column(4))
            hashes, first = word_hashes(data, offs)
            out = []
            for i, (a, part, role, id_) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
                own = shingles(hashes[first[i]:first[i + 1]])
                if role == 0:
                    hub, base = (a, part), own
                elif hub == (a, part) and probability_jaccard(*base, *own) >= threshold - 1e-9:
                    out.append((a, id_))
            yield pairs_batch(out)

    return rows.mapInArrow(compare, "a long, b long")


def block_links(left: list, right: list, threshold: float) -> list[tuple[int, int]]:
    """Pairs of ``left`` and ``right`` in different groups that are similar
    enough, as a spanning forest of the groups: those that an earlier pair has
    joined are not compared again, so there are fewer pairs than groups. Entries
    are (id, group, shingles, weights). For one left document
    its shingles are marked, and one pass over all right shingles gives the
    shared weight of every right document: with all weights 1 that is the
    similarity, else a bound of it (no document shares more than the part of
    its weight that is shared), and the few above the bound are computed."""
    if not left or not right:
        return []
    ids = np.array([r[0] for r in right])
    codes = np.unique(np.array([r[1] for r in [*left, *right]]), return_inverse=True)[1]
    joined = np.arange(len(codes))  # of each group: the group that stands for it
    groups = codes[len(left):]
    sizes = np.array([len(r[2]) for r in right])
    weights = np.concatenate([r[3] for r in right])
    known, code = np.unique(np.concatenate([r[2] for r in right]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(weights, starts)
    plain = total == sizes
    out = []

    def link(id_, group, r):
        if joined[groups[r]] != joined[group]:
            out.append((id_, int(ids[r])))
            joined[joined == joined[groups[r]]] = joined[group]

    for (id_, _, own, weight), group in zip(left, codes):
        other = (joined[groups] != joined[group]) & (ids != id_)
        if not other.any():
            continue
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        hit = known[at] == own
        mark = np.zeros(len(known))
        mark[at[hit]] = weight[hit]
        shared = np.add.reduceat(np.where(mark[code] > 0, weights, 0.0), starts)
        mass = weight.sum()
        if mass == len(own):  # set against sets: exact
            sim = shared / (mass + sizes - shared)
            for r in np.flatnonzero(other & plain & (sim >= threshold - 1e-9)):
                link(id_, group, r)
            other &= ~plain
        reach = np.add.reduceat(mark[code], starts) / mass  # the left document's shared part
        for r in np.flatnonzero(other & (np.minimum(shared / total, reach) >= threshold - 1e-9)):
            if joined[groups[r]] != joined[group] and \
                    probability_jaccard(own, weight, right[r][2], right[r][3]) >= threshold - 1e-9:
                link(id_, group, r)
    return out


def verified_blocks(texts: DataFrame, open_: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) between members of a bucket that are in different groups,
    enough of them to connect the groups of a cell, not all.

    ``open_``: band, value, id, group, minor (not in the bucket's largest
    group). Minor members are the rows and all members the columns of a grid of
    blocks; a cell of the grid is compared in one go and holds at most two
    blocks of texts.
    """
    key = ["band", "value"]
    size = open_.groupBy(*key).agg(F.ceil(F.sum(F.col("minor").cast("int")) / BLOCK).cast("int").alias("rows"),
                                   F.ceil(F.count("*") / BLOCK).cast("int").alias("cols"))
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    cells = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = open_.join(stage(size, "sizes"), key).withColumn("own_row", F.when(F.col("minor"), spot("rows")).otherwise(-1)) \
        .withColumn("own_col", spot("cols"))
    as_col = F.transform(cells("rows"), lambda r: F.struct(r.alias("row"), F.col("own_col").alias("col")))
    as_row = F.transform(cells("cols"), lambda c: F.struct(F.col("own_row").alias("row"), c.alias("col")))
    cell = F.explode(F.when(F.col("minor"), F.array_union(as_col, as_row)).otherwise(as_col)).alias("cell")
    spread = placed.select(*key, "id", "group", "own_row", "own_col", cell).select(
        *key, "cell.row", "cell.col", "id", "group", (F.col("own_row") == F.col("cell.row")).alias("is_row"),
        (F.col("own_col") == F.col("cell.col")).alias("is_col"))
    sort = [*key, "row", "col"]
    rows = (texts.join(spread, "id").select(*sort, "id", "group", "is_row", "is_col", "z")
            .repartition(*sort).sortWithinPartitions(*sort, "id"))

    def compare(batches):
        at, left, right = None, [], []
        for b in small(batches, 8, SLICE):
            data, offs = unpacked(b.column(8))
            hashes, first = word_hashes(data, offs)
            out = []
            for i, (*spot_, id_, group, is_row, is_col) in enumerate(zip(*(b.column(c).to_pylist() for c in range(8)))):
                if spot_ != at:
                    out += block_links(left, right, threshold)
                    at, left, right = spot_, [], []
                entry = id_, group, *shingles(hashes[first[i]:first[i + 1]])
                if is_row:
                    left.append(entry)
                if is_col:
                    right.append(entry)
            yield pairs_batch(out)
        yield pairs_batch(block_links(left, right, threshold))

    return rows.mapInArrow(compare, "a long, b long").distinct()


def pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                       pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def numbered(seen: DataFrame) -> Column:
    """One number by which a document is found again: its id, or, for the second
    and later rows of an id, a hash of id and place. A hash that meets another
    number is found by counting, and all hashes are drawn anew."""
    seed = 0
    while True:
        number = F.when(F.col("_dup") == 0, F.col("_k")).otherwise(F.xxhash64("_k", "_dup", F.lit(seed)))
        later = seen.where("_dup > 0").select(number.alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        if later.isEmpty():
            return number
        first = seen.where("_dup = 0").select(F.col("_k").alias("id"), F.lit(1).alias("n"))
        if sieved(first, later, "id").unionByName(later).groupBy("id").agg(F.sum("n").alias("n")) \
                .where("n > 1").isEmpty():
            return number
        seed += 1


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS,
                          rows: int = ROWS) -> DataFrame:
    """One row per document: _k, _dup, doc_id, copy_id (smallest doc_id with the
    same words), class_id (smallest doc_id of its group of near duplicates),
    class_size, kept (one document of each group: that with class_id).

    Links are transitive. Words are what spaces separate, unchanged. Null and
    empty texts, and those of spaces only, are groups of one. A null doc_id is
    the smallest id. Rows that share a doc_id are documents of their own. An
    empty table gives an empty result.
    """
    seen = stage(signed(docs, bands, rows), "signed")
    number = numbered(seen)
    seen = seen.withColumn("id", number)
    first = F.min(F.struct("_k", "_dup", "doc_id", "id", "bands")).alias("first")
    classes = stage(seen.where("words is not null").groupBy("words").agg(first)
                    .select("words", F.col("first.id").alias("id"), F.col("first.bands").alias("bands")), "classes")
    members = stage(classes.select("id", F.posexplode("bands").alias("band", "value")), "bands")
    buckets = members.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stage(buckets, "buckets")
    shared = stage(sieved(members, buckets, "band", "value").join(buckets, ["band", "value"]), "shared")
    central = stage(shared.groupBy("id").agg(F.sum("n").alias("central")), "central")
    lead = (shared.join(central, "id").groupBy("band", "value")
            .agg(F.min(F.struct((-F.col("central")).alias("most"), "id"))["id"].alias("a")))  # -id overflows for a null id
    shared = shared.join(stage(lead, "lead"), ["band", "value"]).select("band", "value", "a", "id")
    star = stage(shared.where("a <> id").select("a", F.col("id").alias("b")).distinct(), "star")
    texts = (with_identity(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id", "text")
             .withColumn("id", number).select("id", "text"))
    ids = star.select(F.col("a").alias("id")).union(star.select("b"))
    links = stage(verified(packed(sieved(texts, ids, "id")), star, threshold), "links")
    groups = stage(connected_components(links), "groups")
    # members of a bucket that are still apart
    placed = stage(shared.join(groups, "id", "left")
                   .select("band", "value", "id", F.coalesce("component", "id").alias("group")), "placed")
    key = ["band", "value"]
    held = placed.groupBy(*key, "group").agg(F.count("*").alias("n"))
    split = (held.groupBy(*key).agg(F.max(F.struct("n", "group"))["group"].alias("largest"),
                                    F.count("*").alias("groups")).where("groups > 1").drop("groups"))
    open_ = stage(placed.join(stage(split, "split"), key)
                  .withColumn("minor", F.col("group") != F.col("largest")).drop("largest"), "open")
    more = stage(verified_blocks(packed(sieved(texts, open_, "id")), open_, threshold), "more")
    if not more.isEmpty():
        groups = stage(connected_components(links.unionByName(more)), "groups")
    placed = stage(classes.select("words", "id").join(groups, "id", "left")
                   .select("words", F.coalesce("component", "id").alias("group")), "class-groups")
    rows_ = seen.select("_k", "_dup", "doc_id", "id", "words").join(placed, "words", "left")
    rows_ = rows_.withColumn("group", F.coalesce("group", "id"))
    least = F.min(F.struct("_k", "_dup", "doc_id")).alias("least")
    rows_ = stage(rows_, "rows")
    per = stage(rows_.groupBy("group").agg(least, F.count("*").alias("class_size")), "per-group")
    copy = stage(rows_.where("words is not null").groupBy("words").agg(least)
                 .select("words", F.col("least.doc_id").alias("copy_id"), F.lit(True).alias("_has")), "per-copy")
    kept = (F.col("_k") == F.col("least._k")) & (F.col("_dup") == F.col("least._dup"))
    return rows_.join(per, "group").join(copy, "words", "left").select(
        "_k", "_dup", "doc_id", F.when(F.col("_has"), F.col("copy_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.col("least.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """One document of each group, with all columns of ``docs``."""
    dropped = stage(near_duplicate_groups(docs, **params).where("not kept").select("_k", "_dup"), "dropped")
    return without(whole_rows(docs, "doc_id", "text"), dropped, "_k", "_dup").select("_row.*")
