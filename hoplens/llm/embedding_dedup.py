"""Near-duplicate embeddings by random-hyperplane sign hashing (operator 2).

Equal vectors are one class with a count, known by the SHA-256 of its numbers
(32 bytes, so that rows and classes meet without their vectors). Each class is
hashed in L tables:
its bucket in a table is the signs of k random projections. Classes that share
a bucket are compared exactly, as cosine in double precision; a pair that
shares several buckets counts in the first of them only. k follows from the
number of classes (buckets keep their size as data grow) and L from k, so that
a pair at the threshold is found with the probability ``recall`` at any size.

No pair leaves a task: a bucket's task returns, per class, how many vectors it
links with and the smallest class it is connected to in the bucket, so the
output grows with the rows. A bucket above the block size is cut into blocks,
and each pair of blocks is a task of its own; every pair is still compared. A
vector travels once for each table, as floats if it was stored so, with the
signatures of the tables before only, in two or four bytes each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from hoplens.llm.common import connected_components, stage

THRESHOLD = 0.9
#: Probability that a pair at the threshold shares a bucket.
RECALL = 0.999
#: Classes wanted in a bucket, and compared with as many at once. Larger buckets
#: need fewer tables: less to shuffle, more to multiply.
BUCKET, BLOCK = 1024, 2048
#: Products that ``linked`` holds at once.
CELLS = 1 << 20


def tables_for(classes: int, threshold: float = THRESHOLD, recall: float = RECALL,
               bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a signature and number of tables."""
    bits = max(1, round(math.log2(max(2, classes / bucket))))
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(same ** bits, 1 - 1e-9))))


def unit_rows(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with cosine >= threshold; those at the edge are summed again
    without rounding on the way."""
    step = max(1, CELLS // max(1, len(y)))
    out = []
    for at in range(0, len(x), step):
        s = x[at:at + step] @ y.T
        i, j = np.nonzero(s >= threshold - 1e-12)
        edge = np.abs(s[i, j] - threshold) <= 1e-12
        i += at
        for k in np.flatnonzero(edge):
            edge[k] = math.fsum((x[i[k]] * y[j[k]]).tolist()) < threshold - 1e-15
        out.append((i[~edge], j[~edge]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def bucket_links(left: pd.DataFrame, right: pd.DataFrame | None, table: int, threshold: float,
                 width: int) -> pd.DataFrame:
    """(rep, links, root) of the classes of one block, or of two blocks. ``sig``
    has the keys of the tables before ``table``, ``width`` bytes each."""
    right_ = left if right is None else right
    x, y = unit_rows(left["embedding"]), unit_rows(right_["embedding"])
    i, j = linked(x, y, threshold)
    if right is None:
        i, j = i[i < j], j[i < j]
    ids = np.concatenate([left["rep"].to_numpy(), right_["rep"].to_numpy()])
    size = np.concatenate([left["size"].to_numpy(), right_["size"].to_numpy()])
    if table:
        a, b = (np.stack([np.frombuffer(v, np.uint8) for v in f["sig"]]).view(f"<u{width}") for f in (left, right_))
        new = np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            new[part] = ~(a[i[part]] == b[j[part]]).any(axis=1)
    else:
        new = np.ones(len(i), bool)
    n = len(left)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i[new], size[n + j[new]])
    np.add.at(links, n + j[new], size[i[new]])
    root = ids.copy()
    if right is None:
        j_ = j
    else:
        j_ = n + j
    while True:  # smallest id reachable inside the task
        was = root.copy()
        np.minimum.at(root, i, root[j_])
        np.minimum.at(root, j_, root[i])
        if (was == root).all():
            break
    out = pd.DataFrame({"rep": ids, "links": links, "root": root})
    return out[(links > 0) | (root != ids)]


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                    bucket: int = BUCKET, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly),
    component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and so do vectors of different lengths and rows without
    a vec_id (their component_id is null, they are kept). A repeated row is a
    vector of its own and links with its copies; rows that share a vec_id are
    one node of the graph. An empty table gives an empty result; other columns
    (labels) are not looked at.
    """
    single = isinstance(embeddings.schema["embedding"].dataType, ArrayType) and isinstance(
        embeddings.schema["embedding"].dataType.elementType, FloatType)
    number = "float" if single else "double"
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{number}>"))
    sound = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
             & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
             & F.exists("embedding", lambda v: v != 0))
    plain = F.transform("embedding", lambda v: v + F.lit(0.0).cast(number))  # -0 is 0
    named = rows.withColumn("name", F.when(sound, F.unhex(F.sha2(plain.cast("string"), 256))))
    classes = stage(named.where("name is not null").groupBy("name")
                    .agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"),
                         F.first("embedding").alias("embedding")), "classes")
    bits, tables = tables_for(classes.count(), threshold, recall, bucket)
    width = 2 if bits <= 16 else 4 if bits <= 32 else 8

    def sign(frames):
        for pdf in frames:
            for _, part in pdf.groupby(pdf["embedding"].map(len), sort=False):
                sig = signatures(unit_rows(part["embedding"]), bits, tables, seed)
                yield part.assign(sig=list(sig), old=[v.tobytes() for v in sig.astype(f"<u{width}")])

    signed = stage(classes.select("embedding", "rep", "size").mapInPandas(
        sign, f"embedding array<{number}>, rep long, size long, sig array<long>, old binary"), "signed")
    keys = ["dim", "table", "key"]
    dealt = signed.select("rep", F.size("embedding").alias("dim"), F.posexplode("sig").alias("table", "key"))
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    blocks = stage(counts.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), "buckets")
    # one row per bucket of a class and per pair of blocks that its block is in
    own = F.pmod(F.xxhash64("rep", "table"), F.col("blocks")).cast("int")
    pairs = (signed.select("embedding", "rep", "size", "old", F.size("embedding").alias("dim"),
                           F.posexplode("sig").alias("table", "key"))
             .join(blocks, keys).withColumn("own", own)
             .withColumn("sig", F.expr(f"substring(old, 1, table * {width})"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")))

    def compare(key, pdf):
        _, table, _, low, high = key
        pdf = pdf.sort_values("rep")
        if low == high:
            return bucket_links(pdf, None, int(table), threshold, width)
        a, b = pdf[pdf["own"] == low], pdf[pdf["own"] == high]
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        return bucket_links(a, b, int(table), threshold, width)

    found = stage(pairs.select(*keys, "low", "high", "own", "rep", "size", "sig", "embedding")
                  .groupBy(*keys, "low", "high")
                  .applyInPandas(compare, "rep long, links long, root long"), "links")
    graph = connected_components(found.where("root <> rep"), "rep", "root")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per = stage(classes.join(links, "rep", "left")
                .join(graph.withColumnRenamed("id", "rep"), "rep", "left")
                .select("name", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "rep").alias("component")), "per-class")
    out = named.select("vec_id", "name").join(per, "name", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
