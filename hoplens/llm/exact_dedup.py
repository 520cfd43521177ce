"""Exact deduplication by deterministic block naming (operator 7, native).

A text is cut into blocks of a fixed number of bytes. Equal blocks get one
integer name: the place of their smallest occurrence. Then adjacent pairs of
names are named in the same way, level by level, until each document has a
single name. Names of a level are equal exactly if the bytes below them are, so
the last name is the document's identity without collisions; a document that
ends at another level has another number of blocks.

Only DataFrame functions are used, and few bytes travel. Blocks with different
lengths or digests are different, so a block whose digest occurs once is named
by its own place. Blocks that share a digest are grouped by their bytes, with
map-side combine: of a block in a third of all rows each input partition sends
one copy. A digest whose blocks all have the same bytes, as ever unless SHA-256
collides, then names its places by a join on the digest; the places of a digest
with several contents are named by their bytes. The few values that many places
share are joined by broadcast, so no task gets all places of one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.llm.common import joined_hot, sieved, stage, whole_rows, with_identity, without

#: Bytes of a block.
BLOCK_BYTES = 4096
#: Places in a document fit this many bits of a name.
PLACE_BITS = 31
_NAME = "decimal(38,0)"
#: Stands for "no block" beside the last name of an odd number; below all names.
_END = -(2 ** 121)


def _place():
    return ((F.col("_k").cast(_NAME) * (1 << PLACE_BITS)).cast(_NAME) + F.col("at").cast(_NAME)
            + F.col("_dup").cast(_NAME) * F.lit(str(2 ** 95)).cast(_NAME)).cast(_NAME)


def _least(rows: DataFrame, content: list[str], name: str) -> DataFrame:
    """(content, least, copies): the smallest place of each value that has several. Stored."""
    return stage(rows.groupBy(*content).agg(F.min(_place()).alias("least"), F.count("*").alias("copies")).where("copies > 1"), name)


def _named(rows: DataFrame, content: list[str], names: DataFrame) -> DataFrame:
    """Replace the columns ``content`` of each place by the name of their value."""
    return (joined_hot(rows, names.select(*content, "least", "copies"), content, "copies")
            .withColumn("name", F.coalesce("least", _place())).drop(*content, "least", "copies"))


def _first_names(blocks: DataFrame) -> DataFrame:
    """Names of the blocks themselves: ``blocks`` has the columns block (bytes),
    size and digest besides those of the place."""
    key = ["size", "digest"]
    places = stage(blocks.drop("block"), "places")
    shared = _least(places, key, "shared")
    # one copy of the bytes for each partition that has them; those of other digests stay
    contents = sieved(blocks, shared, *key).groupBy(*key, "block").agg(F.min(_place()).alias("least"))
    clash = stage(contents.groupBy(*key).agg(F.count("*").alias("contents")).where("contents > 1").select(*key), "clash")
    if clash.isEmpty():
        return _named(places, key, shared)
    one = _named(places.join(clash, key, "left_anti"), key, shared.join(clash, key, "left_anti"))
    several = contents.join(clash, key, "left_semi").withColumn("copies", F.lit(1))
    return one.unionByName(_named(blocks.join(clash, key, "left_semi"), [*key, "block"], several))


def document_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_k, _dup, doc_id, text_sha256, level, name): the identity of each text
    is (level, name). Stored."""
    rows = with_identity(docs.select(F.col("doc_id").cast("long"),
                                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")),
                         "doc_id", "text")
    data = F.col("text").cast("binary")
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                      lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))
    # the digest of the text belongs to the document: only its first block carries it
    occ = (rows.withColumn("n", blocks)
           .select("_k", "_dup", "doc_id", "n", F.sha2(data, 256).alias("sha"),
                   F.posexplode(cut).alias("at", "block"))
           .withColumn("sha", F.when(F.col("at") == 0, F.unhex("sha")))
           .withColumn("size", F.octet_length("block")).withColumn("digest", F.unhex(F.sha2("block", 256))))
    named = stage(_first_names(occ), "names0")
    single = named.where("n = 1").select("_k", "_dup", F.lit(0).alias("level"), "name")
    levels = [single]
    most = named.agg(F.max("n")).first()[0] or 1
    rows, level = named.where("n > 1").select("_k", "_dup", "at", "n", "name"), 0
    while most > 1:
        level, most = level + 1, -(-most // 2)
        odd = F.col("at") % 2 == 1
        pairs = stage(rows.groupBy("_k", "_dup", F.floor(F.col("at") / 2).cast("int").alias("at"))
                      .agg(F.max(F.when(~odd, F.col("name"))).alias("left"),
                           F.coalesce(F.max(F.when(odd, F.col("name"))),
                                      F.lit(str(_END)).cast(_NAME)).alias("right"),
                           F.ceil(F.max("n") / 2).cast("int").alias("n")), f"pairs{level}")
        value = ["left", "right"]
        named_pairs = stage(_named(pairs, value, _least(pairs, value, f"least{level}")), f"names{level}")
        levels.append(named_pairs.where("n = 1").select("_k", "_dup", F.lit(level).alias("level"), "name"))
        rows = named_pairs.where("n > 1")
    names = levels[0]
    for more in levels[1:]:
        names = names.unionByName(more)
    heads = named.where("at = 0").select("_k", "_dup", "doc_id",
                                         F.lower(F.hex("sha")).alias("text_sha256"))
    return stage(heads.join(names, ["_k", "_dup"]), "identities")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: _k, _dup, doc_id, keep_id, group_size, kept,
    text_sha256. Of equal texts the row with the largest doc_id stays.

    Null text counts as empty; a null doc_id is the smallest. Rows that share
    a doc_id are documents of their own: of equal ones the last stays. An empty
    table gives an empty result; other columns are not looked at.
    """
    names = document_names(docs, block_bytes)
    last = F.max(F.struct("_k", "_dup", "doc_id"))
    groups = stage(names.groupBy("level", "name").agg(last.alias("_last"), F.count("*").alias("group_size"))
                   .where("group_size > 1"), "groups")
    alone = F.col("group_size").isNull()
    kept = alone | (F.col("_k") == F.col("_last._k")) & (F.col("_dup") == F.col("_last._dup"))
    return joined_hot(names, groups, ["level", "name"], "group_size").select(
        "_k", "_dup", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("_last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that stay, with all columns of ``docs``."""
    dropped = stage(exact_duplicates(docs, block_bytes).where("not kept").select("_k", "_dup"), "dropped")
    return without(whole_rows(docs, "doc_id", "text"), dropped, "_k", "_dup").select("_row.*")
