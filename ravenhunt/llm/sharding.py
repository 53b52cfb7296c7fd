"""Operator 1, sharding: balanced label propagation.

Documents with equal texts are linked (through a node that stands for their
text, so a group of n copies is n links, not n * n). All documents start in
shards whose counts are at most one apart. Then rounds of Spark joins move each
linked document towards the shard that most of its neighbours are in, under
quotas that keep every shard's count as it is: a document moves from shard i to
j only against one that moves from j to i, either another linked document that
wants to, or one without links, which is at home anywhere. So after every round
the counts are still at most one apart, and the cut links only become fewer.

A group of more than half a shard is split into linked parts of that size, by
rank, because no shard could hold it. All sizes that matter to one task are
bounded: ranks within shards, moves and groups are counted in hash buckets
(``with_rank``), neighbour counts are aggregated before the shuffle, and only
the table of moves between shards (shards * shards rows) is broadcast.

Only DataFrame functions run here.

Defined results: a null text has no bytes (size 16, checksum of nothing) and no
links; empty texts are equal to each other; repeated rows are documents of
their own; a null doc_id is placed like any other row; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenhunt.llm.common import with_rank
from ravenhunt.session import drop_scratch, scratch_table

SHARDS, ROUNDS = 40, 6


def linked_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, link): link is null without an equal text elsewhere."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
    )
    return scratch_table(rows, "sizes")


def _count(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc_id, text) with size, text_crc32, shard and slot."""
    rows = linked_documents(docs)
    total = rows.count()
    groups = _count(rows.filter("key is not null"), "key").filter("n > 1")
    rows = rows.join(groups, "key", "left").withColumn("key", F.when(F.col("n").isNotNull(), F.col("key")))
    part = max(1, total // shards // 2)
    linked = with_rank(rows.filter("key is not null"), ["key"], ["doc_id"], "r")
    linked = linked.withColumn("link", F.xxhash64("key", F.floor(F.col("r") / part)))
    rows = linked.select("doc_id", "size", "text_crc32", "link").unionByName(
        rows.filter("key is null").select("doc_id", "size", "text_crc32", F.lit(None).cast("long").alias("link")))
    rows = with_rank(rows, [], ["doc_id", "text_crc32", "size"], "uid")
    rows = scratch_table(rows.withColumn("shard", F.pmod("uid", F.lit(shards)).cast("int")).drop("uid"), "labels")
    for _ in range(rounds):
        moved = _propagate(rows)
        if moved is None:
            break
        drop_scratch(rows)
        rows = moved
    return with_rank(rows, ["shard"], ["doc_id", "text_crc32"], "slot")


def _propagate(rows: DataFrame) -> DataFrame | None:
    """One round; None when no document wants to move."""
    linked = rows.filter("link is not null")
    here = _count(linked, "link", "shard").withColumn("t", F.struct("n", F.xxhash64("link", "shard").alias("h"), "shard"))
    target = here.groupBy("link").agg(F.max("t").alias("t")).select("link", F.col("t.shard").alias("target"))
    linked = scratch_table(linked.join(target, "link"), "wanted")
    movers = linked.filter("shard <> target")
    wants = scratch_table(_count(movers, "shard", "target"), "wants")  # at most shards * shards rows
    if wants.isEmpty():
        drop_scratch(linked, wants)
        return None
    # against each other, first come first served; the rest against documents without links
    back = wants.select(F.col("shard").alias("target"), F.col("target").alias("shard"), F.col("n").alias("back"))
    quota = wants.join(F.broadcast(back), ["shard", "target"], "left").select(
        "shard", "target", "n", F.least("n", F.coalesce("back", F.lit(0))).alias("swaps"))
    quota = quota.selectExpr(
        "shard", "target", "swaps",
        "coalesce(sum(n - swaps) over (partition by target order by shard"
        " rows between unbounded preceding and 1 preceding), 0) as first", "n - swaps as rest")
    free = rows.filter("link is null").withColumnRenamed("shard", "target")
    quota = quota.join(F.broadcast(_count(free, "target").withColumnRenamed("n", "free")), "target", "left")
    quota = scratch_table(quota.fillna(0, ["free"]), "quota")
    few = F.broadcast(quota)
    ranked = with_rank(movers, ["shard", "target"], ["doc_id", "link"], "r").join(few, ["shard", "target"])
    goes = (F.col("r") < F.col("swaps")) | (F.col("first") + F.col("r") - F.col("swaps") < F.col("free"))
    columns = ["doc_id", "size", "text_crc32", "link"]
    after = ranked.select(*columns, F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard"))
    stay = linked.filter("shard = target").select(*columns, "shard")
    # the r-th document without links of a shard goes where the r-th admitted one came from
    ends = quota.filter("rest > 0").select(F.col("target").alias("t"), F.col("shard").alias("source"), "first", (F.col("first") + F.col("rest")).alias("end"))
    free = with_rank(free, ["target"], ["doc_id", "text_crc32"], "r")
    free = free.join(F.broadcast(ends), (F.col("target") == F.col("t")) & (F.col("r") >= F.col("first")) & (F.col("r") < F.col("end")), "left")
    free = free.select(*columns, F.coalesce("source", "target").alias("shard"))
    out = scratch_table(stay.unionByName(after).unionByName(free), "labels")
    drop_scratch(linked, wants, quota)
    return out
