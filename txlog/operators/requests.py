"""Request grouping: a client transaction together with its descendants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txlog.schema import KEY
from txlog.scratch import materialize


def _roots(ids: DataFrame, hop: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """(instance, vxid, root, depth) along the parents ``up`` of ``hop``, each round doubling the reach; and
    the rows that are still under way after ``rounds``, which lie on a cycle or below one."""
    now = ids.select(*KEY).join(hop, KEY, "left").select(*KEY, F.coalesce("up", "vxid").alias("root"), F.col("up").isNotNull().cast("long").alias("depth"))
    now = materialize(now, "ancestors")
    for _ in range(rounds):
        far = now.select("instance", F.col("vxid").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = now.join(far, ["instance", "root"]).select(*KEY, F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved"))
        moved = materialize(moved, "ancestors")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now, None
    return now, moved.where("moved")


def _cycle_minima(hop: DataFrame, under_way: DataFrame, rounds: int) -> DataFrame:
    """(instance, vxid): the smallest vxid of every cycle.  Rows that never arrive have reached a cycle, and
    every member of a cycle is reached by another."""
    members = materialize(under_way.select("instance", F.col("root").alias("vxid")).distinct(), "cycles")
    low = members.join(hop, KEY).select(*KEY, F.col("up").alias("next"), F.least("vxid", "up").alias("low"))
    for _ in range(rounds):
        far = low.select("instance", F.col("vxid").alias("next"), F.col("next").alias("after"), F.col("low").alias("other"))
        low = materialize(low.join(far, ["instance", "next"]).select(*KEY, F.col("after").alias("next"), F.least("low", "other").alias("low")), "cycle-minima")
    return low.where("vxid = low").select(*KEY)


def request_roots(ids: DataFrame) -> DataFrame:
    """(instance, vxid, root, depth) of (instance, vxid, pvxid): the topmost ancestor that is there, and the
    steps to it.  A row's ancestor pointer doubles its reach with each round, so deep trees take log2(depth)
    rounds; each round is written to the shared folder.  Where parents form a cycle, its smallest vxid is
    the root; a row that names itself is its own root."""
    ids = materialize(ids.select(*KEY, "pvxid").dropDuplicates(KEY), "parents")
    parent = ids.select("instance", F.col("vxid").alias("pvxid"), F.lit(True).alias("there"))
    hop = ids.where("pvxid <> 0 and pvxid <> vxid").join(parent, ["instance", "pvxid"], "left_semi")
    hop = hop.select(*KEY, F.col("pvxid").alias("up"))
    rounds = ids.count().bit_length() + 1
    now, under_way = _roots(ids, hop, rounds)
    if under_way is not None:
        hop = hop.join(_cycle_minima(hop, under_way, rounds), KEY, "left_anti")
        now, under_way = _roots(ids, hop, rounds)
        if under_way is not None:
            raise RuntimeError("parents did not settle")
    return now.withColumn("depth", F.col("depth").cast("int"))


def group_by_request(tx: DataFrame, where: Column | None = None) -> DataFrame:
    """``tx`` with ``root`` and ``depth``; with ``where``, only groups with a transaction that satisfies it.

    ``tx`` is written once; what is joined to find roots and groups are integers only."""
    tx = materialize(tx, "transactions")
    return tx.join(_groups(tx, where), KEY)


def _groups(tx: DataFrame, where: Column | None) -> DataFrame:
    found = request_roots(tx)
    if where is None:
        return found
    hits = tx.where(where).select(*KEY).join(found, KEY).select("instance", "root").distinct()
    return found.join(hits, ["instance", "root"], "left_semi").select(found.columns)


def request_groups(narrow: DataFrame, where: Column) -> DataFrame:
    """(instance, vxid, root, depth) of the transactions of whole groups with one that satisfies ``where``.  The transactions need
    no more than their keys, parents and what the condition looks at: the rest can then be assembled for these groups alone."""
    narrow = materialize(narrow, "narrow")
    return materialize(_groups(narrow, where), "groups")


def order_by_request(tx: DataFrame) -> DataFrame:
    """Members of a group together, in the log's order.  Partitions are ranges of (root, seq), so a group
    of any size may go on in the next partition."""
    order = ["instance", "root", "seq"]
    return tx.repartitionByRange(*order).sortWithinPartitions(*order)


def query_groups(tx: DataFrame, flag: Column) -> DataFrame:
    """Whole groups (of ``tx`` with ``root``) with a transaction for which ``flag`` holds."""
    roots = tx.where(flag).select("instance", "root").distinct()
    return tx.join(roots, ["instance", "root"], "left_semi").select(tx.columns)
