"""From records to transactions: one row per transaction, one column per slot."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txlog.functions import header_name
from txlog.schema import KEY, Slot

#: What VCL calls and returns decide the disposition.
DISPOSITIONS = ("hit", "miss", "pass", "error", "pipe")
DISPOSITION_TAGS = ("VCL_call", "VCL_return")
TIMEOUT_S = 120


def check_grouping(grouping: str, sides: Iterable[str] = ()) -> None:
    """Raise for groupings that don't exist or don't go with the sides that have a format."""
    if grouping not in ("vxid", "request", "raw"):
        raise ValueError(f"grouping {grouping} is not supported")
    if grouping == "raw" and {*sides} & {"c", "b"}:
        raise ValueError("raw grouping goes with raw formats only")


def _slot_condition(slot: Slot) -> Column:
    here = F.col("tag") == slot.tag
    return here & (F.col("hname") == slot.header.upper()) if slot.header else here


def _first(value: Column, condition: Column) -> Column:
    """The value of the record with the lowest seq that meets the condition."""
    return F.min_by(F.when(condition, value), F.when(condition, F.col("seq")))


def disposition() -> Column:
    """Aggregate: the first call or return that names a disposition."""
    named = F.col("tag").isin(*DISPOSITION_TAGS) & F.lower("payload").isin(*DISPOSITIONS)
    return _first(F.lower("payload"), named)


def assemble(
    records: DataFrame,
    slots: Iterable[Slot],
    where: Column | None = None,
    binary_tags: Iterable[str] = (),
    with_disposition: bool = True,
    include_open: bool = True,
    keep: Iterable[str] = (),
    needed: Column | None = None,
    extra: Mapping[str, Column] | None = None,
    max_reclen: int | None = None,
    reused: bool = False,
) -> DataFrame:
    """One row per (instance, vxid, side): pvxid, ts, seq of the first record, n_recs (records some slot needs),
    disposition, the slots' payloads, and for ``binary_tags`` their bytes (``raw:<tag>``).

    ``where`` keeps whole transactions with a record that satisfies it, in the same aggregate.  Without
    ``include_open`` transactions without an End record are dropped.  The only exchange is on the key;
    give records that are already cut to the tags and headers that the slots need.  ``needed`` says which
    records n_recs counts instead; ``extra`` are further aggregates by name.

    With ``max_reclen`` records have a column ``size`` (of the uncut payload, terminator included), and len_hi and
    len_overflows are the longest of the payloads that fill slots and how many of them exceed it; a record
    that fills two slots counts once.

    With ``reused`` a vxid may name several transactions one after the other: each Begin (of its side, by seq) starts a new one,
    numbered in ``epoch``; records before the first Begin are of epoch 0.  The count shares the one exchange."""
    slots = sorted(set(slots))
    rows = records.where("side <> '-'")
    if any(s.header for s in slots):
        tagged = F.col("tag").isin(*sorted({s.tag for s in slots if s.header}))
        rows = rows.withColumn("hname", F.when(tagged, header_name(F.col("payload"))))
    payload = F.coalesce("payload", F.lit(""))
    if needed is None:
        needed = F.lit(False)
        for s in slots:
            needed = needed | _slot_condition(s)
        if with_disposition:
            needed = needed | F.col("tag").isin(*DISPOSITION_TAGS)
    aggs = [F.max("pvxid").alias("pvxid"), F.min("ts").alias("ts"), F.min("seq").alias("seq"), F.count(F.when(F.coalesce(needed, F.lit(False)), 1)).alias("n_recs")]
    if with_disposition:
        aggs.append(disposition().alias("disposition"))
    binary = {s for s in slots if not s.header and s.tag in {*binary_tags}}
    for s in slots:
        value = {"payload": payload} | ({"raw": F.col("raw")} if s in binary else {})
        if max_reclen is not None:
            value |= {"size": F.col("size"), "seq": F.col("seq")}
        chosen = payload if len(value) == 1 else F.struct(*[v.alias(k) for k, v in value.items()])
        aggs.append(_first(chosen, _slot_condition(s)).alias(s.column))
    aggs += [F.first(c, ignorenulls=True).alias(c) for c in keep] + [a.alias(name) for name, a in (extra or {}).items()]
    if where is not None:
        aggs.append(F.max(F.coalesce(where, F.lit(False))).alias("wanted"))
    if not include_open:
        aggs.append(F.max(F.col("tag") == "End").alias("ended"))
    group = [*KEY, "side"]
    if reused:
        begun = F.count(F.when(F.col("tag") == "Begin", 1)).over(Window.partitionBy(*group).orderBy("seq"))
        rows, group = rows.withColumn("epoch", begun), [*group, "epoch"]
    tx = rows.groupBy(*group).agg(*aggs)
    if where is not None:
        tx = tx.where("wanted").drop("wanted")
    if not include_open:
        tx = tx.where("ended").drop("ended")
    get = lambda s: F.col(f"`{s.column}`")
    if max_reclen is not None:
        tx = tx.withColumns(slot_lengths(slots, get, max_reclen))
    if binary:
        tx = tx.withColumns({f"raw:{s.tag}": get(s)["raw"] for s in slots if s in binary})
    nested = [s for s in slots if s in binary or max_reclen is not None]
    return tx.withColumns({s.column: get(s)["payload"] for s in nested}) if nested else tx


def slot_lengths(slots: Iterable[Slot], get: Callable[[Slot], Column], max_reclen: int) -> dict[str, Column]:
    """len_hi and len_overflows of slots that hold structs with ``size`` and ``seq``.  A record with a header may fill its tag's
    plain slot, too: it counts once."""
    slots = [*slots]
    sizes = [get(s)["size"] for s in slots if not s.header or Slot(s.tag) not in slots]
    sizes += [F.when(get(s)["seq"] != get(Slot(s.tag))["seq"], get(s)["size"]) for s in slots if s.header and Slot(s.tag) in slots]
    zero = F.lit(0).cast("long")
    return {"len_hi": F.greatest(zero, zero, *sizes), "len_overflows": sum((F.when(n > max_reclen, 1).otherwise(0) for n in sizes), zero)}


def drop_empty(tx: DataFrame, nonrecs_wanted: bool = False) -> DataFrame:
    """Without transactions that hold no record any slot needs, unless the format needs none."""
    return tx if nonrecs_wanted else tx.where("n_recs > 0")


def raw_transactions(records: DataFrame) -> DataFrame:
    """Every record a transaction of its own, at its read time; no shuffle."""
    return records.select("instance", "seq", "ts", "vxid", "tag", "payload", "raw")


def mark_incomplete(records: DataFrame, slots: Iterable[Slot], timeout_s: int = TIMEOUT_S, **how) -> DataFrame:
    """Assembled transactions with ``status``: complete, timeout (the End came later than ``timeout_s``
    after Begin; records from then on are dropped), or open (no End).  Window and aggregate share one exchange."""
    key = Window.partitionBy(*KEY)
    begin = F.min(F.when(F.col("tag") == "Begin", F.col("ts"))).over(key)
    rows = records.where("side <> '-'").withColumn("deadline", begin + F.expr(f"interval {timeout_s} seconds"))
    ended = F.max(F.when(F.col("tag") == "End", F.col("ts"))).over(key)
    rows = rows.withColumn("status", F.when(ended.isNull(), "open").when(ended > F.col("deadline"), "timeout").otherwise("complete"))
    rows = rows.where(F.col("deadline").isNull() | (F.col("ts") <= F.col("deadline")))
    return assemble(rows, slots, keep=["status"], **how)
