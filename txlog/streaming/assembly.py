"""Transactions of a stream at their End: state of open transactions, and what a stopped stream has left in it.

Spark finds out beforehand what each record is to its transaction (the slots it fills, a disposition, Begin or End,
whether a predicate holds); the stateful step in Python only keeps the lowest seq per slot.  What it gives
out is the held state itself, as text, and Spark makes the columns of it: the same way for transactions that the
stream emits and for those that ``pending`` reads from the state of a stopped stream.

A state entry is that of a run of ``2 ** RUN_BITS`` consecutive vxids of an instance: the step takes all of a batch's records
of a run as arrays, so that its costs per call are shared by the run's transactions, and what a batch writes anew are the runs
that have records in it.  Within a run each transaction has its own deadline; the entry's is the first of them.

A transaction that was given out leaves a mark behind for ``remember_s`` seconds of event time (from when it was due),
so that records that come later open no second one: they are dropped, and counted in a row of status ``late``."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from txlog.functions import header_name
from txlog.operators.assemble import DISPOSITION_TAGS, DISPOSITIONS, TIMEOUT_S, _slot_condition, slot_lengths
from txlog.schema import KEY, Slot

_SLOT = "struct<s: bigint, p: string, r: string, z: bigint>"
_HELD = f"struct<slots: map<string, {_SLOT}>, n: bigint, pvxid: bigint, ts: bigint, seq: bigint, begin: bigint, hit: boolean, given: boolean, late: bigint>"
#: What a record is besides a slot's.
_BEGIN, _END = 1, 2
#: Transactions whose vxids differ in this many low bits only share a state entry.
RUN_BITS = 12
_NEVER = (1 << 63) - 1
_OUT = "instance string, vxid bigint, side string, held string, status string"


def _pack(held: dict) -> bytes:
    return zlib.compress(json.dumps(held).encode(), 1)


def _unpack(held: bytes) -> dict:
    """Per transaction of a run, named ``<vxid> <side>``, what is held of it."""
    return json.loads(zlib.decompress(held))


def _rows(instance: str | None, found: list[tuple[str, dict, str]]) -> pd.DataFrame:
    names = [k.split(" ", 1) for k, _, _ in found]
    vxids = pd.array([int(v) if v else None for v, _ in names], "Int64")
    return pd.DataFrame({"instance": [instance] * len(found), "vxid": vxids, "side": [s for _, s in names], "held": [json.dumps(h) for _, h, _ in found], "status": [x for _, _, x in found]})


@dataclass(frozen=True)
class Assembly:
    """What transactions are made of: ``slots``, their disposition, bytes of ``binary_tags``; with ``wanted`` only those are given
    out that have a record with ``_hit``; ``max_reclen`` asks for len_hi and len_overflows."""

    slots: tuple[Slot, ...]
    with_disposition: bool = True
    binary_tags: tuple[str, ...] = ()
    wanted: bool = False
    max_reclen: int | None = None
    timeout_s: int = TIMEOUT_S
    remember_s: int = 3600
    delay: str = "10 seconds"

    def _classes(self) -> dict[tuple[str, str], int]:
        """The conditions of the slots: a record meets one of its tag's and one of its tag's and header's at most."""
        return {k: i for i, k in enumerate(dict.fromkeys((s.tag, s.header.upper()) for s in self.slots))}

    def _marked(self, rows: DataFrame) -> DataFrame:
        """Each record with what it is to its transaction."""
        rows = rows.where("side <> '-'").withColumn("hname", header_name(F.col("payload")))
        plain, headed = ([F.when(_slot_condition(Slot(*k)), i) for k, i in self._classes().items() if bool(k[1]) == h] for h in (False, True))
        fills = [F.coalesce(*found, F.lit(-1)) for found in (plain, headed)]
        filling = (fills[0] >= 0) | (fills[1] >= 0)
        lower = F.lower("payload")
        named = F.coalesce(*[F.when(F.col("tag").isin(*DISPOSITION_TAGS) & (lower == d), i) for i, d in enumerate(DISPOSITIONS) if self.with_disposition], F.lit(-1))
        columns = rows.columns
        needed = F.col("_needed") if "_needed" in columns else filling | (F.col("tag").isin(*DISPOSITION_TAGS) & F.lit(self.with_disposition))
        more = []
        if self.binary_tags:
            more.append(F.when(filling & F.col("tag").isin(*self.binary_tags), F.base64("raw")).alias("raw"))
        if self.max_reclen is not None:
            more.append((F.col("size") if "size" in columns else F.octet_length(F.coalesce("payload", F.lit(""))).cast("long") + 1).alias("size"))
        if self.wanted:
            more.append(F.coalesce("_hit", F.lit(False)).alias("hit"))
        return rows.withWatermark("ts", self.delay).select(
            "instance", F.shiftright("vxid", RUN_BITS).alias("run"), F.coalesce(F.col("vxid").bitwiseAND((1 << RUN_BITS) - 1).cast("int"), F.lit(-1)).alias("place"), "side", "ts",
            F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62))).alias("us"), F.coalesce("seq", F.lit(1 << 62)).alias("seq"), F.coalesce("pvxid", F.lit(0).cast("long")).alias("pvxid"),
            F.when(F.col("tag") == "Begin", _BEGIN).when(F.col("tag") == "End", _END).otherwise(0).alias("kind"), fills[0].alias("plain"), fills[1].alias("headed"), named.alias("named"),
            F.when(filling, F.coalesce("payload", F.lit(""))).alias("payload"), F.coalesce(needed, F.lit(False)).alias("needed"), *more,
        )

    def run(self, rows: DataFrame) -> DataFrame:
        """(instance, vxid, side, held, status) of a stream of records."""
        limit, remember, n_classes = self.timeout_s * 1_000_000, self.remember_s * 1000, len(self._classes())

        def due(held: dict) -> int:
            return (held["begin"] if held["begin"] is not None else held["ts"]) // 1000 + limit // 1000

        def given(held: dict, now: int) -> dict:
            return held | {"slots": {}, "given": True, "until": max(due(held) + remember, now + 1)}

        def first_of(f: pd.DataFrame, tx: np.ndarray, taken: np.ndarray) -> Iterator[tuple[int, str, dict]]:
            """(transaction, slot, its record) of the lowest seq of each slot among the taken records, of equal ones the first."""
            at, slot = [], []
            for c, shift in (("plain", 0), ("headed", 0), ("named", n_classes)):
                value = f[c].to_numpy()
                at.append(np.flatnonzero(taken & (value >= 0)))
                slot.append(value[at[-1]].astype(np.int64) if not shift else np.full(len(at[-1]), shift))
            at, slot = np.concatenate(at), np.concatenate(slot)
            code = tx[at] * (n_classes + 1) + slot
            order = np.lexsort((f["seq"].to_numpy()[at], code))
            order = order[np.r_[True, code[order][1:] != code[order][:-1]]] if len(order) else order
            at, slot = at[order], slot[order].tolist()
            get = lambda c: f[c].to_numpy()[at].tolist() if c in f else [None] * len(at)
            for t, c, seq, payload, named, raw, size in zip(tx[at].tolist(), slot, get("seq"), get("payload"), get("named"), get("raw"), get("size")):
                if c == n_classes:
                    yield t, "d", {"s": seq, "p": DISPOSITIONS[named]}
                else:
                    yield t, str(c), {"s": seq, "p": payload} | ({"r": raw} if isinstance(raw, str) else {}) | ({} if size is None else {"z": int(size)})

        def take(run: int | None, f: pd.DataFrame, held: dict, now: int) -> tuple[list[str], list[tuple[str, dict, str]]]:
            """A batch's records of a run, into ``held``: whose they are, and what is complete or due by them."""
            sides, names = pd.factorize(f["side"])
            codes, tx = np.unique(f["place"].to_numpy().astype(np.int64) * len(names) + sides, return_inverse=True)
            keys = [f"{'' if run is None or p < 0 else (run << RUN_BITS) + p} {names[s]}" for p, s in zip((codes // len(names)).tolist(), (codes % len(names)).tolist())]
            us, kind, n = f["us"].to_numpy(), f["kind"].to_numpy(), len(keys)

            def each(start: int, ufunc: np.ufunc, where: np.ndarray, values: np.ndarray) -> np.ndarray:
                out = np.full(n, start, np.int64)
                ufunc.at(out, tx[where], values[where])
                return out

            before = [held.get(k) for k in keys]
            old = np.array([h is not None and h["given"] for h in before], bool)
            begin = each(_NEVER, np.minimum, kind == _BEGIN, us)
            begin = np.minimum(begin, [_NEVER if h is None or h["begin"] is None else h["begin"] for h in before])
            late = us > np.where(begin < _NEVER, np.minimum(begin, _NEVER - limit) + limit, _NEVER)[tx]
            taken = ~late & ~old[tx]
            count = lambda where: np.bincount(tx[where], minlength=n).tolist()
            counts, lates, needed = count(slice(None)), count(late), count(taken & f["needed"].to_numpy())
            ended, over = count(taken & (kind == _END)), count(late & (kind == _END))
            hits = count(taken & f["hit"].to_numpy()) if self.wanted else count(taken)
            pvxid, seq, ts = each(0, np.maximum, taken, f["pvxid"].to_numpy()), each(1 << 62, np.minimum, taken, f["seq"].to_numpy()), each(1 << 62, np.minimum, taken, us)
            slots: list[dict] = [{} for _ in keys]
            for t, c, first in first_of(f, tx, taken):
                slots[t][c] = first
            found = []
            for k, h, b, all_, late_, need, end, out, hit, p, s, at, new in zip(keys, before, begin.tolist(), counts, lates, needed, ended, over, hits, pvxid.tolist(), seq.tolist(), ts.tolist(), slots):
                if h is not None and h["given"]:
                    h["late"] += all_
                    h["until"] = max(due(h) + remember, now + 1)
                    continue
                if h is None:
                    h = {"slots": {}, "n": 0, "pvxid": 0, "ts": 1 << 62, "seq": 1 << 62, "begin": None, "hit": False, "given": False, "late": 0}
                own = h["slots"]
                own |= {c: x for c, x in new.items() if c not in own or x["s"] < own[c]["s"]}
                h |= {"n": h["n"] + need, "pvxid": max(h["pvxid"], p), "ts": min(h["ts"], at), "seq": min(h["seq"], s), "begin": None if b == _NEVER else b, "hit": h["hit"] or hit > 0, "late": h["late"] + late_}
                if end or out or due(h) <= now:
                    if h["hit"]:
                        found.append((k, h, "complete" if end else "forced"))
                    held[k] = given(h, now)
                else:
                    held[k] = h | {"until": max(due(h), now + 1)}
            return keys, found

        def expire(held: dict, keys: Iterable[str], now: int) -> Iterator[tuple[str, dict, str]]:
            """What is due among the transactions ``keys`` that have no records in this batch."""
            for k in keys:
                h = held[k]
                if h["until"] >= now:
                    continue
                if not h["given"]:
                    if h["hit"]:
                        yield k, h, "forced"
                    held[k] = given(h, now)
                else:
                    del held[k]
                    if h["late"] and h["hit"]:
                        yield k, h, "late"

        def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            held, now, found = _unpack(state.get[0]) if state.exists else {}, state.getCurrentWatermarkMs(), []
            others = {*held}
            if not state.hasTimedOut:
                keys, found = take(None if pd.isna(k[1]) else int(k[1]), pd.concat([*frames], ignore_index=True), held, now)
                others.difference_update(keys)
            found += expire(held, others, now)
            if held:
                state.update((_pack(held),))
                state.setTimeoutTimestamp(min(h["until"] for h in held.values()))
            else:
                state.remove()
            if found:
                yield _rows(k[0], found)

        return self._marked(rows).groupBy("instance", "run").applyInPandasWithState(step, _OUT, "held binary", "append", GroupStateTimeout.EventTimeTimeout)

    def columns(self, found: DataFrame) -> DataFrame:
        """Transactions as ``assemble`` gives them, with status and late (records dropped after they were due or given out)."""
        x = found.withColumn("h", F.from_json("held", _HELD))
        get = lambda name: F.col("h.slots")[F.lit(str(name))]
        place = {s: self._classes()[s.tag, s.header.upper()] for s in self.slots}
        own = [*KEY, "side", F.col("h.pvxid").alias("pvxid"), F.timestamp_micros("h.ts").alias("ts"), F.col("h.seq").alias("seq"), F.col("h.n").alias("n_recs")]
        if self.with_disposition:
            own.append(get("d")["p"].alias("disposition"))
        own += [get(i)["p"].alias(s.column) for s, i in place.items()]
        own += [F.unbase64(get(i)["r"]).alias(f"raw:{s.tag}") for s, i in place.items() if not s.header and s.tag in self.binary_tags]
        if self.max_reclen is not None:
            sized = lambda s: F.struct(get(place[s])["z"].alias("size"), get(place[s])["s"].alias("seq"))
            own += [c.alias(n) for n, c in slot_lengths(self.slots, sized, self.max_reclen).items()]
        return x.select(*own, "status", F.col("h.late").alias("late"))

    def pending(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """What a stopped stream has not given out: its open transactions (status ``open``), and the counts of late records
        (status ``late``).  Reads the state in the stream's checkpoint."""
        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for instance, packed in zip(b["instance"], b["held"]):
                    held = [(k, h, "late" if h["given"] else "open") for k, h in _unpack(packed).items() if h["hit"] and (not h["given"] or h["late"])]
                    if held:
                        yield _rows(instance, held)

        state = spark.read.format("statestore").load(checkpoint)
        return self.columns(state.select("key.instance", F.col("value.groupState.held").alias("held")).mapInPandas(parts, _OUT))
