"""Records derived from the ``events`` test table, in Spark's SQL and in DuckDB's.

Every row of the recipe is (k, side, tag, payload, condition); e, u, t0, el, et, kk are event id, user
id, time and duration in microseconds, event type and a property.  seq = 64 e + k, ts = t0 + k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW_BYTES = "666F6F00FF20626172"
#: Base64 of FF FE FD FC, and "Pass" after it: no UTF-8.
NOT_UTF8 = "//79/DphYmM="


def _recipe(duck: bool) -> list[tuple[int, str, str, str, str]]:
    div = (lambda a, n: f"({a} // {n})") if duck else (lambda a, n: f"({a} div {n})")
    text = lambda x: f"cast({x} as string)"
    stamp = lambda x: f"concat({text(div(f'({x})', 1000000))}, '.', lpad({text(f'(({x}) % 1000000)')}, 6, '0'))"
    b64 = (lambda s: f"to_base64(encode({s}))") if duck else (lambda s: f"base64(cast({s} as binary))")
    half = div("el", 2)
    timestamp = lambda name, at, since, last: f"concat('{name}: ', {stamp(at)}, ' ', {stamp(since)}, ' ', {stamp(last)})"
    method = "case when et in ('purchase', 'signup') then 'POST' else 'GET' end"
    url = f"concat('/', et, '/', {text('u')}, case when e % 3 = 0 then concat('?k=', kk, '&u=', {text('u')}) else '' end)"
    host = f"concat('Host: ', case when e % 17 = 0 then 'http://' else '' end, 'www', {text('u % 7')}, '.example.com')"
    user = f"concat('user', {text('u')}, ':pw')"
    auth = f"case when e % 28 = 0 then 'Authorization: Basic {NOT_UTF8}' when e % 4 = 0 then concat('Authorization: Basic ', {b64(user)}) else 'Authorization: Digest x' end"
    call = "case when e % 19 = 0 then 'SYNTH' when et = 'view' then 'HIT' when et = 'click' then 'MISS' when et = 'purchase' then 'PASS' when et = 'error' then 'ERROR' else 'PIPE' end"
    status = "case when et = 'error' then '503' else '200' end"
    acct = f"concat('60 0 60 178 ', {text('el')}, ' ', {text('178 + el')})"
    ends = "e % 50 <> 7"
    rows = [
        (0, "c", "Begin", f"concat('req ', {text('pv')})", "true"),
        (1, "c", "Timestamp", timestamp("Start", "t0", "0", "0"), "true"),
        (2, "c", "Timestamp", timestamp("Req", "t0", "0", "0"), "true"),
        (3, "c", "ReqStart", f"concat('10.0.', {text('u % 256')}, '.', {text('e % 256')}, ' ', {text('20000 + e % 10000')})", "true"),
        (4, "c", "ReqMethod", method, "true"),
        (5, "c", "ReqURL", url, "true"),
        (6, "c", "ReqProtocol", "'HTTP/1.1'", "e % 11 <> 0"),
        (7, "c", "ReqHeader", host, "e % 13 <> 0"),
        (8, "c", "ReqHeader", f"concat('user-agent: Agent/', {text('u % 9')})", "true"),
        (9, "c", "ReqHeader", "concat('User-Agent: second', repeat('x', cast(case when e % 6 = 0 then 60 + e % 7 else 0 end as int)))", "true"),
        (10, "c", "ReqHeader", f"concat('Referer: http://ref.example.com/', {text('u')})", "e % 2 = 0"),
        (11, "c", "ReqHeader", auth, "e % 4 in (0, 1)"),
        (12, "c", "VCL_call", "'RECV'", "true"),
        (13, "c", "VCL_return", "case when et = 'purchase' then 'pass' when et = 'signup' then 'pipe' else 'hash' end", "true"),
        (14, "c", "VCL_call", call, "true"),
        (15, "c", "VCL_Log", "concat('etype: ', et)", "true"),
        (16, "c", "Debug", "'RES_MODE 2'", "true"),
        (17, "c", "Timestamp", timestamp("Process", f"t0 + {half}", half, half), "true"),
        (18, "c", "RespStatus", status, "true"),
        (19, "c", "RespHeader", f"concat('Content-Length: ', {text('el')})", "true"),
        (20, "c", "Timestamp", timestamp("Resp", "t0 + el", "el", f"el - {half}"), "true"),
        (21, "c", "ReqAcct", acct, "et <> 'signup'"),
        (22, "c", "PipeAcct", f"concat('60 60 178 ', {text('el')})", "et = 'signup'"),
        (23, "c", "End", "''", ends),
        (25, "c", "ReqURL", f"concat('/rewritten/', repeat('y', cast(e % 90 as int)), {text('u')})", "e % 8 = 3"),
        (24, "c", "VCL_Log", "concat('note: ', repeat('x', cast(u % 11 as int)), 'Zoë €😀 ü')", "e % 7 = 0"),
    ]
    back = [
        ("Begin", f"concat('bereq ', {text('2 * e + 1')})", "true"),
        ("Timestamp", timestamp("Start", "t0", "0", "0"), "true"),
        ("Backend", f"concat({text('e % 50')}, ' boot default(10.1.0.', {text('u % 5')}, ',,80)')", "true"),
        ("BereqMethod", method, "true"),
        ("BereqURL", url, "true"),
        ("BereqProtocol", "'HTTP/1.1'", "e % 11 <> 0"),
        ("BereqHeader", host, "e % 13 <> 0"),
        ("BereqHeader", auth, "e % 4 in (0, 1)"),
        ("Timestamp", timestamp("Bereq", "t0", "0", "0"), "true"),
        ("Timestamp", timestamp("Beresp", f"t0 + {half}", half, half), "true"),
        ("BerespStatus", status, "true"),
        ("BerespHeader", f"concat('Content-Length: ', {text('el')})", "true"),
        ("Timestamp", timestamp("BerespBody", "t0 + el", "el", f"el - {half}"), "true"),
        ("BereqAcct", acct, "true"),
        ("End", "''", ends),
    ]
    rows += [(32 + i, "b", tag, payload, f"et in ('click', 'purchase') and {cond}") for i, (tag, payload, cond) in enumerate(back)]
    # Transactions without any record that lines are made of.
    rows += [(50 + 2 * i + j, side, tag, "''", "e % 29 = 5") for i, side in enumerate(("c0", "b0")) for j, tag in enumerate(("Begin", "End"))]
    return [*rows, (60, "-", "Backend_health", "'b Still healthy 4--X-RH 5 4 5 0.032728 0.035774 HTTP/1.1 200 OK'", "e % 20 = 0")]


_PARENT = "case when e % 5 in (1, 2) then 2 * (e - e % 5) + 1 when e % 5 = 3 then 2 * (e - 1) + 1 else 0 end"
#: c0 and b0 are further client and backend transactions of an event.
_VXID = {"c": "2 * e + 1", "b": "2 * e + 2", "-": "0", "c0": "2 * e + 1000000000001", "b0": "2 * e + 1000000000002"}
_PVXID = {"c": "pv", "b": "2 * e + 1", "-": "0", "c0": "0", "b0": "2 * e + 1000000000001"}


def _late(tag: str) -> str:
    return "el + case when e % 53 = 11 then 300000000 else 0 end" if tag == "End" else "0"


def records_from_events(events: DataFrame) -> DataFrame:
    """The record table of the events; events with a null id, time or value give none."""
    base = events.select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t0"),
        F.round(F.col("value") * 100).cast("long").alias("el"), F.col("event_type").alias("et"), F.get_json_object("props", "$.k").alias("kk"),
    ).where("e is not null and t0 is not null and el is not null")
    base = base.withColumn("pv", F.expr(_PARENT))
    one = "case when {c} then named_struct('k', {k}, 'ts', t0 + {k} + {late}, 'vxid', {v}, 'pvxid', {p}, 'side', '{s}', 'tag', '{t}', 'payload', {x}) end"
    items = [one.format(c=c, k=k, late=_late(t), v=f"cast({_VXID[s]} as bigint)", p=f"cast({_PVXID[s]} as bigint)", s=s[0], t=t, x=x) for k, s, t, x, c in _recipe(False)]
    rows = base.select("e", F.explode(F.expr(f"filter(array({', '.join(items)}), x -> x is not null)")).alias("r"))
    raw = F.when((F.col("r.tag") == "Debug") & (F.col("e") % 10 == 0), F.unhex(F.lit(RAW_BYTES)))
    return rows.select(
        F.lit("main").alias("instance"), (F.col("e") * 64 + F.col("r.k")).alias("seq"), F.timestamp_micros("r.ts").alias("ts"),
        "r.vxid", "r.pvxid", "r.side", "r.tag", "r.payload", raw.alias("raw"),
    )


def duckdb_records() -> str:
    """``WITH`` clause of the same records for DuckDB (ts in microseconds; is_raw in place of the bytes)."""
    base = (
        "base0 as (select event_id as e, user_id as u, epoch_us(ts) as t0, cast(round(value * 100) as bigint) as el, event_type as et, "
        "json_extract_string(props, '$.k') as kk from events where event_id is not null and ts is not null and value is not null), "
        f"base as (select *, {_PARENT} as pv from base0)"
    )
    parts = [
        f"select 'main' as instance, e * 64 + {k} as seq, t0 + {k} + {_late(t)} as ts, cast({_VXID[s]} as bigint) as vxid, cast({_PVXID[s]} as bigint) as pvxid, "
        f"'{s[0]}' as side, '{t}' as tag, {x} as payload, {'e % 10 = 0' if t == 'Debug' else 'false'} as is_raw from base where {c}"
        for k, s, t, x, c in _recipe(True)
    ]
    return f"with {base}, records as ({' union all '.join(parts)})"
