"""Registered queries over records derived from ``events``, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txlog import operators as O
from txlog import streaming as S
from txlog.fixtures import NOT_UTF8, duckdb_records, records_from_events
from txlog.functions import basic_auth_user, field, header_field, header_value, quote_binary, split_epoch, strftime, url_path, url_query
from txlog.operators.select import equals
from txlog.plans import DEFAULT_FORMAT, format_events, format_raw
from txlog.plans.formats import format_columns, plan
from txlog.schema import RECORD_SCHEMA, Slot
from txlog.scratch import count_files, discard, move_files, scratch_path
from txlog.sources import filter_instance, read_records, stream_folder, stream_lines, stream_records, write_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RAW_FORMAT = "%t %{vxid}x %{tag:Backend_health}x"
BACKEND_LINES = '%d %h %m "%r" %s %b %D %{Varnish:time_firstbyte}x'
FILES = 5
PART_ROWS = 1_000_000
FILE_ROWS = 500_000
#: A batch's transactions are in the state until the next one; Spark's own state store holds them in memory, about 800 bytes each.
BATCH_ROWS = 20_000_000
STREAM_SLOTS = [Slot("ReqStart"), Slot("ReqURL"), Slot("ReqHeader", "User-Agent"), Slot("RespStatus"), Slot("ReqAcct")]


#: sf_dir -> a log saved from its events; what is not there is derived anew by each query.
SAVED: dict[str, str] = {}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    if sf_dir in SAVED:
        return read_records(spark, SAVED[sf_dir])
    events, tasks = spark.read.parquet(f"{sf_dir}/events.parquet"), spark.sparkContext.defaultParallelism
    few = events.rdd.getNumPartitions() < tasks  # each event becomes a few dozen records
    return records_from_events(events.repartition(tasks) if few else events)


def save_records(spark: SparkSession, sf_dir: str) -> str:
    """Write the records once; the queries over ``sf_dir`` then read that log."""
    path = scratch_path(spark, "records")
    records(spark, sf_dir).write.parquet(path)
    SAVED[sf_dir] = path
    return path


def _query(name: str, sql: str | None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Register a function of the record table; ``sql`` reads a table ``records``."""

    def add(fn: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(records(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"{duckdb_records()} {sql}" if not sql.startswith(",") else f"{duckdb_records()}{sql}"
        return fn

    return add


def _us(c: str = "ts") -> Column:
    return F.unix_micros(c).alias("ts_us")


# SQL pieces -----------------------------------------------------------------


def _name(p: str = "payload") -> str:
    return f"case when contains({p}, ':') then upper(trim(split_part({p}, ':', 1))) end"


def _sql_slot(tag: str, header: str = "") -> str:
    cond = f"tag = '{tag}'" + (f" and {_name()} = '{header.upper()}'" if header else "")
    return f"arg_min(payload, seq) filter (where {cond})"


def _sql_value(p: str) -> str:
    return rf"regexp_replace({p}, '^[^:]*:\s*', '')"


def _sql_field(p: str, n: int) -> str:
    return rf"coalesce(list_extract(regexp_split_to_array(regexp_replace({p}, '^\s+', ''), '\s+'), {n + 1}), '')"


def _sql_request(m: str, h: str, u: str, p: str) -> str:
    value = _sql_value(h)
    host = f"coalesce(case when {value} like 'http://%' then {value} else 'http://' || {value} end, 'http://localhost')"
    return f"coalesce({m}, '-') || ' ' || {host} || coalesce(nullif({u}, ''), '-') || ' ' || coalesce(nullif({p}, ''), 'HTTP/1.0')"


def _sql_time(p: str, fmt: str) -> str:
    return f"coalesce(strftime(make_timestamp(try_cast(split_part({_sql_field(_sql_value(p), 0)}, '.', 1) as bigint) * 1000000), '{fmt}'), '')"


def _sql_user(h: str) -> str:
    v = _sql_value(h)
    return rf"case when {v} = 'Basic {NOT_UTF8}' then repeat(chr(65533), 4) when lower({v}) like 'basic %' then split_part(decode(from_base64(regexp_split_to_array({v}, '\s+')[2])), ':', 1) else '-' end"


_DISPOSITION = "arg_min(lower(payload), seq) filter (where tag in ('VCL_call', 'VCL_return') and lower(payload) in ('hit', 'miss', 'pass', 'error', 'pipe'))"
_S = {
    "start": _sql_slot("Timestamp", "Start"), "process": _sql_slot("Timestamp", "Process"), "resp": _sql_slot("Timestamp", "Resp"),
    "reqstart": _sql_slot("ReqStart"), "method": _sql_slot("ReqMethod"), "url": _sql_slot("ReqURL"), "proto": _sql_slot("ReqProtocol"),
    "host": _sql_slot("ReqHeader", "Host"), "agent": _sql_slot("ReqHeader", "User-Agent"), "referer": _sql_slot("ReqHeader", "Referer"),
    "auth": _sql_slot("ReqHeader", "Authorization"), "status": _sql_slot("RespStatus"), "length": _sql_slot("RespHeader", "Content-Length"),
    "acct": _sql_slot("ReqAcct"), "pipe": _sql_slot("PipeAcct"), "etype": _sql_slot("VCL_Log", "etype"), "disposition": _DISPOSITION,
    "debug": "arg_min(case when is_raw then '\"foo\\0\\377 bar\"' else payload end, seq) filter (where tag = 'Debug')",
    "bstart": _sql_slot("Timestamp", "Start"), "beresp": _sql_slot("Timestamp", "Beresp"), "body": _sql_slot("Timestamp", "BerespBody"),
    "backend": _sql_slot("Backend"), "bmethod": _sql_slot("BereqMethod"), "burl": _sql_slot("BereqURL"), "bproto": _sql_slot("BereqProtocol"),
    "bhost": _sql_slot("BereqHeader", "Host"), "bauth": _sql_slot("BereqHeader", "Authorization"), "bstatus": _sql_slot("BerespStatus"),
    "blength": _sql_slot("BerespHeader", "Content-Length"), "bacct": _sql_slot("BereqAcct"),
}
_TX = (
    ", tx as (select instance, vxid, side, max(pvxid) as pvxid, min(ts) as ts, min(seq) as seq, "
    + ", ".join(f"{v} as {k}" for k, v in _S.items())
    + " from records where side <> '-' group by instance, vxid, side) "
)
_SQL_TRUNC = lambda p: f"coalesce(cast(cast(trunc(try_cast({p} as double) * 1000000) as bigint) as varchar), '')"
_CLIENT_LINE = (
    f"{_sql_field('reqstart', 0)} || ' - ' || {_sql_user('auth')} || ' ' || {_sql_time('start', '[%d/%b/%Y:%H:%M:%S +0000]')} || ' \"' || "
    f"{_sql_request('method', 'host', 'url', 'proto')} || '\" ' || coalesce(status, '') || ' ' || {_sql_field('acct', 4)} || ' \"' || "
    f"coalesce({_sql_value('referer')}, '') || '\" \"' || coalesce({_sql_value('agent')}, '') || '\"'"
)
_BACKEND_LINE = (
    f"'b ' || {_sql_field('backend', 2)} || ' ' || coalesce(bmethod, '') || ' \"' || {_sql_request('bmethod', 'bhost', 'burl', 'bproto')} || '\" ' || "
    f"coalesce(bstatus, '') || ' ' || {_sql_field('bacct', 4)} || ' ' || {_SQL_TRUNC(_sql_field(_sql_value('body'), 1))} || ' ' || {_sql_field(_sql_value('beresp'), 1)}"
)

# The default format has no lines for client transactions without any of what it shows; the backends' has, as it shows the side.
_C_SLOTS = ["reqstart", "auth", "start", "method", "url", "proto", "host", "status", "acct", "referer", "agent"]
_C_SENT = f"coalesce({', '.join(_C_SLOTS)}) is not null"
_SENT = f"(side = 'b' or {_C_SENT})"

# Sources, sinks and selections ------------------------------------------------


@_query("records", "select instance, seq, ts as ts_us, vxid, pvxid, side, tag, payload, is_raw from records")
def _records(r: DataFrame) -> DataFrame:
    return r.select("instance", "seq", _us(), "vxid", "pvxid", "side", "tag", "payload", F.col("raw").isNotNull().alias("is_raw"))


@_query("a1_saved_log", "select seq, vxid, tag, payload from records")
def _saved(r: DataFrame) -> DataFrame:
    path = scratch_path(r.sparkSession, "log")
    r.write.partitionBy("instance").parquet(path)
    return filter_instance(read_records(r.sparkSession, path), "main").select("seq", "vxid", "tag", "payload")


@_query("a2_stream_folder", "select seq, ts as ts_us, vxid, side, tag, payload, is_raw from records")
def _folder(r: DataFrame) -> DataFrame:
    """A folder of compressed JSON lines read as a stream from its head, in two runs: the second goes on where the first one stopped."""
    spark = r.sparkSession
    path, out, checkpoint = (scratch_path(spark, n) for n in ("folder", "folder-rows", "folder-checkpoint"))
    for k, part in enumerate((F.col("seq") % 3 == 0, F.col("seq") % 3 != 0)):
        written = scratch_path(spark, "folder-part")
        written_as = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "compression": "gzip", "maxRecordsPerFile": FILE_ROWS}
        r.where(part).write.options(**written_as).json(written)
        move_files(spark, written, path, f"{k:06d}-")  # newer files have greater names
        stream = stream_folder(spark, path, from_start=True)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("seq", _us(), "vxid", "side", "tag", "payload", F.col("raw").isNotNull().alias("is_raw"))


@_query("a4_written_lines", _TX + f"select {_CLIENT_LINE} as value from tx where side = 'c' and {_C_SENT}")
def _written(r: DataFrame) -> DataFrame:
    path = scratch_path(r.sparkSession, "lines")
    lines = format_events(r)
    write_lines(lines.where("vxid % 4 = 1"), path)
    write_lines(lines.where("vxid % 4 <> 1"), path, append=True)
    return r.sparkSession.read.text(path)


@_query("b1_filter_side", "select seq, side, tag from records where side in ('b', '-')")
def _side(r: DataFrame) -> DataFrame:
    return O.filter_side(r, ["b", "-"]).select("seq", "side", "tag")


@_query("b2_filter_tags", "select seq, tag, payload from records where tag in ('ReqURL', 'RespStatus', 'Timestamp')")
def _tags(r: DataFrame) -> DataFrame:
    return O.filter_tags(r, {"ReqURL", "RespStatus", "Timestamp"}).select("seq", "tag", "payload")


@_query("b3_filter_headers", f"select seq, tag, payload from records where (tag = 'ReqHeader' and {_name()} in ('HOST', 'USER-AGENT')) or (tag = 'Timestamp' and {_name()} = 'START') or tag not in ('ReqHeader', 'Timestamp')")
def _headers(r: DataFrame) -> DataFrame:
    return O.filter_headers(r, {"ReqHeader": ["Host", "user-agent"], "Timestamp": ["Start"]}).select("seq", "tag", "payload")


_CUT = "case when strlen(payload) <= {n} then payload when strlen(payload) = length(payload) then left(payload, {n}) else left(payload, list_max(list_filter(range(0, {n} + 1), lambda k: strlen(left(payload, k)) <= {n}))) end"


@_query("b4_truncate_payload", f"select seq, {_CUT.format(n=23)} as payload from records")
def _cut(r: DataFrame) -> DataFrame:
    return O.truncate_payload(r, 24).select("seq", "payload")


_HITS = "select seq, tag, payload from (select seq, tag, payload, bool_or({}) over (partition by instance, vxid) as hit from records where side <> '-') where hit"


@_query("b5_query_transactions", _HITS.format("tag = 'ReqURL' and contains(payload, '/purchase/')"))
def _matching(r: DataFrame) -> DataFrame:
    return O.query_transactions(r, O.matches("ReqURL", "/purchase/")).select("seq", "tag", "payload")


@_query("b5_query_has_tag", _HITS.format("tag = 'PipeAcct'"))
def _having(r: DataFrame) -> DataFrame:
    return O.query_transactions(r, O.has("PipeAcct"), frequent=True).select("seq", "tag", "payload")


@_query("b6_query_caseless", _HITS.format("(tag = 'ReqHeader' and payload = 'user-agent: Agent/3') or (tag = 'VCL_call' and payload = 'PIPE')"))
def _caseless(r: DataFrame) -> DataFrame:
    pred = O.matches("ReqHeader", "^AGENT/3$", header="User-Agent", caseless=True) | equals("VCL_call", "pipe", caseless=True)
    return O.query_transactions(r, pred).select("seq", "tag", "payload")


@_query("b7_query_records", "select seq, tag, payload from records where tag = 'Backend_health' and contains(payload, 'healthy') or tag = 'ReqMethod' and payload = 'POST'")
def _single(r: DataFrame) -> DataFrame:
    return O.query_records(r, O.matches("Backend_health", "healthy") | equals("ReqMethod", "POST")).select("seq", "tag", "payload")


# Transactions -----------------------------------------------------------------

_SLOTS = {"reqstart": Slot("ReqStart"), "agent": Slot("ReqHeader", "User-Agent"), "host": Slot("ReqHeader", "Host"), "first_header": Slot("ReqHeader"), "debug": Slot("Debug")}


@_query("c1_assemble", f", tx as (select instance, vxid, side, max(pvxid) as pvxid, min(ts) as ts_us, {_S['reqstart']} as reqstart, {_S['agent']} as agent, {_S['host']} as host, {_sql_slot('ReqHeader')} as first_header, {_sql_slot('Debug')} as debug, count(*) filter (where tag in ('ReqStart', 'ReqHeader', 'Debug')) as n_recs from records where side <> '-' group by instance, vxid, side) select * from tx")
def _assembled(r: DataFrame) -> DataFrame:
    tx = O.assemble(r, _SLOTS.values(), with_disposition=False)
    return tx.select("instance", "vxid", "side", "pvxid", _us(), *[F.col(f"`{s.column}`").alias(n) for n, s in _SLOTS.items()], "n_recs")


_AGAIN = ", again as (select * replace (vxid % 512 as vxid) from records where side <> '-'), numbered as (select *, count(*) filter (where tag = 'Begin') over (partition by instance, vxid, side order by seq) as epoch from again) "


@_query("c1_reused_vxids", _AGAIN + f"select vxid, side, epoch, min(seq) as seq, {_S['url']} as url, {_S['status']} as status from numbered group by instance, vxid, side, epoch")
def _reused(r: DataFrame) -> DataFrame:
    """The log of an instance that has started over again and again, so that its vxids come back."""
    tx = O.assemble(r.withColumn("vxid", F.col("vxid") % 512), [Slot("ReqURL"), Slot("RespStatus")], with_disposition=False, reused=True)
    return tx.select("vxid", "side", "epoch", "seq", F.col("`slot:ReqURL`").alias("url"), F.col("`slot:RespStatus`").alias("status"))


@_query("c5_disposition", _TX + "select vxid, side, disposition from tx")
def _disposed(r: DataFrame) -> DataFrame:
    return O.assemble(r, []).select("vxid", "side", "disposition")


@_query("c6_drop_empty", f"select vxid, side, {_S['pipe']} as pipe from records where side <> '-' group by vxid, side having count(*) filter (where tag = 'PipeAcct') > 0")
def _nonempty(r: DataFrame) -> DataFrame:
    tx = O.drop_empty(O.assemble(r, [Slot("PipeAcct")], with_disposition=False))
    return tx.select("vxid", "side", F.col("`slot:PipeAcct`").alias("pipe"))


@_query("c6_bare_lines", _TX + "select vxid, cast(vxid as varchar) || ' ' || coalesce(status, '') as line from tx where side = 'c'")
def _bare(r: DataFrame) -> DataFrame:
    """The client format shows the vxid, so that every transaction has a line; the backends' shows nothing of its own, so that none has."""
    return format_events(r, "%{vxid}x %s", "%l").select("vxid", "line")


_TREE = (
    ", ids as (select distinct vxid, pvxid from records where side <> '-'), tree as (select vxid, vxid as root, 0 as depth from ids where pvxid not in (select vxid from ids) "
    "union all select i.vxid, t.root, t.depth + 1 from ids i join tree t on i.pvxid = t.vxid) "
)


def _recursive(sql: str) -> str:
    return duckdb_records().replace("with ", "with recursive ", 1) + sql


@_query("c7_group_by_request", None)
def _grouped(r: DataFrame) -> DataFrame:
    return O.order_by_request(O.group_by_request(O.assemble(r, [], with_disposition=False))).select("vxid", "side", "root", "depth")


ORACLES["c7_group_by_request"] = _recursive(_TREE + "select t.vxid, x.side, t.root, t.depth from tree t join (select distinct vxid, side from records where side <> '-') x using (vxid)")


@_query("c8_raw_transactions", "select seq, ts as ts_us, vxid, tag, payload from records")
def _raws(r: DataFrame) -> DataFrame:
    return O.raw_transactions(r).select("seq", _us(), "vxid", "tag", "payload")


_STATUS = (
    ", t as (select *, min(ts) filter (where tag = 'Begin') over (partition by vxid) + 120000000 as deadline, max(ts) filter (where tag = 'End') over (partition by vxid) as ended from records where side <> '-'), "
    "m as (select vxid, side, case when any_value(ended) is null then 'open' when any_value(ended) > any_value(deadline) then 'timeout' else 'complete' end as status, "
    "count(*) filter (where ts <= deadline and tag = 'End') as n_recs from t group by vxid, side) "
)


@_query("c9_mark_incomplete", _STATUS + "select vxid, side, status, n_recs from m")
def _marked(r: DataFrame) -> DataFrame:
    return O.mark_incomplete(r, [Slot("End")], with_disposition=False).select("vxid", "side", "status", "n_recs")


@_query("c10_ended_only", _TX + "select vxid, side, url from tx where exists (select 1 from records r where r.vxid = tx.vxid and r.side = tx.side and r.tag = 'End')")
def _ended(r: DataFrame) -> DataFrame:
    tx = O.assemble(r, [Slot("ReqURL")], with_disposition=False, include_open=False)
    return tx.select("vxid", "side", F.col("`slot:ReqURL`").alias("url"))


# Payload functions --------------------------------------------------------------


@_query("d1_field", f"select seq, {_sql_field('payload', 0)} as f0, {_sql_field('payload', 1)} as f1, {_sql_field('payload', 6)} as f6 from records")
def _fields(r: DataFrame) -> DataFrame:
    return r.select("seq", *[field(F.col("payload"), n).alias(f"f{n}") for n in (0, 1, 6)])


@_query("d2_header_value", f"select seq, {_sql_value('payload')} as value, {_sql_field(_sql_value('payload'), 1)} as f1 from records where tag in ('ReqHeader', 'Timestamp')")
def _values(r: DataFrame) -> DataFrame:
    p = F.col("payload")
    return O.filter_tags(r, ["ReqHeader", "Timestamp"]).select("seq", header_value(p).alias("value"), header_field(p, 1).alias("f1"))


@_query("d5_quote_binary", "select seq, case when is_raw then '\"foo\\0\\377 bar\"' else payload end as text from records where tag = 'Debug'")
def _quoted(r: DataFrame) -> DataFrame:
    return O.filter_tags(r, ["Debug"]).select("seq", F.coalesce(quote_binary(F.col("raw")), "payload").alias("text"))


_EPOCH = _sql_field(_sql_value("payload"), 0)


@_query("d6_split_epoch", f"select seq, cast(split_part({_EPOCH}, '.', 1) as bigint) as secs, cast(split_part({_EPOCH}, '.', 2) as bigint) as usecs from records where tag = 'Timestamp'")
def _epochs(r: DataFrame) -> DataFrame:
    secs, usecs = split_epoch(header_field(F.col("payload"), 0))
    return O.filter_tags(r, ["Timestamp"]).select("seq", secs.alias("secs"), usecs.alias("usecs"))


_AT = f"make_timestamp(cast(split_part({_EPOCH}, '.', 1) as bigint) * 1000000)"


@_query("d7_strftime", f"select seq, strftime({_AT}, '%Y-%m-%d %H:%M:%S|%a %A %b %B %d %j %y %I %p %U %W %u %w %V %G %%|') || split_part({_EPOCH}, '.', 2) as text from records where tag = 'Timestamp'")
def _times(r: DataFrame) -> DataFrame:
    secs, usecs = split_epoch(header_field(F.col("payload"), 0))
    fmt = "%F %T|%a %A %b %B %d %j %y %I %p %U %W %u %w %V %G %%|%i"
    return O.filter_tags(r, ["Timestamp"]).select("seq", strftime(F.timestamp_seconds(secs), usecs, fmt).alias("text"))


@_query("d8_basic_auth_user", f"select seq, {_sql_user('payload')} as name from records where tag = 'ReqHeader' and {_name()} = 'AUTHORIZATION'")
def _users(r: DataFrame) -> DataFrame:
    rows = O.filter_headers(O.filter_tags(r, ["ReqHeader"]), {"ReqHeader": ["authorization"]})
    return rows.select("seq", basic_auth_user(header_value(F.col("payload"))).alias("name"))


@_query("d9_url_parts", "select seq, split_part(payload, '?', 1) as path, case when contains(payload, '?') then substr(payload, instr(payload, '?') + 1) else '' end as query from records where tag = 'ReqURL'")
def _urls(r: DataFrame) -> DataFrame:
    u = F.col("payload")
    return O.filter_tags(r, ["ReqURL"]).select("seq", url_path(u).alias("path"), url_query(u).alias("query"))


# Formatters ---------------------------------------------------------------------

_FORMATTERS = {
    "vxid": "%{vxid}x", "bytes": "%b", "micros": "%D", "side": "%d", "protocol": "%H", "address": "%h", "received": "%I", "host": "%{Host}i",
    "ident": "%l", "method": "%m", "length": "%{content-length}o", "sent": "%O", "query": "%q", "request": "%r", "status": "%s", "time": "%t",
    "day": "%{%F %T.%i}t", "seconds": "%T", "path": "%U", "name": "%u", "firstbyte": "%{Varnish:time_firstbyte}x", "own_vxid": "%{Varnish:vxid}x",
    "parent": "%{pvxid}x", "own_side": "%{Varnish:side}x",
}
_CLIENT_FORMATTERS = _FORMATTERS | {
    "hitmiss": "%{Varnish:hitmiss}x", "handling": "%{Varnish:handling}x", "etype": "%{VCL_Log:etype}x", "debug": "%{tag:Debug}x",
    "start": "%{VSL:Timestamp:Start}x", "port": "%{tag:ReqStart[1]}x", "resp1": "%{tag:Timestamp:Resp[1]}x",
}


def _sql_columns(side: str) -> str:
    c = side == "c"
    p = lambda name: name if c else f"b{name}"
    usec = f"split_part({_sql_field(_sql_value('start'), 0)}, '.', 2)"
    picked = {
        "vxid": "cast(vxid as varchar)", "bytes": _sql_field(p("acct"), 4), "micros": f"coalesce({_SQL_TRUNC(_sql_field(_sql_value('resp' if c else 'body'), 1))}, '')",
        "side": f"'{side}'", "protocol": f"coalesce({p('proto')}, '')", "address": _sql_field("reqstart", 0) if c else _sql_field("backend", 2),
        "received": f"case when acct is not null then {_sql_field('acct', 2)} else {_sql_field('pipe', 2)} end" if c else _sql_field("bacct", 2),
        "host": f"coalesce({_sql_value(p('host'))}, '')", "ident": "'-'", "method": f"coalesce({p('method')}, '')", "length": f"coalesce({_sql_value(p('length'))}, '')",
        "sent": f"case when acct is not null then {_sql_field('acct', 5)} else {_sql_field('pipe', 3)} end" if c else _sql_field("bacct", 5),
        "query": f"case when contains({p('url')}, '?') then substr({p('url')}, instr({p('url')}, '?') + 1) else '' end",
        "request": _sql_request(p("method"), p("host"), p("url"), p("proto")), "status": f"coalesce({p('status')}, '')",
        "time": _sql_time("start", "[%d/%b/%Y:%H:%M:%S +0000]"), "day": f"case when start is null then '' else {_sql_time('start', '%Y-%m-%d %H:%M:%S')} || '.' || {usec} end",
        "seconds": "case when start is null then '' else '0' end", "path": f"coalesce(split_part({p('url')}, '?', 1), '')", "name": _sql_user(p("auth")), "firstbyte": _sql_field(_sql_value("process" if c else "beresp"), 1),
        "own_vxid": "cast(vxid as varchar)", "parent": "'0'", "own_side": f"'{side}'",
    }
    if c:
        picked |= {
            "hitmiss": "case when disposition = 'hit' then 'hit' when disposition is null then '-' else 'miss' end", "handling": "coalesce(disposition, '-')",
            "etype": f"coalesce({_sql_value('etype')}, '')", "debug": "coalesce(debug, '')", "start": f"coalesce({_sql_value('start')}, '')",
            "port": _sql_field("reqstart", 1), "resp1": _sql_field(_sql_value("resp"), 1),
        }
    return _TX + f"select {', '.join(f'{v} as {k}' for k, v in picked.items())} from tx where side = '{side}'"


def _formatter_columns(r: DataFrame, side: str, formatters: dict[str, str]) -> DataFrame:
    return format_columns(plan(r, {side: "".join(formatters.values())}), side, formatters)


@_query("e_client_columns", _sql_columns("c"))
def _client(r: DataFrame) -> DataFrame:
    return _formatter_columns(r, "c", _CLIENT_FORMATTERS)


@_query("e_backend_columns", _sql_columns("b"))
def _backend(r: DataFrame) -> DataFrame:
    return _formatter_columns(r, "b", _FORMATTERS)


# Lines --------------------------------------------------------------------------


@_query("w1_access_log", _TX + f"select vxid, {_CLIENT_LINE} as line from tx where side = 'c' and {_C_SENT}")
def _w1(r: DataFrame) -> DataFrame:
    return format_events(r, DEFAULT_FORMAT).select("vxid", "line")


@_query("f4_format_events", _TX + f"select vxid, side, case when side = 'c' then {_CLIENT_LINE} else {_BACKEND_LINE} end as line from tx where {_SENT}")
def _both(r: DataFrame) -> DataFrame:
    return format_events(r, DEFAULT_FORMAT, BACKEND_LINES).select("vxid", "side", "line")


@_query("w2_request_lines", None)
def _w2(r: DataFrame) -> DataFrame:
    """Client and backend lines of the request groups in which some transaction was answered with 503."""
    formats = {"c": DEFAULT_FORMAT + " %{pvxid}x", "b": BACKEND_LINES + " %{pvxid}x"}
    failed = (F.col("`slot:RespStatus`") == "503") | (F.col("`slot:BerespStatus`") == "503")
    return format_events(r, formats["c"], formats["b"], grouping="request", groups=failed, group_slots=[Slot("RespStatus"), Slot("BerespStatus")]).select("root", "vxid", "line")


ORACLES["w2_request_lines"] = _recursive(
    _TX.rstrip() + _TREE + f", hit as (select distinct t.root from tree t join tx using (vxid) where tx.status = '503' or tx.bstatus = '503') "
    f"select t.root, tx.vxid, case when side = 'c' then {_CLIENT_LINE} else {_BACKEND_LINE} end || ' ' || cast(pvxid as varchar) as line from tx join tree t using (vxid) semi join hit using (root)"
)


@_query("w3_raw_lines", "select seq, strftime(make_timestamp(ts), '[%d/%b/%Y:%H:%M:%S +0000]') || ' ' || cast(vxid as varchar) || ' ' || payload as line from records where tag = 'Backend_health'")
def _w3(r: DataFrame) -> DataFrame:
    return format_raw(O.query_records(r, O.has("Backend_health")), RAW_FORMAT).select("seq", "line")


@_query("f5_raw_all", "select seq, cast(vxid as varchar) || ' ' || case when tag = 'ReqURL' then payload else '' end as line from records")
def _raw_all(r: DataFrame) -> DataFrame:
    """Every record has a line, as the format shows the vxid."""
    return format_raw(r, "%{vxid}x %{tag:ReqURL}x").select("seq", "line")


@_query("f5_raw_named", f"select seq, strftime(make_timestamp(ts), '%H:%M:%S') || ' ' || {_sql_value('payload')} as line from records where tag = 'ReqHeader' and {_name()} = 'HOST'")
def _raw_named(r: DataFrame) -> DataFrame:
    """Only records that the format names have a line."""
    return format_raw(r, "%{%T}t %{tag:ReqHeader:Host}x").select("seq", "line")


# Statistics -----------------------------------------------------------------------

# Lines are made of payloads cut to 39 bytes; what is left of longer credentials is no base64.
_CUT_RECORDS = ", cut as (select * replace (case when payload like 'Authorization: Basic %' and strlen(payload) > 39 then 'Authorization: x' else left(payload, 39) end as payload) from records)"
# The longest payloads are those of the slots, uncut: the first record of each.
_SIZES = ", ".join(f"strlen({_S[k]}) + 1 as {k}" for k in _C_SLOTS)
_OVER = lambda n: " + ".join(f"case when {k} > {n} then 1 else 0 end" for k in _C_SLOTS)
_STATS = (
    _CUT_RECORDS + _TX.rstrip().replace("from records", "from cut") + f", lines as (select vxid, ts, {_C_SENT} as sent, {_CLIENT_LINE} as line from tx where side = 'c'), "
    f"sizes as (select vxid, {_SIZES} from records where side = 'c' group by vxid), measured as (select ts, sent, line, greatest({', '.join(_C_SLOTS)}) as longest, {_OVER(40)} as overs from lines join sizes using (vxid)) "
)
_FIGURES = "count(*) as seen, count(*) filter (where sent) as submitted, count(*) filter (where sent) as writes, cast(sum(strlen(line) + 1) filter (where sent) as bigint) as bytes, max(longest) as len_hi, cast(sum(overs) as bigint) as len_overflows"


@_query("g1_log_stats", _STATS + f"select {_FIGURES} from measured")
def _g1(r: DataFrame) -> DataFrame:
    return O.log_stats(r, {"c": DEFAULT_FORMAT}, max_reclen=40)


@_query("g2_log_stats_interval", _STATS + f"select ts // 21600000000 * 21600000000 as start_us, {_FIGURES} from measured group by 1")
def _g2(r: DataFrame) -> DataFrame:
    out = O.log_stats(r, {"c": DEFAULT_FORMAT}, interval="6 hours", max_reclen=40)
    return out.select(F.unix_micros("start").alias("start_us"), "seen", "submitted", "writes", "bytes", "len_hi", "len_overflows")


# Streams: the records are written as a log, and the stream drains it ---------------


def _stream(r: DataFrame, parts: int = 1, most: int | None = None) -> DataFrame:
    """The records as a log, drained a part at a time, of at most about ``most`` records each; several parts follow each other in time,
    so that transactions lie across them.  One pass deals out the parts; each has as many files, which are a batch."""
    spark = r.sparkSession
    path, log = scratch_path(spark, "stream"), scratch_path(spark, "log")
    r.write.parquet(log)
    rows = read_records(spark, log)
    total = rows.count() if parts > 1 or most else 0
    parts = max(parts, -(-total // most)) if most else parts
    if parts == 1:
        return stream_records(spark, log, from_start=True)
    us = F.unix_micros("ts")
    ends = rows.select(us.alias("us")).selectExpr(*[f"percentile_approx(us, {k / parts}, 1000)" for k in range(1, parts)]).first()
    number = sum((F.when(us >= e, 1).otherwise(0) for e in ends if e is not None), F.lit(0))
    tasks = max(1, total // (parts * PART_ROWS), min(spark.sparkContext.defaultParallelism, parts * total // PART_ROWS))
    dealt, none = scratch_path(spark, "dealt"), scratch_path(spark, "none")
    rows.withColumn("part", number).coalesce(tasks).write.partitionBy("part").parquet(dealt)
    spark.createDataFrame([], RECORD_SCHEMA).coalesce(1).write.parquet(none)
    each = max(count_files(spark, f"{dealt}/part={k}") for k in range(parts))
    for k in range(parts):  # files are drained in the order of their times
        move_files(spark, f"{dealt}/part={k}", path, f"{k:06d}-", k, (none, each))
    discard(spark, log)
    return stream_records(spark, path, from_start=True, max_files=each)


def _named(tx: DataFrame, *more: str) -> DataFrame:
    return tx.select("vxid", "side", "pvxid", "disposition", "n_recs", *more, *[F.col(f"`{s.column}`").alias(s.column.replace("slot:", "").replace(":", "_").replace("-", "_").lower()) for s in STREAM_SLOTS])


_STREAM_TX = (
    ", tx as (select vxid, side, max(pvxid) as pvxid, {d} as disposition, count(*) filter (where tag in ('ReqStart', 'ReqURL', 'RespStatus', 'ReqAcct', 'VCL_call', 'VCL_return') or (tag = 'ReqHeader' and {n} = 'USER-AGENT')) as n_recs, "
    "{a} as reqstart, {b} as requrl, {c} as reqheader_user_agent, {e} as respstatus, {f} as reqacct from records where side <> '-' {w} group by vxid, side) select * from tx"
)
_STREAM_SQL = lambda w: _STREAM_TX.format(d=_DISPOSITION, n=_name(), a=_S["reqstart"], b=_S["url"], c=_S["agent"], e=_S["status"], f=_S["acct"], w=w)


_SPANS = "(select vxid, side, min(ts) filter (where tag = 'Begin') as began, max(ts) filter (where tag = 'End') as ended, max(ts) as last from records group by vxid, side)"
# The stream's last watermark: whole milliseconds, 10 seconds behind the newest record.
_WATERMARK_MS = "(select max(ts) // 1000 - 10000 from records where side <> '-')"


@_query("h1_stream_transactions", _STREAM_SQL(f"and (vxid, side) in (select (vxid, side) from {_SPANS} where ended <= began + 120000000)"))
def _h1(r: DataFrame) -> DataFrame:
    """Complete transactions of a drained stream."""
    return _named(S.drain(S.stream_transactions(_stream(r, FILES), STREAM_SLOTS), "tx").where("not forced"))


@_query("h2_stream_forced", _STREAM_SQL(f"and (vxid, side) in (select (vxid, side) from {_SPANS} where ended > began + 120000000 or (ended is null and began // 1000 + 120000 < {_WATERMARK_MS}))"))
def _h2(r: DataFrame) -> DataFrame:
    """Transactions that a drained stream emits without an End in time: the End came too late, or the
    watermark passed the timeout."""
    return _named(S.drain(S.stream_transactions(_stream(r, FILES), STREAM_SLOTS), "tx").where("forced"))


def _drained(r: DataFrame) -> DataFrame:
    """All rows of a stream, with those that were open when it stopped."""
    checkpoint = scratch_path(r.sparkSession, "checkpoint")
    found = S.drain(S.stream_transactions(_stream(r, FILES), STREAM_SLOTS, with_late=True), "tx", checkpoint=checkpoint).drop("forced")
    return found.unionByName(S.pending_transactions(r.sparkSession, checkpoint, STREAM_SLOTS))


_DEADLINE = f"(select vxid, side, case when ended <= began + 120000000 then 'complete' when ended is not null or began // 1000 + 120000 < {_WATERMARK_MS} then 'forced' else 'open' end as status from {_SPANS})"


@_query("h7_drain_and_flush", _STREAM_SQL("").replace("select * from tx", f"select * from tx join {_DEADLINE} using (vxid, side)"))
def _h7(r: DataFrame) -> DataFrame:
    """Each transaction once: complete, forced, or read from the state of the stopped stream."""
    return _named(_drained(r).where("status <> 'late'"), "status")


@_query("h4_late_after_timeout", f"select vxid, side, count(*) as late from records join {_SPANS} using (vxid, side) where side <> '-' and ts > began + 120000000 group by vxid, side")
def _h4(r: DataFrame) -> DataFrame:
    """Records that came after their transaction was due."""
    return _drained(r).where("status = 'late'").select("vxid", "side", "late")


@_query("h1_stream_lines", _TX + f"select {_CLIENT_LINE} as line from tx where side = 'c' and {_C_SENT} union all select {_BACKEND_LINE} as line from tx where side = 'b'")
def _h1_lines(r: DataFrame) -> DataFrame:
    """The access log of a stream: lines of finished transactions in files by date and hour, those of open ones appended at the end."""
    spark = r.sparkSession
    path, checkpoint = scratch_path(spark, "lines"), scratch_path(spark, "lines-checkpoint")
    stream_lines(S.stream_events(_stream(r, FILES), DEFAULT_FORMAT, BACKEND_LINES), path, checkpoint, available_now=True).awaitTermination()
    rest = scratch_path(spark, "rest")
    write_lines(S.pending_events(spark, checkpoint, DEFAULT_FORMAT, BACKEND_LINES), rest)
    return spark.read.text(path).select("value").union(spark.read.text(rest)).select(F.col("value").alias("line"))


@_query("b5_stream_lines", _TX + f"select {_CLIENT_LINE} as line from tx where side = 'c' and (instance, vxid) in (select (instance, vxid) from records where tag = 'PipeAcct') and exists (select 1 from {_DEADLINE} d where d.vxid = tx.vxid and d.side = 'c' and d.status <> 'open')")
def _b5_stream(r: DataFrame) -> DataFrame:
    """Lines of whole transactions with a record that the format doesn't need, as the stream gives them out."""
    lines = S.stream_events(_stream(r, FILES), DEFAULT_FORMAT, where=O.has("PipeAcct"), keep_tags=["PipeAcct"])
    return S.drain(lines, "lines").select("line")


@_query("h5_stream_log_stats", _STATS + f"select ts // 21600000000 * 21600000000 as start_us, {_FIGURES} from measured group by 1")
def _h5_log_stats(r: DataFrame) -> DataFrame:
    """The figures of g2, added up batch by batch."""
    spark, formats = r.sparkSession, {"c": DEFAULT_FORMAT}
    path, checkpoint = scratch_path(spark, "figures"), scratch_path(spark, "figures-checkpoint")
    S.stream_log_stats(_stream(r, FILES), formats, path, checkpoint, "6 hours", 40, available_now=True).awaitTermination()
    S.flush_log_stats(spark, checkpoint, formats, path, "6 hours", 40)
    return S.read_log_stats(spark, path).select(F.unix_micros("start").alias("start_us"), "seen", "submitted", "writes", "bytes", "len_hi", "len_overflows")


@_query("h3_stream_windowed", _STREAM_SQL(f"and (vxid, side) in (select (vxid, side) from {_SPANS} where last + 600000000 <= {_WATERMARK_MS} * 1000)"))
def _h3(r: DataFrame) -> DataFrame:
    """What the stream emits: transactions whose gap has ended by the last watermark.  Batches are bounded, and so is the state."""
    return _named(S.drain(S.stream_transactions_windowed(_stream(r, most=BATCH_ROWS), STREAM_SLOTS, gap="10 minutes"), "tx"))


@_query("h5_stream_stats", "select ts // 3600000000 * 3600000000 as start_us, count(*) as records, cast(sum(strlen(payload) + 1) as bigint) as bytes, max(strlen(payload) + 1) as len_hi from records group by 1")
def _h5(r: DataFrame) -> DataFrame:
    out = S.drain(S.stream_stats(_stream(r), "1 hour"), "stats", mode="complete")
    return out.select(F.unix_micros("start").alias("start_us"), "records", "bytes", "len_hi")


@_query("h6_stream_raw", "select strftime(make_timestamp(ts), '%Y-%m-%d') as dt, strftime(make_timestamp(ts), '[%d/%b/%Y:%H:%M:%S +0000]') || ' ' || cast(vxid as varchar) || ' ' || payload as line from records where tag = 'Backend_health'")
def _h6(r: DataFrame) -> DataFrame:
    spark = r.sparkSession
    path, checkpoint = scratch_path(spark, "raw-lines"), scratch_path(spark, "raw-checkpoint")
    stream_lines(S.stream_raw(O.query_records(_stream(r), O.has("Backend_health")), RAW_FORMAT), path, checkpoint, available_now=True).awaitTermination()
    return spark.read.text(path).select(F.col("dt").cast("string").alias("dt"), F.col("value").alias("line"))
