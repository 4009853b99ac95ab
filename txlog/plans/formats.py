"""Line formats: read once on the driver, they say which slots a job needs and give one Column per line."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txlog.functions import basic_auth_user, field, header_field, header_value, microseconds, quote_binary, split_epoch, strftime, url_path, url_query
from txlog.operators.assemble import DISPOSITION_TAGS, assemble, check_grouping
from txlog.operators.requests import group_by_request, order_by_request, request_groups
from txlog.operators.select import MAX_RECLEN, filter_tags, header_condition, truncate_payload
from txlog.schema import BACKEND, CLIENT, KEY, RAW, Slot

DEFAULT_FORMAT = '%h %l %u %t "%r" %s %b "%{Referer}i" "%{User-agent}i"'
#: The default serves backend transactions as well.
BACKEND_FORMAT = DEFAULT_FORMAT
BINARY_TAGS = ("Debug",)

#: The tags that formats may name.
TAGS = """
Debug Error CLI SessOpen SessClose BackendOpen BackendReuse BackendClose HttpGarbage Backend Length FetchError
ReqMethod ReqURL ReqStatus ReqReason ReqProtocol ReqHeader ReqUnset ReqLost ReqStart ReqAcct PipeAcct
RespMethod RespURL RespStatus RespReason RespProtocol RespHeader RespUnset RespLost
BereqMethod BereqURL BereqStatus BereqReason BereqProtocol BereqHeader BereqUnset BereqLost BereqAcct
BerespMethod BerespURL BerespStatus BerespReason BerespProtocol BerespHeader BerespUnset BerespLost
ObjMethod ObjURL ObjStatus ObjReason ObjProtocol ObjHeader ObjUnset ObjLost
BogoHeader LostHeader TTL Fetch_Body VCL_acl VCL_call VCL_trace VCL_return VCL_Error VCL_Log VCL_use Gzip Hit
HitPass HitMiss ExpBan ExpKill WorkThread ESI_xmlerror Hash Backend_health Link Begin End VSL Storage Timestamp
ESI_BodyBytes Witness
""".split()
_TAG = {t.lower(): t for t in TAGS}
_HEADER_NAME = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")

_REQ = {CLIENT: "Req", BACKEND: "Bereq"}
_RESP = {CLIENT: "Resp", BACKEND: "Beresp"}


@dataclass
class Item:
    """A formatter: the slots it reads, and its value from a function that gives a slot's Column."""

    slots: list[Slot] = dc_field(default_factory=list)
    value: Callable[[Callable[[Slot], Column]], Column] = lambda get: F.lit("")
    disposition: bool = False
    #: The value is the transaction's own: with such a formatter, transactions without any needed record have a line.
    own: bool = False


def _slot_item(slot: Slot, make: Callable[[Column], Column]) -> Item:
    return Item([slot], lambda get: make(get(slot)))


def _time(side: str, fmt: str) -> Item:
    if side == RAW:
        usec = F.unix_micros("ts") % 1_000_000
        return Item(value=lambda get: strftime(F.col("ts"), usec, fmt))

    def make(p: Column) -> Column:
        secs, usecs = split_epoch(header_field(p, 0))
        return strftime(F.timestamp_seconds(secs), usecs, fmt)

    return _slot_item(Slot("Timestamp", "Start"), make)


def _request_line(side: str) -> Item:
    r = _REQ[side]
    method, host, url, protocol = Slot(f"{r}Method"), Slot(f"{r}Header", "Host"), Slot(f"{r}URL"), Slot(f"{r}Protocol")

    def value(get: Callable[[Slot], Column]) -> Column:
        h = header_value(get(host))
        h = F.when(h.startswith("http://"), h).otherwise(F.concat(F.lit("http://"), h))
        filled = lambda s, other: F.when(F.length(get(s)) > 0, get(s)).otherwise(F.lit(other))
        return F.concat(F.coalesce(get(method), F.lit("-")), F.lit(" "), F.coalesce(h, F.lit("http://localhost")), filled(url, "-"), F.lit(" "), filled(protocol, "HTTP/1.0"))

    return Item([method, host, url, protocol], value)


def _bytes(side: str, n: int, pipe_n: int) -> Item:
    if side == BACKEND:
        return _slot_item(Slot("BereqAcct"), lambda p: field(p, n))
    acct, pipe = Slot("ReqAcct"), Slot("PipeAcct")
    return Item([acct, pipe], lambda get: F.when(get(acct).isNotNull(), field(get(acct), n)).otherwise(field(get(pipe), pipe_n)))


def _simple(letter: str, side: str) -> Item | None:
    r, p = _REQ[side], _RESP[side]
    client = side == CLIENT
    match letter:
        case "b":
            return _slot_item(Slot(f"{r}Acct"), lambda x: field(x, 4))
        case "D":
            return _slot_item(Slot("Timestamp", "Resp" if client else "BerespBody"), lambda x: F.when(x.isNotNull(), microseconds(header_field(x, 1)).cast("long").cast("string")))
        case "d":
            return Item(value=lambda get: F.lit(side), own=True)
        case "H":
            return _slot_item(Slot(f"{r}Protocol"), lambda x: x)
        case "h":
            return _slot_item(Slot("ReqStart"), lambda x: field(x, 0)) if client else _slot_item(Slot("Backend"), lambda x: field(x, 2))
        case "I":
            return _bytes(side, 2, 2)
        case "l":
            return Item(value=lambda get: F.lit("-"))
        case "m":
            return _slot_item(Slot(f"{r}Method"), lambda x: x)
        case "O":
            return _bytes(side, 5, 3)
        case "q":
            return _slot_item(Slot(f"{r}URL"), url_query)
        case "r":
            return _request_line(side)
        case "s":
            return _slot_item(Slot(f"{p}Status"), lambda x: x)
        case "t":
            return _time(side, "[%d/%b/%Y:%T %z]")
        case "T":
            return _slot_item(Slot("Timestamp", "Start"), lambda x: F.when(x.isNotNull(), (microseconds(header_field(x, 1)) / 1e6).cast("long").cast("string")))
        case "U":
            return _slot_item(Slot(f"{r}URL"), url_path)
        case "u":
            return _slot_item(Slot(f"{r}Header", "Authorization"), lambda x: F.coalesce(F.when(x.isNotNull(), basic_auth_user(header_value(x))), F.lit("-")))
    return None


def _header_arg(name: str) -> str:
    if not _HEADER_NAME.fullmatch(name):
        raise ValueError(f"not a header name: {name!r}")
    return name


def _tag_item(spec: str, side: str) -> Item:
    """``T``, ``T:H``, ``T[n]`` or ``T:H[n]``."""
    n = None
    if "[" in spec:
        m = re.fullmatch(r"(.*)\[(\d+)\]", spec)
        if not m:
            raise ValueError(f"unterminated field number: {spec!r}")
        spec, n = m[1], int(m[2])
    tag, colon, header = spec.partition(":")
    if tag.lower() not in _TAG:
        raise ValueError(f"unknown tag {tag!r}")
    tag = _TAG[tag.lower()]
    slot = Slot(tag, _header_arg(header)) if colon else Slot(tag)
    if tag in DISPOSITION_TAGS:  # these records decide the disposition and fill no slot, as in the tool this follows
        return Item([slot] if side == RAW else [], lambda get: F.lit(""), disposition=side != RAW)
    if side == RAW:
        carries = F.col("tag") == tag
        if colon:
            from txlog.functions import has_header

            carries &= has_header(F.col("payload"), header)
        p = F.when(carries, F.col("payload"))
        raw = F.when(carries, F.col("raw"))
        read = lambda get: p
    else:
        raw = F.col(f"`raw:{tag}`")
        read = lambda get: get(slot)

    def value(get: Callable[[Slot], Column]) -> Column:
        x = read(get)
        if colon:
            x = header_value(x)
        elif tag in BINARY_TAGS:
            x = F.coalesce(quote_binary(raw), x)
        return x if n is None else field(x, n)

    return Item([slot], value)


def _disposition(names: dict[str, str]) -> Item:
    d = F.col("disposition")
    out = F.lit("-")
    for found, text in names.items():
        out = F.when(d == found, text).otherwise(out)
    return Item(value=lambda get: out, disposition=True)


def _long(arg: str, letter: str, side: str) -> Item | None:
    if letter == "t":
        return _time(side, arg)
    if letter == "x":
        name, _, rest = arg.partition(":")
        if arg in ("vxid", "Varnish:vxid"):
            return Item(value=lambda get: F.col("vxid").cast("string"), own=True)
        if name in ("tag", "VSL") and rest:
            return _tag_item(rest, side)
        if side == RAW:
            return None
        if arg == "pvxid":
            return Item(value=lambda get: F.col("pvxid").cast("string"), own=True)
        if arg == "Varnish:side":
            return Item(value=lambda get: F.lit(side), own=True)
        if arg == "Varnish:time_firstbyte":
            return _slot_item(Slot("Timestamp", "Process" if side == CLIENT else "Beresp"), lambda p: header_field(p, 1))
        if arg in ("Varnish:hitmiss", "Varnish:handling"):
            if side != CLIENT:
                raise ValueError(f"{arg} is for client formats only")
            kinds = ("hit", "miss", "pass", "pipe", "error")
            return _disposition({k: k if arg == "Varnish:handling" or k == "hit" else "miss" for k in kinds})
        if name == "VCL_Log" and rest:
            return _slot_item(Slot("VCL_Log", _header_arg(rest)), header_value)
        return None
    if side != RAW and letter in "io":
        tag = (_REQ if letter == "i" else _RESP)[side]
        return _slot_item(Slot(f"{tag}Header", _header_arg(arg)), header_value)
    return None


def parse_format(fmt: str, side: str) -> list[str | Item]:
    """Literals and formatters of a format; ValueError where it is not legal for the side."""
    out: list[str | Item] = []
    text, i = "", 0
    while i < len(fmt):
        c = fmt[i]
        if c == "\\":
            text += {"n": "\n", "t": "\t"}.get(fmt[i + 1 : i + 2], "")
            i += 2
            continue
        if c != "%":
            text += c
            i += 1
            continue
        if fmt[i + 1 : i + 2] == "{":
            # A time format may hold anything but a closing brace.
            end = fmt.find("}", i)
            if end < 0 or end + 1 >= len(fmt):
                raise ValueError(f"unterminated formatter: {fmt[i:]!r}")
            spec, item = fmt[i : end + 2], _long(fmt[i + 2 : end], fmt[end + 1], side)
        else:
            spec = fmt[i : i + 2]
            item = (_time(side, "[%d/%b/%Y:%T %z]") if spec == "%t" else None) if side == RAW else _simple(spec[1:], side)
        if item is None:
            raise ValueError(f"formatter {spec!r} is not known or not legal here")
        if text:
            out.append(text)
            text = ""
        out.append(item)
        i += len(spec)
    if text:
        out.append(text)
    return out


def validate_format(fmt: str, side: str) -> None:
    parse_format(fmt, side)


def _items(fmt: str, side: str) -> list[Item]:
    return [x for x in parse_format(fmt, side) if isinstance(x, Item)]


def required_slots(fmt: str, side: str) -> set[Slot]:
    """The tags and headers that a format needs."""
    return {s for item in _items(fmt, side) for s in item.slots}


def wants_bare(fmt: str, side: str) -> bool:
    """Whether the format has lines for transactions (raw: records) that hold nothing it needs: some formatter is about the
    transaction itself."""
    return any(i.own for i in _items(fmt, side))


def needed_tags(slots: Iterable[Slot], disposition: bool = False) -> tuple[set[str], dict[str, set[str]]]:
    """(all tags, headers of the tags that are only needed with a header)."""
    slots = {*slots}
    plain = {s.tag for s in slots if not s.header}
    headers: dict[str, set[str]] = {}
    for s in slots:
        if s.header and s.tag not in plain:
            headers.setdefault(s.tag, set()).add(s.header)
    return {s.tag for s in slots} | ({*DISPOSITION_TAGS} if disposition else set()), headers


def format_line(fmt: str, side: str) -> Column:
    """The line of a transaction with the format's slots: one concatenation, absent values empty."""
    get = lambda slot: F.col(f"`{slot.column}`")
    parts: list[Column] = []
    shared: dict[int, Column] = {}
    for x in parse_format(fmt, side):
        if isinstance(x, str):
            parts.append(F.lit(x))
        else:
            parts.append(shared.setdefault(id(x), F.coalesce(x.value(get), F.lit(""))))
    while len(parts) > 200:  # very long formats as a tree of concatenations
        parts = [F.concat(*parts[k : k + 200]) for k in range(0, len(parts), 200)]
    return F.concat(F.lit(""), *parts)


def format_columns(tx: DataFrame, side: str, formatters: dict[str, str]) -> DataFrame:
    """Columns of single formatters on the side's transactions: output name -> formatter."""
    return tx.where(F.col("side") == side).select(*[format_line(f, side).alias(name) for name, f in formatters.items()])


def _selected(formats: dict[str, str], tags: set[str] = frozenset(), whole: bool = True) -> tuple[Column, Column]:
    """Which records the formats of their own side need: a condition on side and tag alone, which scans can
    take, and one on headers.  Records of ``tags`` count as needed, and (with ``whole``) all of a side whose
    format has lines for bare transactions, as any of them shows that the transaction is there."""
    coarse = fine = F.lit(False)
    for side, f in formats.items():
        own = F.col("side") == side
        named, headers = needed_tags(required_slots(f, side), any(i.disposition for i in _items(f, side)))
        if whole and wants_bare(f, side):
            coarse, fine = coarse | own, fine | own
        elif named | tags:
            coarse = coarse | (own & F.col("tag").isin(*sorted(named | tags)))
            fine = fine | (own & header_condition({t: h for t, h in headers.items() if t not in tags}))
    return coarse, fine


def needed(formats: dict[str, str]) -> Column:
    """Whether the format of its side needs a record."""
    coarse, fine = _selected(formats, whole=False)
    return F.coalesce(coarse & fine, F.lit(False))


def cut_records(
    records: DataFrame, formats: dict[str, str], max_reclen: int | None = MAX_RECLEN, where: Column | None = None, keep_tags: Iterable[str] = (), keep_all: bool = False
) -> DataFrame:
    """The records that matter to lines of the formats (side -> format), with ``_needed``, ``size`` (of the uncut payload,
    terminator included) and, with ``where``, its value ``_hit``.  Payloads are cut to ``max_reclen`` bytes (None: not at all)
    after ``where`` has seen them; those that no format needs are dropped."""
    if keep_all:
        rows = records.where(F.col("side").isin(*formats))
    else:
        coarse, fine = _selected(formats, {*keep_tags})
        rows = records.where(coarse).where(fine)
    if where is not None:
        rows = rows.withColumn("_hit", where)
    rows = rows.withColumns({"_needed": needed(formats), "size": F.octet_length(F.coalesce("payload", F.lit(""))).cast("long") + 1})
    rows = rows.withColumn("payload", F.when(F.col("_needed"), F.col("payload")))
    return rows if max_reclen is None else truncate_payload(rows, max_reclen)


def format_needs(formats: dict[str, str]) -> tuple[set[Slot], bool]:
    """The slots that the formats (side -> format) need, and whether they need the disposition."""
    return {s for side, f in formats.items() for s in required_slots(f, side)}, any(i.disposition for side, f in formats.items() for i in _items(f, side))


def plan(
    records: DataFrame,
    formats: dict[str, str],
    max_reclen: int | None = MAX_RECLEN,
    where: Column | None = None,
    keep_tags: Iterable[str] = (),
    grouping: str = "vxid",
    keep_all: bool = False,
    measured: bool = False,
    only: Iterable[Slot] | None = None,
    **how,
) -> DataFrame:
    """Assembled transactions of the sides that have a format.

    Each side's records are cut to the tags and headers that its own format needs, and payloads to
    ``max_reclen`` bytes (None: not at all), before the one exchange.  ``where`` sees whole payloads;
    ``keep_tags`` are the tags that it looks at.  A transaction is kept if it holds a record that its
    side's format needs, or if that format has a formatter of the transaction itself (vxid, pvxid, side).
    pvxid is 0 unless ``grouping`` is request.  With ``keep_all`` every transaction stays, with ``submitted``
    (it would have been kept); ``measured`` adds len_hi and len_overflows of the payloads that fill slots.
    ``only`` names the slots to fill; which transactions are kept doesn't depend on it."""
    formats = {s: f for s, f in formats.items() if f}
    check_grouping(grouping, formats)
    slots, dispo = format_needs(formats) if only is None else ({*only}, False)
    rows = cut_records(records, formats, max_reclen, where, keep_tags, keep_all)
    limit = (max_reclen or 1 << 62) if measured else None
    tx = assemble(rows, slots, where=None if where is None else F.col("_hit"), binary_tags=BINARY_TAGS, with_disposition=dispo, needed=F.col("_needed"), max_reclen=limit, **how)
    if grouping != "request":
        tx = tx.withColumn("pvxid", F.lit(0).cast("long"))
    return tx.withColumn("submitted", submitted(formats)) if keep_all else tx.where(submitted(formats))


def submitted(formats: dict[str, str]) -> Column:
    """Whether an assembled transaction has a line."""
    bare = [side for side, f in formats.items() if wants_bare(f, side)]
    return (F.col("n_recs") > 0) | F.col("side").isin(*bare) if bare else F.col("n_recs") > 0


def format_lines(tx: DataFrame, formats: dict[str, str]) -> DataFrame:
    """``tx`` with ``line``, by the format of each row's side."""
    line = None
    for side, f in formats.items():
        if f:
            own = format_line(f, side)
            line = F.when(F.col("side") == side, own) if line is None else line.when(F.col("side") == side, own)
    return tx.withColumn("line", line)


def format_events(records: DataFrame, cformat: str = DEFAULT_FORMAT, bformat: str = "", grouping: str = "vxid", groups: Column | None = None, group_slots: Iterable[Slot] = (), **how) -> DataFrame:
    """Lines of client and backend transactions, each with its own format; an empty format switches its side off.
    One assembly serves both.

    With request ``grouping`` there is a further column ``root``, members of a group come together in the
    log's order, and ``groups`` (a condition on assembled transactions) selects whole groups.  With the slots that it looks at
    (``group_slots``, which the formats need, too) groups are found first, and only their transactions are assembled in full."""
    formats = {CLIENT: cformat, BACKEND: bformat}
    found = None
    if grouping == "request" and groups is not None and group_slots:
        found = request_groups(plan(records, formats, grouping=grouping, only=group_slots, **how), groups)
        records = records.join(found.select(*KEY), KEY, "left_semi").select(records.columns)
    tx = plan(records, formats, grouping=grouping, **how)
    names = ["instance", "vxid", "pvxid", "side", "ts", "seq", "line"]
    if grouping == "request":
        tx = order_by_request(group_by_request(tx, groups) if found is None else tx.join(found, KEY))
        names.insert(0, "root")
    elif groups is not None:
        raise ValueError("groups are for request grouping; where selects transactions")
    return format_lines(tx, formats).select(*names)


def format_raw(records: DataFrame, rformat: str, tags: Iterable[str] | None = None, max_reclen: int | None = MAX_RECLEN) -> DataFrame:
    """Lines of single records, each a transaction of its own; no shuffle.  A record that the format doesn't name has a line
    only where a formatter (the vxid) is about the transaction itself; ``tags``, or a predicate before this, select records."""
    rows = records if tags is None else filter_tags(records, tags)
    if not wants_bare(rformat, RAW):
        named, headers = needed_tags(required_slots(rformat, RAW))
        rows = filter_tags(rows, named - {*DISPOSITION_TAGS})
        rows = rows.where(header_condition(headers)) if headers else rows
    if max_reclen is not None:
        rows = truncate_payload(rows, max_reclen)
    return rows.select("instance", "vxid", "ts", "seq", format_line(rformat, RAW).alias("line"))
