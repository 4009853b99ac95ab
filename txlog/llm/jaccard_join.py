"""N-gram Jaccard join by signature trees.

A text's set is that of its distinct ``width``-word shingles (A-Z lower-cased); two texts link
when the intersection is at least ``percent`` % of the union.  The join is exact.

1. One scan emits each text's set size, a signature of the whole set (equal sets are one class)
   and its smallest shingle hashes.  Linked texts share one of the first
   p = n - ceil(percent/100 n) + 1 of their shingles in any order common to all.  The order
   used here puts shingles that many texts hold last, so that a passage which thousands share
   doesn't tie them together; a text whose list has too few others gives back its rarest ones.
2. Texts that share such a shingle fall into blocks (connected components in Spark).
3. Per block, texts are compared by signature trees: a node holds the OR of its texts' token
   bitmaps, its size range, the most tokens that one of its texts loses to collisions, and the
   most that lie beyond its list.  Two trees are traversed together, and node pairs are pruned
   whose sizes exclude a link, whose largest possible overlap (common bits plus lost and
   unlisted tokens) is too small, or whose texts are linked already.  What remains is counted.
   Large blocks are cut into tiles by size and hash; pairs of tiles are tasks of their own.  First
   each tile is compared with itself and with one tile of its size, then only what this did not tie
   to the block's largest component is compared with the rest: copies of one text cost one round.
   This is done with the lists first, which leaves as blocks what may be linked at all, and
   then with the whole sets.
4. The trees return spanning forests, whose components are the answer.

Nulls and texts without words have empty sets and link with nothing.  Texts with fewer than ``width``
words have their whole sequence as one shingle.  What is compared are classes of equal sets, told
apart by signatures of 128 bits; rows are told apart by their places in the table, so null, repeated
or shared ids lose no link.  A component's id is its smallest doc_id, and null where it has none.
Extra columns of the input are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlog.llm.common import FILE, ROW, documents, drop_rows, id_type, keyed, map_rows, materialize, scratch_scope, words
from txlog.llm.components import components
from txlog.llm.substring_dedup import Hashes
from txlog.llm.vocab import Bounded

WIDTH, PERCENT = 4, 85
TILE_TOKENS, TILE_TEXTS = 1_000_000, 2000
#: Up to this many rows of at most four integers (16 MB) are broadcast to a join; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_ALL = np.iinfo(np.int64).max
_BIT_WORDS = 64  # of 64 bits each, in a node's bitmap
_FANOUT = 8
_SLICE = 100_000


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass").lower())  # bytes: only A-Z change


def _cache() -> Bounded:
    return Bounded(_word_hash, 500_000)


def shingle_sets(parts: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (as int64) of texts given as word hashes."""
    h = Hashes(np.concatenate(parts)) if parts else None
    out, at = [], 0
    for p in parts:
        n = len(p)
        if n == 0:
            out.append(np.zeros(0, np.int64))
        else:
            first = np.arange(at, at + max(1, n - width + 1))
            out.append(np.unique(h.spans(first, first + min(n, width)).view(np.int64)))
        at += n
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def listed(n: int, percent: int) -> int:
    """How many of its smallest shingles a text lists: room for some that turn out to be frequent."""
    p = prefix_length(n, percent)
    return min(n, p + 24 + p // 10)


def _sliced(batches):
    """(word hashes of some texts, their places in the batch, last?) of all batches."""
    cache = _cache()
    for b in batches:
        part, at, size, last = [], [], 0, len(b["text"]) - 1
        for i, text in enumerate(b["text"]):
            w = words(text)
            part.append(np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)))
            at.append(i)
            size += len(w)
            if size > _SLICE or i == last:
                yield b, at, part
                part, at, size = [], [], 0
                cache.trim()


def text_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(rid, key, doc_id, n, s1, s2, head) of keyed documents: an integer for the row, set size, signature,
    and the listed shingles (once per task and signature)."""

    def run(batches):
        from pyspark import TaskContext

        rid, seen = TaskContext.get().partitionId() << 33, set()
        for b, at, part in _sliced(batches):
            out: dict[str, list] = {c: [] for c in ("rid", FILE, ROW, "doc_id", "n", "s1", "s2", "head")}
            for i, s in zip(at, shingle_sets(part, width)):
                sign = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None
                head = None
                if sign is not None and sign not in seen:
                    head = s[: listed(len(s), percent)]
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(sign)
                halves = (None, None) if sign is None else np.array([sign >> 64, sign & (1 << 64) - 1], np.uint64).view(np.int64).tolist()
                for c, v in zip(out, (rid, b[FILE][i], b[ROW][i], b["doc_id"][i], len(s), *halves, head)):
                    out[c].append(v)
                rid += 1
            yield out

    return map_rows(docs.select(FILE, ROW, "doc_id", "text"), run, f"rid long, {FILE} long, {ROW} long, doc_id {id_type(docs)}, n int, s1 long, s2 long, head array<long>")


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def class_names(rows: DataFrame) -> DataFrame:
    """(s1, s2, rid, n, smallest): per class the row that lists for it, its size, and the smallest doc_id."""
    classes = rows.where("s1 is not null").groupBy("s1", "s2")
    lister = F.min(F.when(F.col("head").isNotNull(), F.col("rid"))).alias("rid")
    return materialize(classes.agg(lister, F.max("n").alias("n"), F.min("doc_id").alias("smallest")), "classes")


def candidate_edges(rows: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes, by their listers, tied to the smallest with which they share a prefix shingle."""
    listing = rows.where("head is not null").select("rid", F.posexplode("head").alias("rank", "token"))
    # These tables grow with the corpus and are joined by a shuffle at any size.
    # Written first, so that the join has exchanges of its own, whose hot partitions Spark can split.
    common = materialize(listing.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "common")
    shared = listing.join(common.hint("merge"), "token")
    # What a text lists and others list too, at most its list: each such shingle counts as frequent to begin with.
    own = shared.groupBy("rid").agg(F.collect_list(F.struct("rank", "token", "c")).alias("shared"))
    own = own.join(names.select("rid", "n"), "rid")
    own = materialize(own, "shared")

    def give_back(batches):
        """Of texts that would run out of infrequent shingles, the rarest frequent ones that they need."""
        for b in batches:
            out = []
            for n, items in zip(b["n"], b["shared"]):
                frequent = sorted((x["c"], x["token"]) for x in items)
                missing = prefix_length(n, percent) - (listed(n, percent) - len(frequent))
                if missing > 0 and listed(n, percent) < n:
                    out += [t for _, t in frequent[:missing]]
            yield {"token": out}

    spared = map_rows(own.select("n", "shared"), give_back, "token long").distinct().withColumn("spared", F.lit(True))
    items = own.select("rid", "n", F.explode("shared").alias("x")).select("rid", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("x.rank")).alias("place"), "x.token")
    items = items.join(spared.hint("merge"), "token", "left")
    items = items.select("rid", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("rank"), "token", F.col("spared").isNull().alias("frequent"))
    own = items.groupBy("rid").agg(F.max("n").alias("n"), F.collect_list(F.struct("rank", "token", "frequent")).alias("shared"))

    def prefixes(batches):
        for b in batches:
            ids, tokens = [], []
            for d, n, items in zip(b["rid"], b["n"], b["shared"]):
                p, late = prefix_length(n, percent), {x["rank"] for x in items if x["frequent"]}
                order = sorted(range(listed(n, percent)), key=lambda r: (r in late, r))
                chosen = {*order[:p]}
                mine = [x["token"] for x in items if x["rank"] in chosen]
                ids += [d] * len(mine)
                tokens += mine
            yield {"rid": ids, "token": tokens}

    prefix = materialize(map_rows(own, prefixes, "rid long, token long"), "prefixes")
    first = prefix.groupBy("token").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).where("a < b")
    first = materialize(first.select("token", "a"), "first-texts")
    return prefix.join(first.hint("merge"), "token").select("a", F.col("rid").alias("b")).where("a <> b").distinct()


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


class Tree:
    """Levels of nodes over texts (sorted token arrays, lists or whole sets), leaves first."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray):
        bits = np.zeros((len(sets), _BIT_WORDS), np.uint64)
        for i, s in enumerate(sets):
            at = (s.view(np.uint64) % np.uint64(64 * _BIT_WORDS)).astype(np.int64)
            np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        listed_n = np.array([len(s) for s in sets], np.int64)
        self.levels = [(bits, n, n, listed_n - _popcount(bits), n - listed_n)]
        while len(self.levels[-1][0]) > 1:
            bits, lo, hi, lost, rest = self.levels[-1]
            cut = np.arange(0, len(bits), _FANOUT)
            most = [np.maximum.reduceat(x, cut) for x in (hi, lost, rest)]
            self.levels.append((np.bitwise_or.reduceat(bits, cut, axis=0), np.minimum.reduceat(lo, cut), *most))


def _linkable(x, y, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether some text of node a[i] and some of node b[i] may link."""
    (bx, lox, hix, lost_x, rest_x), (by, loy, hiy, lost_y, rest_y) = x, y
    ok = (100 * hix[a] >= percent * loy[b]) & (100 * hiy[b] >= percent * lox[a])
    a, b = a[ok], b[ok]
    most = np.concatenate([_popcount(bx[a[k : k + 8192]] & by[b[k : k + 8192]]) for k in range(0, len(a), 8192)] or [np.zeros(0, np.int32)])
    most = most + np.minimum(lost_x[a], lost_y[b]) + np.maximum(rest_x[a], rest_y[b])
    most = np.minimum(most, np.minimum(hix[a], hiy[b]))
    # intersection * (100 + percent) >= percent * (sum of sizes)
    ok[ok] = most * (100 + percent) >= percent * (lox[a] + loy[b])
    return ok


def links_of(sets: list[np.ndarray], n: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """A spanning forest (as each text's root) of the links between texts ``left`` and texts ``right``
    (places in ``sets``; the same array: within it).

    ``n`` are the sizes of the whole sets.  Where ``sets`` are lists of their smallest tokens, the links
    are those that are possible: up to the smaller of two lists' ends the overlap is known, and beyond
    it is at most what either set has left."""
    root = np.arange(len(sets))
    same = left is right

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    vocabulary, dense = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    starts = ends - [len(s) for s in sets]
    mark = np.zeros(len(vocabulary), bool)
    last = np.array([_ALL if len(s) >= k else s[-1] for s, k in zip(sets, n)], np.int64)

    def unlisted(i: int, js: np.ndarray) -> np.ndarray:
        if last[i] == _ALL and (last[js] == _ALL).all():
            return np.zeros(len(js), np.int64)
        end = np.minimum(last[i], last[js])
        own = n[i] - np.searchsorted(sets[i], end, side="right")
        return np.minimum(own, [n[j] - np.searchsorted(sets[j], e, side="right") for j, e in zip(js, end)])

    def verify(i: int, js: np.ndarray) -> None:
        mine = dense[starts[i] : ends[i]]
        mark[mine] = True
        for k in range(0, len(js), 512):
            part = js[k : k + 512]
            part = part[[find(int(j)) != find(i) for j in part]] if k else part
            if len(part):
                tokens = np.concatenate([dense[starts[j] : ends[j]] for j in part])
                sizes = ends[part] - starts[part]
                both = np.add.reduceat(mark[tokens], np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
                for j in part[(both + unlisted(i, part)) * (100 + percent) >= percent * (n[i] + n[part])]:
                    root[find(int(j))] = find(i)
        mark[mine] = False

    # Neighbours in the order of smallest shingles are mostly copies: link them first.
    smallest = lambda i: (int(sets[i][0]), int(n[i]), i)
    left = np.array(sorted(left, key=smallest))
    right = left if same else np.array(sorted(right, key=smallest))
    every = left if same else np.array(sorted(np.r_[left, right], key=smallest))
    side = {int(i): 0 for i in left} | ({} if same else {int(i): 1 for i in right})
    for step in (1, 2, 3):
        for i, j in zip(every, every[step:]):
            if (same or side[int(i)] != side[int(j)]) and find(int(i)) != find(int(j)):
                verify(int(i), np.array([j]))

    x = Tree([sets[i] for i in left], n[left])
    y = x if same else Tree([sets[i] for i in right], n[right])
    level = max(len(x.levels), len(y.levels)) - 1
    at = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def labels(order: np.ndarray, k: int) -> np.ndarray:
        """Per node of level k its texts' component, or -1 where they have several."""
        own = np.array([find(int(i)) for i in order])
        for _ in range(k):
            cut = np.arange(0, len(own), _FANOUT)
            own = np.where(np.minimum.reduceat(own, cut) == np.maximum.reduceat(own, cut), own[cut], -1)
        return own

    while True:
        kx, ky = min(level, len(x.levels) - 1), min(level, len(y.levels) - 1)
        lx, ly = labels(left, kx), labels(right, ky)
        keep = ~((lx[a] >= 0) & (lx[a] == ly[b]))
        if level == 0 and same:
            keep &= a < b
        a, b = a[keep], b[keep]
        ok = _linkable(at(x, level), at(y, level), a, b, percent)
        a, b = a[ok], b[ok]
        if level == 0 or not len(a):
            break
        level -= 1
        if level < len(x.levels) - 1:
            a, b = _children(a, b, len(x.levels[level][0]))
        if level < len(y.levels) - 1:
            b, a = _children(b, a, len(y.levels[level][0]))
        if same:
            a, b = a[a <= b], b[a <= b]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    for i, js in zip(left[a[np.r_[True, a[1:] != a[:-1]]]] if len(a) else [], np.split(right[b], np.flatnonzero(a[1:] != a[:-1]) + 1) if len(a) else []):
        mine = find(int(i))
        verify(int(i), np.array([j for j in js if find(int(j)) != mine], np.int64))
    return np.array([find(i) for i in range(len(sets))])


def _children(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    child = (a[:, None] * _FANOUT + np.arange(_FANOUT)).ravel()
    other = np.repeat(b, _FANOUT)
    ok = child < n
    return child[ok], other[ok]


def _compare(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    out: list[tuple[int, int]] = []
    for _, group in pdf.groupby("block", sort=False):
        if len(group) < 2:
            continue
        ids, side = group["rid"].to_numpy(), group["side"].to_numpy()
        sets = [np.asarray(t, np.int64) for t in group["tokens"]]
        if (side == side[0]).all():
            if not group["same"].iloc[0]:
                continue
            left = right = np.arange(len(sets))
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        root = links_of(sets, group["n"].to_numpy(np.int64), left, right, percent)
        tied = np.flatnonzero(root != np.arange(len(sets)))
        out += zip(ids[root[tied]], ids[tied])
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


_PAIR = ["pair", "block", "rid", "n", "tokens", "side", "same"]


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    return rows.select(_PAIR).groupBy("pair").applyInPandas(lambda pdf: _compare(pdf, percent), "a long, b long")


def _tiled(placed: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """``placed`` (with block and cell) cut into bounded tiles: with ``tile``; and the tiles (block, cell, tile)."""
    volume = F.greatest(F.sum(F.size("tokens")) / TILE_TOKENS, F.count("*") / TILE_TEXTS)
    parts = materialize(placed.groupBy("block", "cell").agg(F.ceil(volume).cast("int").alias("parts")), "tile-parts")
    name = lambda sub: F.concat_ws("/", F.lit(what), "block", "cell", sub)
    tiles = parts.select("block", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub"))
    placed = placed.join(parts, ["block", "cell"]).withColumn("tile", name(F.pmod(F.xxhash64("rid"), "parts"))).drop("parts")
    return placed, tiles.select("block", "cell", name(F.col("sub")).alias("tile"), (F.col("sub") == 0).alias("first"))


def _tile_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(block, tile, other) of all tiles whose sizes allow links, those of ``left`` with those of ``right``."""
    other = right.select("block", F.col("cell").alias("cell2"), F.col("tile").alias("other"), F.col("first").alias("first2"))
    return left.join(other, "block").where("abs(cell2 - cell) <= 1")


def _pair_rows(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The members of both tiles of each pair (tile, other); a tile's pair with itself has them once."""
    pairs = materialize(pairs.select("block", "tile", "other").withColumn("pair", F.concat_ws("|", "tile", "other")), "tile-pairs")
    same = F.col("tile") == F.col("other")
    first = left.join(pairs.select("pair", "tile", F.lit(0).alias("side"), same.alias("same")), "tile")
    second = right.join(pairs.where(~same).select("pair", F.col("other").alias("tile"), F.lit(1).alias("side"), F.lit(False).alias("same")), "tile")
    return first.select(_PAIR).union(second.select(_PAIR))


def forest(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the (possible) links within each block of (rid, block, n, tokens)."""
    sizes = members.groupBy("block").agg(F.sum(F.size("tokens")).alias("tokens"), F.count("*").alias("texts"))
    sizes = materialize(sizes, "block-sizes")
    large = materialize(sizes.where((F.col("tokens") > TILE_TOKENS) | (F.col("texts") > TILE_TEXTS)).select("block"), "large-blocks")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    bins = max(1, 2 * total // TILE_TOKENS)
    small = members.join(large, "block", "left_anti").withColumn("pair", F.concat(F.lit("s"), F.pmod(F.xxhash64("block"), F.lit(bins))))
    found = materialize(_compared(small.withColumns({"side": F.lit(0), "same": F.lit(True)}), percent), "forest")
    if large.isEmpty():
        return found

    cell = F.floor(F.log("n") / float(np.log(100 / percent))).cast("int")  # linked sizes lie in a cell or its neighbours
    placed, tiles = _tiled(members.join(large, "block").withColumn("cell", cell), "t")
    placed, tiles = materialize(placed, "tiled"), materialize(tiles, "tiles")
    # Each tile with itself, and with the first tile of its own and of either neighbouring cell.
    once = (F.col("tile") <= F.col("other")) & (F.col("first") | F.col("first2"))
    round1 = _tile_pairs(tiles, tiles).where((F.col("tile") == F.col("other")) | once)
    found1 = materialize(_compared(_pair_rows(round1, placed, placed), percent), "forest")
    # What is not in its block's largest component so far is compared with itself and with the rest.
    ids = placed.select("rid", "block", "tile")
    comps = components(found1).withColumnRenamed("v", "rid")
    ids = materialize(ids.join(comps, "rid", "left").select("rid", "block", F.coalesce("component", "rid").alias("component")), "tied")
    most = ids.groupBy("block", "component").agg(F.count("*").alias("c")).groupBy("block").agg(F.max_by("component", F.struct("c", "component")).alias("component"))
    loose = materialize(ids.join(materialize(most, "largest"), ["block", "component"], "left_anti").select("rid"), "loose")
    rest, rest_tiles = _tiled(placed.drop("tile").join(loose, "rid"), "r")
    rest, rest_tiles = materialize(rest, "rest"), materialize(rest_tiles, "rest-tiles")
    tied = placed.join(loose, "rid", "left_anti")
    own = _tile_pairs(rest_tiles, rest_tiles).where("tile <= other")
    found2 = _compared(_pair_rows(own, rest, rest), percent).union(_compared(_pair_rows(_tile_pairs(rest_tiles, tiles), rest, tied), percent))
    return found.union(found1).union(materialize(found2, "forest"))


def _blocks(edges: DataFrame, name: str) -> DataFrame:
    return materialize(components(edges).select(F.col("v").alias("rid"), F.col("component").alias("block")), name, keep=True)


def linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, doc_id, n, component, smallest) of every row of keyed documents: the component as an integer
    (null for empty sets), and the smallest doc_id in it."""
    with scratch_scope():
        rows = materialize(text_sets(docs, width, percent), "sets")
        names = class_names(rows)
        with scratch_scope():  # each step's tables go before the next step makes its own
            blocks = _blocks(candidate_edges(rows, names, percent), "blocks")

        with scratch_scope():
            heads = rows.where("head is not null").select("rid", "n", F.col("head").alias("tokens")).join(_small(blocks), "rid")
            heads = materialize(heads.select("rid", "block", "n", "tokens"), "heads")
            blocks = _blocks(forest(heads, percent), "blocks")
            del heads

        def whole(batches):
            for b, at, part in _sliced(batches):
                sets = shingle_sets(part, width)
                yield {"rid": [b["rid"][i] for i in at], "block": [b["block"][i] for i in at], "n": [len(s) for s in sets], "tokens": sets}

        with scratch_scope():
            chosen = materialize(rows.select("rid", FILE, ROW).join(_small(blocks), "rid"), "chosen")
            texts = docs.select(FILE, ROW, "text").join(_small(chosen), [FILE, ROW]).select("rid", "block", "text")
            members = materialize(map_rows(texts, whole, "rid long, block long, n int, tokens array<long>"), "members")
            found = materialize(components(forest(members, percent)).withColumnRenamed("v", "rid"), "found", keep=True)
            del chosen, texts, members
        named = names.join(found, "rid", "left").select("s1", "s2", "smallest", F.coalesce("component", "rid").alias("component"))
        named = materialize(named, "named")
        least = materialize(named.groupBy("component").agg(F.min("smallest").alias("smallest")), "smallest")
        named = materialize(named.drop("smallest").join(least, "component"), "components")
        out = rows.select(FILE, ROW, "doc_id", "n", "s1", "s2").join(named, ["s1", "s2"], "left").drop("s1", "s2")
        return materialize(out, "linked", keep=True)


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    out = linked(keyed(docs), width, percent)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))


ORACLE_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
u as (select doc_id, len(s) as n, unnest(s) as t from s),
p as (select a.doc_id as a, b.doc_id as b from u a join u b on a.t = b.t and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
r as (select doc_id as v, doc_id as c from d union select e.b, r.c from r join e on e.a = r.v)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, m.c as component_id from s join (select v, min(c) as c from r group by v) m on m.v = s.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


def keep_documents(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Documents, all columns, one row of each component: that with the smallest doc_id (of several, or
    without any, the first in the table's files).  Texts without words are components of their own."""
    rows = keyed(docs)
    with scratch_scope():
        tied = linked(rows, width, percent).where("component is not null").select(FILE, ROW, "doc_id", "component")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW)
        best = tied.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("c")).where("c > 1")
        best = materialize(best.select("component", F.col(f"best.{FILE}").alias("file"), F.col(f"best.{ROW}").alias("row")), "kept")
        losers = tied.join(best, "component").where((F.col(FILE) != F.col("file")) | (F.col(ROW) != F.col("row")))
        losers = materialize(losers.select(FILE, ROW), "dropped", keep=True)
    return drop_rows(rows, losers)
