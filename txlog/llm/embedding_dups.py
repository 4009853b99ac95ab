"""Embedding near-duplicates by products of int8 tiles.

Unit vectors are quantised to int8 with one scale each, and the norm of what quantisation lost
is kept per vector.  Two vectors' true cosine then lies within err_a + err_b + err_a * err_b of
the quantised product, so a tile product settles most pairs, and only pairs that may reach the
threshold are computed again in double precision.

Rows with equal vectors are one class.  Classes of a label are dealt to tiles of at most ``TILE`` by
the nearest of up to ``PIVOTS`` vectors, more of them the more classes there are.  A tile knows the
least and largest angle of its vectors to every pivot: by the triangle inequality, tiles whose angles
to some pivot lie further apart than the threshold's are never multiplied.  Every other pair of tiles
is one bounded group, so neither a hot label nor a hot vector makes a large task.  A tile pair
returns link counts and a spanning forest of its links, never the pairs.

Vectors without any structure leave the pivots nothing to exclude; a label's tile products then grow
with the square of its classes, and each tile is sent to all others of the label.

Vectors link only where labels are equal and not null and dimensions are equal.  Vectors that
are null, empty or zero, hold nulls or non-finite components, or have no vec_id link with
nothing: 0 links, a component of their own.  Vectors are scaled by their largest component
before their norm is taken, so very large and very small ones link like others.  Rows that repeat a
vector link with each other; a vec_id that several rows carry is one vertex.  Extra columns of the
input are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlog.llm.common import map_rows, materialize
from txlog.llm.components import components

TILE = 4096
TILE_BYTES = 32 << 20  # of a tile's vectors in double precision
PIVOTS = 16
_STEP = 1024  # rows of a tile multiplied at once
_EXACT = 1 << 15  # pairs recomputed at once


def links(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    rows = rows.select("vec_id", "embedding", "label")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    good = good & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    classes = rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    part = materialize(_tile_links(classes, threshold), "tile-links")

    counts = part.where("b is null").groupBy("class").agg(F.sum("links").alias("links"))
    comps = components(part.where("b is not null").select("a", "b"))
    known = classes.join(counts, "class", "left").join(comps.withColumnRenamed("v", "rep"), "rep", "left")
    known = materialize(known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "linked")
    out = rows.withColumn("label", F.when(good, F.col("label"))).join(known, ["label", "embedding"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def unit(vectors: list) -> np.ndarray:
    """Vectors of one dimension as unit rows."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _apart(x: np.ndarray) -> np.ndarray:
    """Up to PIVOTS of the rows, each the farthest from those before it."""
    picked, near = [0], x @ x[0]
    while len(picked) < min(PIVOTS, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    return x[picked]


def _placed(classes: DataFrame) -> DataFrame:
    """Classes with dim, tile, and their angles to the pivots (a0..; 0 where the dimension has no such pivot)."""
    sizes = classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    sizes = materialize(sizes, "label-sizes")
    # PIVOTS vectors a dimension at most, among 64 of all: a few hundred kilobytes.
    drawn = classes.select("embedding", F.xxhash64("class").alias("h")).orderBy("h").limit(4 * PIVOTS).collect()
    pivots: dict[int, list] = {}
    for r in drawn:
        pivots.setdefault(len(r["embedding"]), []).append(r["embedding"])
    tile = TILE
    axes = {d: _apart(unit(v)) for d, v in pivots.items()}

    def run(batches):
        for b in batches:
            dims = np.array(b["dim"])
            angle, cell = np.zeros((len(dims), PIVOTS)), np.zeros(len(dims), np.int64)
            for d in {*dims.tolist()} & {*axes}:
                at = np.flatnonzero(dims == d)
                angle[at, : len(axes[d])] = np.arccos(np.clip(unit([b["embedding"][i] for i in at]) @ axes[d].T, -1, 1))
                # A label uses as many pivots as it has tiles.
                used = np.clip(np.array([b["n"][i] for i in at]) // min(tile, max(1, TILE_BYTES // (8 * d))), 1, len(axes[d]))
                near = np.where(np.arange(PIVOTS)[None] < used[:, None], angle[at], np.inf)
                cell[at] = near.argmin(axis=1)
            yield {c: b[c] for c in ("class", "rep", "copies", "embedding", "label", "dim")} | {"cell": cell} | {f"a{j}": angle[:, j] for j in range(PIVOTS)}

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    sized = classes.withColumn("dim", F.size("embedding")).join(sizes, ["label", "dim"])
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("class", "rep", "copies", "embedding", "label")) + ", dim int, cell int, " + ", ".join(f"a{j} double" for j in range(PIVOTS))
    got = materialize(map_rows(sized, run, schema), "angles")
    room = F.least(F.lit(tile), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (8 * F.col("dim")))))
    many = materialize(got.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / room).cast("int").alias("parts")), "tile-parts")
    got = got.join(many, ["label", "dim", "cell"]).withColumn("tile", F.concat_ws("/", "label", "dim", "cell", F.pmod(F.xxhash64("class"), "parts")))
    return materialize(got.drop("parts", "cell"), "tiles")


def _tile_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(class, links, a, b): per tile pair, links of a class (b null), or an edge of its forest."""
    reach = float(np.arccos(threshold)) + 1e-6
    placed = _placed(classes)
    ends = [f(f"a{j}").alias(f"{n}{j}") for j in range(PIVOTS) for n, f in (("lo", F.min), ("hi", F.max))]
    tiles = materialize(placed.groupBy("label", "dim", "tile").agg(*ends), "tile-angles")
    other = tiles.select("label", "dim", *[F.col(c).alias(f"other_{c}") for c in tiles.columns[2:]])
    gap = F.greatest(*[F.greatest(F.col(f"lo{j}") - F.col(f"other_hi{j}"), F.col(f"other_lo{j}") - F.col(f"hi{j}")) for j in range(PIVOTS)])
    pairs = tiles.join(other, ["label", "dim"]).where((F.col("tile") <= F.col("other_tile")) & (gap <= reach))
    pairs = materialize(pairs.select(F.concat_ws("|", "tile", "other_tile").alias("pair"), "tile", "other_tile"), "tile-pairs")
    sides = pairs.select("pair", "tile", F.lit(0).alias("side"), (F.col("tile") == F.col("other_tile")).alias("same"))
    sides = sides.union(pairs.where("tile <> other_tile").select("pair", F.col("other_tile"), F.lit(1), F.lit(False)))
    rows = placed.select("class", "rep", "copies", "embedding", "tile").join(sides, "tile")
    return rows.groupBy("pair").applyInPandas(lambda pdf: _multiply(pdf, threshold), "class long, links long, a long, b long")


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32, whose products of up to 2**24 are exact), scales, and error norms of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.float32), scale, np.linalg.norm(x - q * scale[:, None], axis=1) + 1e-12


def _multiply(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["side", "class"])
    x = unit(pdf["embedding"].tolist())
    first = int((pdf["side"] == 0).sum())
    base = 0 if pdf["same"].iloc[0] else first
    q, scale, err = quantise(x)
    step = (1 << 24) // (127 * 127)  # components whose products sum exactly in float32
    found = [np.zeros((2, 0), np.int64)]
    for top in range(0, first, _STEP):
        for at in range(max(base, top if base == 0 else 0), len(x), _STEP):
            left, right = slice(top, min(first, top + _STEP)), slice(at, at + _STEP)
            near = np.zeros((len(q[left]), len(q[right])), np.float64)
            for k in range(0, x.shape[1], step):
                near += q[left, k : k + step] @ q[right, k : k + step].T
            near *= scale[left, None] * scale[None, right]
            near += err[left, None] + err[None, right] + err[left, None] * err[None, right] + 1e-9
            i, j = np.nonzero(near >= threshold)
            i, j = i + top, j + at
            keep = i < j
            i, j = i[keep], j[keep]
            for k in range(0, len(i), _EXACT):
                a, b = i[k : k + _EXACT], j[k : k + _EXACT]
                true = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                found.append(np.stack([a[true], b[true]]))
    i, j = np.concatenate(found, axis=1)
    copies, cls, rep = (pdf[c].to_numpy() for c in ("copies", "class", "rep"))
    n = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
    root = np.arange(len(x))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    hit, tied = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(x)))
    counts = pd.DataFrame({"class": cls[hit], "links": n[hit].astype(np.int64), "a": rep[hit], "b": None})
    forest = pd.DataFrame({"class": None, "links": None, "a": rep[tied], "b": rep[root[tied]]})
    return pd.concat([counts.astype(object), forest.astype(object)])


ORACLE_SQL = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as x from embeddings),
ok as (select * from v where label is not null and len(x) > 0 and len(list_filter(x, lambda y: y is null or not isfinite(y))) = 0 and list_inner_product(x, x) > 0),
p as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98),
r as (select vec_id as v, vec_id as c from v union select p.b, r.c from r join p on p.a = r.v),
m as (select v, min(c) as c from r group by v), n as (select a, count(*) as n from p group by a)
select v.vec_id, coalesce(n.n, 0) as n_links, m.c as component_id, v.vec_id = m.c as kept from v join m on m.v = v.vec_id left join n on n.a = v.vec_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
