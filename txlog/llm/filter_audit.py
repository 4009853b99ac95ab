"""How filters interact: for every order of the filters, what each step removes, and what it is worth.

Every document gets a mask of the filters that it fails; the audit of all orders is then sums over
the counts of masks, which add up over any split of the table.

A: under 100 words.  B: 100 * distinct words < 80 * words.  C: 100 * letters A-Z > 10 * code points.
D: holds any of ``#$%&*|``.  E: identical to the text of a smaller doc_id, anywhere in the table.

E comes in two steps.  A counting Bloom filter of the texts' hashes is merged by adding counters:
each text counts in K places of one block of 64 counters.  A text with a place that nothing else
counted in is unique for sure.  Only the others, the possible repeats, are shuffled: the smallest
doc_id of each whole text is found by an aggregate (which combines copies before its exchange) and
joined back on the text.  The blocks that are sent to the tasks hold 64 places in a number, at most
``max_blocks`` of them: with more documents more texts are possible repeats, and nothing else changes.

Nulls: a null text is the empty one, a null lang or label is '' and 0.  A document with a null
doc_id repeats no smaller one, and no other repeats it.  Rows that repeat entirely have no smaller
doc_id among them, so none of them fails E.  An empty table gives no rows.  Extra columns of the
inputs are not used; texts of any length are read whole.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txlog.llm.common import documents, materialize, scratch_scope

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
#: Places in a block that each text counts in.
K = 3
DOCS_PER_BLOCK = 4
MAX_BLOCKS = 1 << 21


def text_mask(text: Column, words: Column) -> Column:
    """The filters A to D that a text with these words fails, as bits."""
    n = F.size(words)
    upper = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    fails = [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * upper > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def _places(blocks: int) -> tuple[Column, Column]:
    """Of ``hash``: the block, and the bits of its K places in it."""
    block = F.pmod("hash", F.lit(blocks)).alias("block")
    places = F.xxhash64("hash")
    bits = F.lit(0).cast("long")
    for i in range(K):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", places, F.lit(6 * i)).bitwiseAND(63).cast("int")))
    return block, bits.alias("places")


def possible_repeats(hashes: DataFrame, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, Column, Column]:
    """The merged filter of a column ``hash``: (block, places counted twice or more), how to find the block and the
    places of a hash.  A hash is unique if one of its places is missing."""
    blocks = min(max_blocks, hashes.count() // DOCS_PER_BLOCK + 1)
    block, places = _places(blocks)
    place = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("places"), i) == 1)).alias("place")
    counters = hashes.select(block, places).select("block", place).groupBy("block", "place").agg(F.count("*").alias("n")).where("n > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))
    return materialize(counters.groupBy("block").agg(F.bit_or(bit).alias("seen")), "bloom"), block, places


def mask_counts(docs: DataFrame, labels: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(part, mask, n, good, toxic): documents by lang and by the filters that they fail, with the labels' sums."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("hash"))
    bloom, block, places = possible_repeats(base.select("hash"), max_blocks)
    rows = base.withColumns({"block": block, "places": places}).join(F.broadcast(bloom), "block", "left")
    rows = rows.withColumn("possible", F.coalesce(F.col("seen").bitwiseAND(F.col("places")) == F.col("places"), F.lit(False)))
    mask = text_mask(F.col("text"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    unique = rows.where("not possible").select("doc_id", "part", mask.alias("mask"))
    possible = rows.where("possible").select("doc_id", "part", "text")
    first = possible.groupBy("text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written first, so that the join has exchanges of its own: Spark can split the partition of a text with many copies.
    first = materialize(first, "repeats")
    repeat = F.when(F.col("doc_id") > F.col("first"), REPEAT).otherwise(0)
    judged = possible.join(first, "text", "left").select("doc_id", "part", (mask + repeat).alias("mask"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    flagged = unique.unionByName(judged).join(marks, "doc_id", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return flagged.groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of masks."""
    bit = lambda letter: F.lit(1 << FILTERS.index(letter))
    orders = F.explode(F.split(F.lit(" ".join(map("".join, itertools.permutations(FILTERS)))), " ")).alias("filter_order")
    steps = counts.sparkSession.range(1).select(orders).select("filter_order", F.explode(F.expr(f"sequence(1, {len(FILTERS)})")).alias("step"))
    steps = steps.withColumns({"filter": F.expr("substr(filter_order, step, 1)"), "earlier": F.expr("substr(filter_order, 1, step - 1)")})
    own = sum((F.when(F.col("filter") == x, bit(x)).otherwise(0) for x in FILTERS), F.lit(0))
    before = sum((F.when(F.col("earlier").contains(x), bit(x)).otherwise(0) for x in FILTERS), F.lit(0))
    steps = materialize(steps.select("filter_order", "step", "filter", own.alias("own"), before.alias("before")), "orders")
    # A step depends on its filter and on which came before, not on their order: 80 sums a part serve all 600 rows.
    sums = F.array(*[F.struct(F.lit(1 << i).alias("own"), F.lit(b).alias("before")) for i in range(len(FILTERS)) for b in range(1 << len(FILTERS)) if not b >> i & 1])
    rows = counts.select("*", F.explode(sums).alias("s")).select("part", "mask", "n", "good", "toxic", "s.own", "s.before")
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda cond, c, name: F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long").alias(name)
    found = rows.groupBy("part", "own", "before").agg(
        total(~fails & ~gone, "n", "kept"), total(fails & ~gone, "n", "removed"), total(fails & gone, "n", "redundant"),
        total(F.col("mask") == F.col("own"), "n", "unique_fails"), total(fails & ~gone, "good", "good_lost"), total(fails & ~gone, "toxic", "toxic_lost"),
    )
    times = steps.groupBy("own", "before").agg(F.count("*").alias("times"))
    worth = found.join(F.broadcast(times), ["own", "before"]).groupBy("part", "own").agg(F.sum(F.col("removed") * F.col("times")).cast("long").alias("shapley"))
    out = found.join(F.broadcast(steps), ["own", "before"]).join(worth, ["part", "own"])
    return out.select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with scratch_scope():
        return materialize(audit(materialize(mask_counts(documents(spark, sf_dir), labels), "masks")), "audit", keep=True)


_W = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
ORACLE_SQL = rf"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, {_W} as words, min(doc_id) over (partition by text) as first from d),
f as (select doc_id, part, case when len(words) < 100 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end
  + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 4 else 0 end
  + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when doc_id > first then 16 else 0 end as mask from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
bits as (select filter_order, k as step, filter_order[k] as filter, cast(pow(2, ascii(filter_order[k]) - 65) as int) as own,
  coalesce(list_sum([cast(pow(2, ascii(z) - 65) as int) for z in string_split(filter_order[:k - 1], '') if z <> '']), 0)::int as before
  from orders, (select unnest(range(1, 6)) as k)),
r as (select part, filter_order, step, filter, cast(sum(case when mask & (own | before) = 0 then n else 0 end) as bigint) as kept,
  cast(sum(case when mask & own <> 0 and mask & before = 0 then n else 0 end) as bigint) as removed,
  cast(sum(case when mask & own <> 0 and mask & before <> 0 then n else 0 end) as bigint) as redundant,
  cast(sum(case when mask = own then n else 0 end) as bigint) as unique_fails,
  cast(sum(case when mask & own <> 0 and mask & before = 0 then good else 0 end) as bigint) as good_lost,
  cast(sum(case when mask & own <> 0 and mask & before = 0 then toxic else 0 end) as bigint) as toxic_lost
  from c, bits group by all)
select part, filter_order, cast(step as int) as step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, filter) as bigint) as shapley from r
"""
