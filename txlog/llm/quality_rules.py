"""Robust multivariate outliers by minimum-covariance-determinant estimates.

Every document has a base record of counts, and from it a vector of transformed statistics: three that
vary in clean text (length of words, share of distinct words, number of words), and beside them two counts of
junk (symbols and repeated lines, repeated words).  Per language and source, location and scatter come from the half of
the vectors whose covariance has the smallest determinant: two deterministic starts (distance from
medians in quartile ranges, and from plain moments) are each improved by concentration steps, and the
start with the smaller determinant wins.  Equal vectors count once, so that copies make no half.  The
estimates of a group are drawn towards those of its language, and these towards those of all rows, as if
they held ``PRIOR`` rows: one rule at every size.

A document is rejected where its squared Mahalanobis distance exceeds ``cutoff`` and some statistic lies
more than two deviations on its bad side.  Distances are of what ``SHORT`` words more would leave of
them, as the statistics of short texts stray by chance; counts of junk are raised by as much before.

Every step is DataFrame work: statistics are array functions over one row's words, medians and
the half's radius come from histograms of quantised values (so the result doesn't depend on the
order of rows), moments from one aggregate, and the inverse by sweeping an array of its cells.  Group parameters are one row per language and source; Spark broadcasts them only
while they are small.

Nulls: a null text has no words and fails the base rules.  Null languages or sources form groups
of their own.  Repeated rows are judged each; texts of any length are read whole; an empty table gives
no rows; extra columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txlog.llm.common import FILE, ROW, documents, drop_rows, keyed, materialize, scratch_scope

STATS = ["log_word_chars", "log_distinct", "log_words", "junk", "repeats"]
#: Added to the deviations: next to nothing where the statistic varies.  Counts of junk are 0 in most clean texts; the
#: root of a count over n words strays by 0.5 / sqrt(n), which is taken for 100 words; repeats come some at a time.
FLOOR = [1e-3] * 3 + [0.05, 0.08]
#: Which values are suspicious: larger (1), smaller (-1), both (2) or none (0).
BAD = [2, -1, 0, 1, 1]
#: The 0.999 quantile and the median of chi-square with 5 degrees of freedom.
CUTOFF, MIDDLE = 20.515, 4.351
STEPS = 3
PRIOR = 100
SHORT = 400
_D = len(STATS)
_RES = 64.0  # cells per unit of a histogram of logarithms of distances
_FINE = 1000.0  # and of statistics


def base_record(docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_distinct, n_symbols, n_dup_lines, n_repeat_words and base_failed of every text."""
    text = F.coalesce("text", F.lit(""))
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    rows = docs.select(
        "doc_id", *extra,
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.array_remove(F.split(blank, " "), "").alias("w"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    # 3-word windows as (hash, place), sorted: equal neighbours are repeated windows.
    n = F.size("w")
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(places, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.withColumn("h", hashed).withColumns({"n_words": n.cast("long"), "n_distinct": F.size(F.array_distinct("w")).cast("long")}).drop("w")
    # Only texts with a window that comes again pay for the sort.
    again = F.size(F.array_distinct("h")) < F.size("h")
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(again, pairs)).drop("h")
    last = F.size("s") - 1
    twice = F.filter("s", lambda x, k: ((k > 0) & (F.get("s", k - 1)["h"] == x["h"])) | ((k < last) & (F.get("s", k + 1)["h"] == x["h"])))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    rows = rows.withColumn("at", at).drop("s")
    # Words from a repeated window's place up to the next such place, 3 at most.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("end"))
    covered = F.aggregate("at", start, lambda a, i: F.struct((a["n"] + 3 - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + 3).alias("end")), lambda a: a["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = ["doc_id", *extra, "n_words", "word_chars", "n_distinct", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*names, failed.alias("base_failed"))


def vector(rows: DataFrame) -> DataFrame:
    """The transformed statistics x0.. of base records with words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    junk = lambda c: F.sqrt(c / n * (n + SHORT) / n)
    values = [
        F.log1p(F.col("word_chars") / n),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / n),
        F.log(n),
        junk(F.col("n_symbols") + F.col("n_dup_lines")),
        junk(F.col("n_repeat_words")),
    ]
    return rows.select("*", *[v.alias(f"x{j}") for j, v in enumerate(values)])


def _quantiles(cells: DataFrame, keys: list[str], parts: dict[str, float]) -> DataFrame:
    """Per keys the upper edges (in cells) that hold these parts of the rows, by name, and n, the rows; cells: keys, cell, n (few rows a key)."""
    run = Window.partitionBy(*keys).orderBy("cell")
    total = Window.partitionBy(*keys)
    ranked = cells.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(total))
    edges = [(F.min(F.when(F.col("upto") >= part * F.col("all"), F.col("cell"))) + 1).alias(name) for name, part in parts.items()]
    return ranked.groupBy(*keys).agg(F.max("all").alias("n"), *edges)


_AT = [(i, j) for i in range(_D) for j in range(i + 1)]
_M, _C = [f"m{j}" for j in range(_D)], [f"c{i}{j}" for i, j in _AT]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: means m_j and covariances c_ij of the statistics."""
    x = [F.col(f"x{j}") for j in range(_D)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("k"), *[F.sum(x[j]).alias(f"m{j}") for j in range(_D)], *[F.sum(x[i] * x[j]).alias(f"c{i}{j}") for i, j in _AT])
    k = F.col("k")
    means = [F.col(m) / k for m in _M]
    return sums.select(*keys, *[m.alias(f"m{j}") for j, m in enumerate(means)], *[(F.col(f"c{i}{j}") / k - means[i] * means[j]).alias(f"c{i}{j}") for i, j in _AT])


def _cell(a: Column, i: Column | int, j: Column | int) -> Column:
    return F.get(a, F.lit(i * _D + j))


def _inverse(params: DataFrame, starts: Sequence[str] = ("",)) -> DataFrame:
    """The inverse ``a`` of the matrix c_ij (row by row, sign changed) and the log-determinant, for all starts (column suffixes), by
    sweeping one row after the other.  One array and one function over it: plans that write every step out take the driver's memory."""
    least = F.array(*[F.lit(f**2 / 4) for f in FLOOR])

    def sweep(state: Column, k: Column) -> Column:
        a = state["a"]
        d = F.greatest(_cell(a, k, k), F.get(least, k))

        def cell(v: Column, at: Column) -> Column:
            i, j = F.floor(at / _D).cast("int"), at % _D
            return F.when((i == k) & (j == k), -1 / d).when((i == k) | (j == k), v / d).otherwise(v - _cell(a, i, k) * _cell(a, k, j) / d)

        return F.struct(F.transform(a, cell).alias("a"), (state["logdet"] + 0.5 * F.log(d)).alias("logdet"))

    for s in starts:
        square = F.array(*[F.col(f"c{max(i, j)}{min(i, j)}{s}") + (FLOOR[i] ** 2 if i == j else 0.0) for i in range(_D) for j in range(_D)])
        swept = F.aggregate(F.sequence(F.lit(0), F.lit(_D - 1)), F.struct(square.alias("a"), F.lit(0.0).alias("logdet")), sweep)
        params = params.withColumn("swept", swept).withColumns({f"a{s}": F.col("swept.a"), f"logdet{s}": F.col("swept.logdet")}).drop("swept")
    return params


def _distance(s: str = "") -> Column:
    z, a = [F.col(f"x{j}") - F.col(f"m{j}{s}") for j in range(_D)], F.col(f"a{s}")
    total = sum((z[i] * sum((_cell(a, i, j) * z[j] * (1.0 if i == j else 2.0) for j in range(i + 1)), F.lit(0.0)) for i in range(_D)), F.lit(0.0))
    return F.greatest(-total, F.lit(0.0))


def _near(df: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    same = [df[k].eqNullSafe(params[k]) for k in keys]
    return df.join(params, same, "inner").drop(*[params[k] for k in keys])


def _cells(value: Column, per_unit: float = _RES) -> Column:
    return F.floor(value * per_unit).cast("long")


def mcd(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: the size n of the whole, and in an array ``e`` the logarithm of the scale, which brings the half's median
    squared distance to that of a normal sample, then means m_j and covariances c_ij of the concentrated half."""
    # Starts are rows, so that plans hold one estimate's columns.  0: medians and quartile ranges; 1: plain moments.
    stack = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"x{j}").alias("x")) for j in range(_D)]))
    long = rows.select(*keys, stack.alias("v")).select(*keys, "v.j", "v.x")
    cells = long.groupBy(*keys, "j", _cells(F.col("x"), _FINE).alias("cell")).agg(F.count("*").alias("n"))
    quarters = _quantiles(cells, [*keys, "j"], {"low": 0.25, "mid": 0.5, "high": 0.75})
    of = lambda j, v: F.max(F.when(F.col("j") == j, v))
    spread = ((F.col("high") - F.col("low")) / (1.349 * _FINE)) ** 2
    middle = quarters.groupBy(*keys).agg(*[of(j, (F.col("mid") - 0.5) / _FINE).alias(f"m{j}") for j in range(_D)], *[of(j, spread).alias(f"c{j}{j}") for j in range(_D)])
    middle = middle.select(*keys, F.lit(0).alias("s"), *_M, *[(F.col(f"c{i}{j}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _AT])
    plain = _moments(rows, keys).select(*keys, F.lit(1).alias("s"), *_M, *_C)
    each, params = [*keys, "s"], materialize(_inverse(middle.union(plain)), "mcd-start")
    for step in range(STEPS + 1):
        # The half with the smallest distances, per start; distances on a log scale keep the histogram short.
        given = _near(rows, params, keys).withColumn("log", F.log(_distance() + 1e-9))
        cells = given.groupBy(*each, _cells(F.col("log")).alias("cell")).agg(F.count("*").alias("n"))
        half = _quantiles(cells, each, {"cell": 0.5}).select(*each, "n", (F.col("cell") / _RES).alias("r"))
        half = materialize(half, "mcd-radius")
        if step < STEPS:
            inside = _near(given, half, each).where(F.col("log") < F.col("r"))
            params = materialize(_inverse(_moments(inside, each)), "mcd-step")
    scale = F.greatest(F.exp("r") / MIDDLE, F.lit(0.25))
    found = _near(params, half, each).select(*keys, F.struct("logdet", "s", "n", F.array(F.log(scale), *_M, *_C).alias("e")).alias("v"))
    return materialize(found.groupBy(*keys).agg(F.min("v").alias("v")).select(*keys, "v.n", "v.e"), "mcd")


def _drawn(n: Column, own: Column, wide: Column) -> Column:
    """Estimates of n rows, drawn towards wider ones as if those held PRIOR rows."""
    return F.coalesce(F.zip_with(own, wide, lambda a, b: (n * a + PRIOR * b) / (n + PRIOR)), wide)


def judge(records: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Base records with ``distance`` (scaled squared Mahalanobis) and ``kept``; records carry lang and source."""
    rows = vector(records)
    clean = rows.where(~F.col("base_failed"))
    # All groups at once: each vector counts for its language and source, its language, and all rows.
    null = F.lit(None).cast("string")
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source")) for k, (a, b) in enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), null), (null, null)])]))
    x = [f"x{j}" for j in range(_D)]
    vectors = clean.select(levels.alias("g"), *x).select("g.*", *x).distinct()
    found = mcd(materialize(vectors, "mcd-vectors"), ["level", "lang", "source"])
    # One row of parameters per group of the records.
    groups = records.select("lang", "source").distinct()
    level = lambda k, name: found.where(F.col("level") == k).select(F.col("lang").alias(f"{name}_lang"), F.col("source").alias(f"{name}_source"), F.col("n").alias(f"{name}_n"), F.col("e").alias(name))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    params = groups.join(level(0, "own"), same("lang", "own_lang") & same("source", "own_source"), "left").join(level(1, "wide"), same("lang", "wide_lang"), "left")
    params = params.withColumn("k", F.lit(0)).join(level(2, "every").withColumn("k", F.lit(0)), "k", "left")
    params = params.withColumn("wide", _drawn(F.col("wide_n"), F.col("wide"), F.col("every"))).withColumn("e", _drawn(F.col("own_n"), F.col("own"), F.col("wide")))
    names = ["scale", *_M, *_C]
    params = params.select("lang", "source", F.coalesce("own_n", F.lit(0)).alias("n"), *[F.get("e", F.lit(k)).alias(name) for k, name in enumerate(names)]).withColumn("scale", F.exp("scale"))
    params = materialize(_inverse(params), "mcd-groups")
    here = rows["lang"].eqNullSafe(params["lang"]) & rows["source"].eqNullSafe(params["source"])
    got = rows.join(params.withColumnRenamed("n", "group_size"), here, "left").drop(params["lang"], params["source"])
    got = got.withColumn("distance", _distance() / F.col("scale") * F.col("n_words") / (F.col("n_words") + SHORT))
    lean = [(F.col(f"x{j}") - F.col(f"m{j}")) / F.sqrt((F.col(f"c{j}{j}") + FLOOR[j] ** 2) * F.col("scale")) for j in range(_D)]
    bad = F.greatest(*[F.abs(lean[j]) if BAD[j] == 2 else BAD[j] * lean[j] for j in range(_D)]) > 2
    out = F.coalesce((F.col("distance") > cutoff) & bad, F.lit(False))
    return got.withColumn("kept", ~F.col("base_failed") & ~out)


def records(docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Base records with language, source and ``extra`` columns, written once."""
    return materialize(base_record(docs, ["lang", "source", *extra]), "base-records")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = judge(records(documents(spark, sf_dir)))
    names = ["doc_id", "n_words", "word_chars", "n_distinct", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return kept.select(*names)


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns.  Each row is judged for itself, also where ids are
    null or repeat."""
    rows = keyed(docs)
    with scratch_scope():
        losers = materialize(judge(records(rows, [FILE, ROW])).where(~F.col("kept")).select(FILE, ROW), "dropped", keep=True)
    return drop_rows(rows, losers)
