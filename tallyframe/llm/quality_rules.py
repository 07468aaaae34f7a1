"""Quality rules with robust multivariate outliers, in DataFrame expressions only.

Text statistics come from array functions on each row.  Rows that pass the base rules
get a vector of transformed statistics.  For each (language, source), each language, and
all rows, a minimum-covariance-determinant estimate is found by concentration steps from several
starts: of all rows of a group, the H_SHARE nearest to the present estimate give the next one, with the consistency
factor of that share.  After TRIAL_STEPS the start of least determinant goes on until its determinant falls no more.
A step is one grouped aggregation by (group, start, distance bin) of moments, which the partial aggregation shrinks
before the shuffle and which is dealt by group and bin, so a group that holds a third of all rows costs no task
more than any other.  A row is judged by the finest group that has MIN_ROWS rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .spark_io import cut, free_name

SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("x0", "x1", "x2", "x3", "x4")
H_SHARE, MIN_ROWS = 0.75, 100
TRIAL_STEPS, MOST_STEPS, FALL = 2, 30, 1e-3  # steps of all starts; steps at most; the least fall of the log determinant that counts, as distances stand in bins
CHI2_MEDIAN, CUTOFF = 4.351, 20.515  # median and 99.9% point of chi-square with 5 degrees of freedom: of normal rows, one in a thousand goes
#: Covariance of normal rows over that of their nearest H_SHARE, by the number k of statistics that vary: H_SHARE over the chance that chi-square with k + 2 degrees of freedom is under the H_SHARE point of that with k.
CONSISTENT = (2.713, 1.859, 1.609, 1.486, 1.412)
#: Least spread, for groups without any of their own: log word length and log words are measures; log1p of symbols, repeated lines and repeated words in percent
#: have the least amount that a short text can show (a symbol in 50 words, a line in three, two runs of three in 50 words) just at the cutoff.
FLOORS = (0.02, 0.243, 0.78, 0.567, 0.1)
MOST_GROUPS, SALTS = 20_000, 16  # estimates that may go along with each task; copies of a larger table of them
BIN = 16.0  # bins an octave of squared distance
FINE = 200.0  # bins a unit of a statistic


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long); a null text counts as empty."""
    names = {n: free_name(docs, n) for n in ("raw_", "ws_", "lines_", "grams_", "sorted_", "hits_")}
    raw, ws, lines, grams, ordered, hits = names.values()
    d = docs.withColumn(raw, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    d = d.withColumn(ws, F.array_remove(F.split(raw, r"[\x20\x09-\x0D]+"), "")).withColumn(lines, F.split(raw, "\n"))
    d = d.withColumn(lines, F.filter(lines, lambda x: F.translate(x, SPACE_CHARS, "") != ""))
    d = d.withColumns(
        {
            "n_words": F.size(ws).cast("long"),
            "word_chars": F.length(F.translate(raw, SPACE_CHARS, "")).cast("long"),
            "n_symbols": (F.length(raw) - F.length(F.translate(raw, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        }
    )
    window = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    none = F.array().cast("array<bigint>")
    d = d.withColumn(grams, F.when(F.size(ws) > 2, window).otherwise(none)).drop(lines, raw, ws)
    some = F.size(F.array_distinct(grams)) < F.size(grams)
    pairs = F.array().cast("array<struct<g:bigint,i:int>>")
    d = d.withColumn(ordered, F.when(some, F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(pairs)).drop(grams)
    twice = lambda x, k: (x["g"] == F.get(ordered, k - 1)["g"]) | (x["g"] == F.get(ordered, k + 1)["g"])
    d = d.withColumn(hits, F.sort_array(F.transform(F.filter(ordered, lambda x, k: F.coalesce(twice(x, k), x["g"] == F.get(ordered, k + 1)["g"], x["g"] == F.get(ordered, k - 1)["g"], F.lit(False))), lambda x: x["i"]))).drop(ordered)
    steps = F.transform(hits, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(hits, k + 1) - p, F.lit(3))))
    return d.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("long")).drop(hits)


def _groups(lang: str | None, source: str | None) -> list[Column]:
    """Names of the groups of a row: language and source, language, all; a null is a value of its own."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("0")) if c else F.lit("0")
    return [F.concat(F.lit("2"), mark(lang), F.lit("\x01"), mark(source)), F.concat(F.lit("1"), mark(lang)), F.lit("0")]


def _by_bin(rows: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """Sums by keys and bin, dealt by both, so that what follows by keys alone reads a row a bin."""
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("k"), *sums).repartition(*keys, "bin")


def _starts(rows: DataFrame) -> DataFrame:
    """Starts of each group: 0 from medians and quartile ranges (exact counts of fine bins), 1 from the mean and covariance of all rows, 2 from the medians and that covariance."""
    long = _by_bin(rows.select("grp", F.posexplode(F.array(*FEATURES)).alias("dim", "x")).withColumn("bin", F.floor(F.col("x") * FINE)), ["grp", "dim"])
    upto = Window.partitionBy("grp", "dim").orderBy("bin")
    long = long.withColumn("upto", F.sum("k").over(upto)).withColumn("total", F.sum("k").over(Window.partitionBy("grp", "dim")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bin"))) / FINE
    per = long.groupBy("grp", "dim").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("sd"))
    robust = per.groupBy("grp").agg(*[F.max(F.when(F.col("dim") == k, F.col("mid"))).alias(f"r{k}") for k in range(5)], *[F.max(F.when(F.col("dim") == k, F.col("sd"))).alias(f"d{k}") for k in range(5)])
    whole = rows.groupBy("grp").agg(F.count("*").alias("n"), F.count("*").alias("k"), *_moments())
    both = _means(whole).join(robust, "grp")
    kinds = []
    for start in range(3):
        mean = [F.col(f"m{k}") if start == 1 else F.col(f"r{k}") for k in range(5)]
        spread = [F.col(f"c{i}{j}") if start else F.col(f"d{i}") ** 2 if i == j else F.lit(0.0) for i, j in _PAIRS]
        kinds.append(both.select("grp", F.lit(start).alias("start"), "n", *[m.alias(f"m{k}") for k, m in enumerate(mean)], *[c.alias(f"c{i}{j}") for (i, j), c in zip(_PAIRS, spread)]))
    return _factored(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]))


_PAIRS = [(i, j) for i in range(5) for j in range(i + 1)]


def _moments() -> list[Column]:
    return [F.sum(FEATURES[i]).alias(f"s{i}") for i in range(5)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i, j in _PAIRS]


def _means(sums: DataFrame) -> DataFrame:
    """Means m<i> and covariances c<i><j> from sums over k rows."""
    mean = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("k") for i in range(5)})
    return mean.withColumns({f"c{i}{j}": F.col(f"p{i}{j}") / F.col("k") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in _PAIRS})


def _factored(est: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Cholesky factors l<i><j> of the covariances and the log determinant; what a statistic varies beside those before it is at least its floor."""
    for i in range(5):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(1, 5)), 2 * F.log("l00"))
    out = est.select("grp", "start", "n", F.lit(1.0).alias("scale"), logdet.alias("logdet"), *[f"m{k}" for k in range(5)], *[f"l{i}{j}" for i, j in _PAIRS])
    return cut(out if more is None else out.join(more, "grp"))


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i in range(5):
        rest = F.col(FEATURES[i]) - F.col(f"{prefix}m{i}")
        for k in range(i):
            rest = rest - F.col(f"{prefix}l{i}{k}") * z[k]
        z.append(rest / F.col(f"{prefix}l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0]) / F.col(f"{prefix}scale")


def _with_group(rows: DataFrame, est: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` with the estimates of their `grp`.  Up to MOST_GROUPS estimates go along with each task; more are joined by a shuffle, in SALTS copies, so that a group's rows are split."""
    if est.count() <= MOST_GROUPS:
        return rows.join(F.broadcast(est), "grp", how)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_")
    dealt = rows.withColumn("salt_", F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(est.select("*", salt), ["grp", "salt_"], how).drop("salt_")


def _distance_bin() -> Column:
    return F.floor(F.log2(F.greatest(_distance(), F.lit(1e-6))) * BIN).cast("int").alias("bin")


def _step(rows: DataFrame, est: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One concentration step: moments by distance bin, summed over the nearest H_SHARE of each group's rows; the covariance is made consistent for that share.

    `more` has further columns a group, which the result gets.
    """
    keys = ["grp", "start"]
    bins = _by_bin(_with_group(rows, est).select(*keys, *FEATURES, _distance_bin()), keys, *_moments())
    order = Window.partitionBy(*keys).orderBy("bin")
    bins = bins.withColumn("before", F.sum("k").over(order) - F.col("k")).withColumn("total", F.sum("k").over(Window.partitionBy(*keys)))
    inner = bins.where(F.col("before") < F.col("total") * H_SHARE).groupBy(*keys).agg(F.max("total").alias("n"), F.sum("k").alias("k"), *[F.sum(c).alias(c) for c in bins.columns if c[0] in "sp" and c[1:].isdigit()])
    mean = _means(inner)
    vary = sum((F.when(F.col(f"c{i}{i}") > FLOORS[i] ** 2, 1).otherwise(0) for i in range(1, 5)), F.when(F.col("c00") > FLOORS[0] ** 2, 1).otherwise(0))
    factor = F.element_at(F.array(*map(F.lit, CONSISTENT)), F.greatest(vary, F.lit(1)))
    found = mean.withColumn("factor", factor).withColumns({f"c{i}{j}": F.col("factor") * F.col(f"c{i}{j}") for i, j in _PAIRS})
    return _factored(found, more)


def _estimate(rows: DataFrame) -> DataFrame:
    """The estimate of least determinant of each group: all starts take TRIAL_STEPS, then the best one goes on while its determinant falls."""
    est = _starts(rows)
    for _ in range(TRIAL_STEPS):
        est = _step(rows, est)
    best = est.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    moving = cut(est.join(best, ["grp", "start"]))
    done = []
    for _ in range(TRIAL_STEPS, MOST_STEPS):
        new = _step(rows, moving, moving.select("grp", F.col("logdet").alias("was")))
        fell = F.col("logdet") < F.col("was") - FALL
        done.append(moving.join(new.where(~fell).select("grp"), "grp", "left_semi"))  # no less: the present one stays
        moving = new.where(fell).drop("was")
        if moving.isEmpty():
            break
    return cut(reduce(DataFrame.unionByName, done, moving).drop("start", "logdet"))


def _scaled(rows: DataFrame, est: DataFrame) -> DataFrame:
    """The estimate with the factor that makes the group's median distance consistent; it never shrinks below 1."""
    bins = _by_bin(_with_group(rows, est).select("grp", _distance_bin()), ["grp"])
    bins = bins.withColumn("upto", F.sum("k").over(Window.partitionBy("grp").orderBy("bin"))).withColumn("total", F.sum("k").over(Window.partitionBy("grp")))
    mid = bins.groupBy("grp").agg(F.min(F.when(F.col("upto") >= F.col("total") * 0.5, F.col("bin"))).alias("mid"))
    return cut(est.drop("scale").join(mid, "grp").withColumn("scale", F.greatest(F.pow(F.lit(2.0), (F.col("mid") + 1) / BIN) / CHI2_MEDIAN, F.lit(1.0))).drop("mid"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", source_col: str | None = "source", cutoff: float = CUTOFF) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance), one row per row of `docs`.

    A null text is empty and fails the base rules, as any text of fewer than 50 words does.  A null language or source is a
    value of its own.  With fewer than MIN_ROWS rows that pass the base rules, these alone decide and distance is null.
    Repeated rows count as often as they occur; an empty table gives an empty one; extra columns are ignored.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).cast("string").alias(n) if c else F.lit(None).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))))
    stats = text_statistics(slim).drop("text")
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    stats = stats.withColumns(
        {
            "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
            "x1": F.log1p(100.0 * F.col("n_symbols") / words),
            "x2": F.log1p(100.0 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            "x3": F.log1p(100.0 * F.col("n_repeat_words") / words),
            "x4": F.log(words),
        }
    )
    stats = cut(stats)
    groups = _groups("lang", "source")
    rows = stats.where("not base_failed").select(F.explode(F.array(*groups)).alias("grp"), *FEATURES)
    est = _scaled(rows, _estimate(rows)).where(F.col("n") >= MIN_ROWS)
    out = stats
    found = []
    for k, group in enumerate(groups):
        own = est.toDF(*["grp" if c == "grp" else f"e{k}_{c}" for c in est.columns])
        out = _with_group(out.withColumn("grp", group), own, "left").drop("grp")
        found.append(_distance(f"e{k}_"))
    distance = F.when(~F.col("base_failed"), F.coalesce(*found))
    out = out.withColumn("distance", distance)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "distance")
