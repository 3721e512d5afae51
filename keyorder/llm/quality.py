"""Quality rules as robust multivariate outliers, with DataFrame operations only.

Counts of each text are turned into a vector of four transformed rates.  For
each language and source the minimum covariance determinant estimate (the
centre and covariance of the most compact three quarters of the documents) is
found by concentration steps from two deterministic starts, repeated until no
determinant falls any more, reweighted, and documents whose Mahalanobis distance
exceeds a chi-square quantile are rejected.

A covariance of four rates needs ``MIN_GROUP`` documents to mean anything.
Sources with fewer are pooled by language, languages with fewer by all; a pool
that is still small rejects nobody.  Every covariance is regularised by
the squared ``FLOORS``, so a rate that is constant in a group can't reject on noise.

Null and empty texts have no words, a text of any length is counted whole, null
languages and sources are read as empty strings, and rows that repeat an id or
a text are rows of their own.  An empty table gives no rows.  Columns with the
names of new ones are replaced; all others are kept, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyorder.llm.common import discard, materialize, write_table

#: White space between words.
BLANK = r"[\x20\x09-\x0D]"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW_WORDS = 5

#: Base rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

DIMS = 4
#: Least standard deviations of the vector's parts: log word length, and logs of
#: one plus symbols per 1000 characters, repeated lines per 100 words, and
#: percent of words in repeated windows.
FLOORS = (0.06, 0.4, 0.4, 0.5)
#: Words of a typical document that are added to each before its rates are taken; steadies short ones.
PRIOR_WORDS = 50
#: Documents a group needs for an estimate of its own.
MIN_GROUP = 60
#: Share of a group that the estimate covers.
COVERED = 0.75
#: A concentration step that lowers no log determinant by more than this is the last.
CONVERGED = 1e-4
#: Share of documents of an ideal normal group that the rule rejects.
ALPHA = 1e-7
#: Estimates are broadcast up to this many groups and joined by shuffle beyond it.
BROADCAST_GROUPS = 20_000

#: Files of a table with a row for each group.
FILES = 4

PAIRS = list(combinations_with_replacement(range(DIMS), 2))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _chi2(x: float, k: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def _chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, k) < p else (low, mid)
    return high


def _consistency(share: float) -> float:
    """Factor by which the covariance of the central share of a normal sample falls short."""
    return share / _chi2(_chi2_quantile(share, DIMS), DIMS + 2)


def _joined(a: Column, shift: int, b: Column) -> Column:
    """Hashes of pairs of an element of ``a`` and the one of ``b`` that is ``shift`` further."""
    return F.zip_with(a, F.slice(b, F.lit(shift + 1), F.greatest(F.size(b) - shift, F.lit(0))), lambda x, y: F.xxhash64(x, y))


def covered_words(pairs: Column) -> Column:
    """Words covered by the windows that occur more than once; pairs: sorted (hash, index) of all windows."""

    def same(k: Column, p: Column) -> Column:
        return F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))

    found = F.filter(pairs, lambda p, k: same(k - 1, p) | same(k + 1, p))
    starts = F.sort_array(F.transform(found, lambda p: p["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))

    def step(acc: Column, s: Column) -> Column:
        gained = s + WINDOW_WORDS - F.greatest(s, acc["end"])
        return F.struct((s + WINDOW_WORDS).alias("end"), (acc["sum"] + gained).alias("sum"))

    return F.aggregate(starts, zero, step)["sum"]


def _kept(df: DataFrame, *replaced: str) -> Column:
    """The columns of ``df`` as one struct, out of the way of all other names."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in {r.lower() for r in replaced})).alias("row")


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the counts of its texts and ``base_failed``; one narrow pass."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.trim("text", F.lit(" \t\n\x0b\f\r"))
    no_pairs = F.array().cast("array<struct<h:bigint,i:int>>")
    found = df.select(_kept(df, *(c for c in (*COUNTS, "base_failed") if c != text_col)), text.alias("text")).select(
        "row",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(WORD_CHAR))).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    # Hashes of windows of one, two, four and five words: each a column of its own, so that it is computed once.
    found = found.withColumns({"h1": F.transform("words", lambda w: F.xxhash64(w)), "n_words": F.size("words").cast("long")})
    found = found.withColumn("h2", _joined(F.col("h1"), 1, F.col("h1")))
    found = found.withColumn("h4", _joined(F.col("h2"), 2, F.col("h2")))
    whole = F.greatest(F.col("n_words").cast("int") - (WINDOW_WORDS - 1), F.lit(0))
    found = found.withColumn("h5", F.slice(_joined(F.col("h4"), 4, F.col("h1")), F.lit(1), whole))
    marked = F.sort_array(F.transform("h5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = found.withColumn("pairs", F.when(F.size(F.array_distinct("h5")) < F.size("h5"), marked).otherwise(no_pairs))
    found = found.select(
        "row",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("pairs") == 0, F.lit(0)).otherwise(covered_words(F.col("pairs"))).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).select("row.*", *COUNTS, "base_failed")


def _group(lang: str, source: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(lang).cast("string"), F.lit("")), F.coalesce(F.col(source).cast("string"), F.lit(""))


def vector(typical: Column) -> list[Column]:
    """Transformed rates; ``typical`` is the group's median word length."""
    n = F.col("n_words") + PRIOR_WORDS
    chars = F.col("word_chars") + PRIOR_WORDS * typical
    return [
        F.log(chars / n),
        F.log1p(1000 * F.col("n_symbols") / chars),
        F.log1p(100 * F.col("n_dup_lines") / n),
        F.log1p(100 * F.col("n_repeat_words") / n),
    ]


def _distance(x: list[Column], centre: list[Column], root: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution with a Cholesky root."""
    y: list[Column] = []
    for i in range(DIMS):
        rest = x[i] - centre[i]
        for j in range(i):
            rest = rest - root[i, j] * y[j]
        y.append(rest / root[i, i])
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _with_root(moments: DataFrame, factor: float) -> DataFrame:
    """Adds the Cholesky root l_ij of factor x covariance + floors squared, and its log determinant."""
    out = moments
    for j in range(DIMS):
        for i in range(j, DIMS):
            rest = F.col(f"c{j}{i}") * factor + (FLOORS[i] ** 2 if i == j else 0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(1, DIMS)), F.log("l00")))


def _moments(prefix: str = "x") -> list[Column]:
    x = [F.col(f"{prefix}{i}") for i in range(DIMS)]
    return [F.avg(x[i]).alias(f"m{i}") for i in range(DIMS)] + [F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i, j in PAIRS]


ESTIMATE = [f"m{i}" for i in range(DIMS)] + [f"l{j}{i}" for i, j in PAIRS]


def _measured(rows: DataFrame, estimates: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """rows with d2, their squared distance under the estimate of their keys; under each that has those keys which rows have."""
    estimates = estimates.select(*keys, *ESTIMATE)
    shared = [k for k in keys if k in rows.columns]
    root = {(i, j): F.col(f"l{i}{j}") for i in range(DIMS) for j in range(i + 1)}
    d2 = _distance([F.col(f"x{i}") for i in range(DIMS)], [F.col(f"m{i}") for i in range(DIMS)], root)
    return rows.join(F.broadcast(estimates) if small else estimates, shared).withColumn("d2", d2).drop(*ESTIMATE)


def labels(rows: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, group, typical) of every language and source: the group whose estimate judges it."""
    lang, source = _group(lang_col, source_col)
    counted = rows.select(lang.alias("lang"), source.alias("source"), "base_failed", F.try_divide("word_chars", "n_words").alias("w"))
    each = counted.groupBy("lang", "source").agg(
        F.count_if(~F.col("base_failed")).alias("n"),
        F.percentile_approx(F.when(~F.col("base_failed"), F.col("w")), 0.5, F.lit(1000)).alias("median"),
    )
    pooled = F.sum(F.when(F.col("n") < MIN_GROUP, F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    group = (
        F.when(F.col("n") >= MIN_GROUP, F.to_json(F.array("lang", "source")))
        .when(pooled >= MIN_GROUP, F.to_json(F.array("lang")))
        .otherwise(F.lit("[]"))
    )
    grouped = each.withColumn("group", group)
    mean = F.sum(F.col("median") * F.col("n")).over(Window.partitionBy("group")) / F.sum("n").over(Window.partitionBy("group"))
    return grouped.select("lang", "source", "group", F.coalesce(mean, F.lit(5.0)).alias("typical"))


def _placed(rows: DataFrame, table: DataFrame, lang_col: str, source_col: str, small: bool, *columns: Column | str) -> DataFrame:
    """Columns and counts of rows, with those of ``table``, which has one row for each language and source."""
    lang, source = _group(lang_col, source_col)
    slim = rows.select(lang.alias("lang"), source.alias("source"), *COUNTS, "base_failed", *columns)
    return slim.join(F.broadcast(table) if small else table, ["lang", "source"], "left")


def fit(rows: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Estimates for each language and source, written to the shared folder.

    rows: the counts of ``statistics`` (written ones: they are read once for each step).
    """
    spark = rows.sparkSession
    made: list[str] = []

    def written(df: DataFrame, name: str, files: int | None = FILES) -> DataFrame:
        made.append(write_table(df, name, files))
        return spark.read.schema(df.schema).parquet(made[-1])

    try:
        where = written(labels(rows, lang_col, source_col), "mcd-groups")
        small = where.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
        good = _placed(rows.filter(~F.col("base_failed")), where, lang_col, source_col, small)
        x = written(good.select("group", *(v.alias(f"x{i}") for i, v in enumerate(vector(F.col("typical"))))), "mcd-vectors", None)
        final = _concentrated(x, small, written)
        return materialize(where.join(final.select("group", *ESTIMATE), "group", "left"), "mcd-estimates", FILES)
    finally:
        discard(spark, *made)


def _concentrated(x: DataFrame, small: bool, written: Callable[..., DataFrame]) -> DataFrame:
    """The reweighted estimate of each group of vectors x0.. that is large enough."""
    # Medians and deviations, then two starts: those, and the correlations of squashed scores.
    q = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], F.lit(1000)).alias(f"q{i}") for i in range(DIMS)]
    spread = lambda i: (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349
    scale = x.groupBy("group").agg(*q, F.count("*").alias("n")).select(
        "group", "n", *(F.col(f"q{i}")[1].alias(f"med{i}") for i in range(DIMS)),
        *(F.greatest(spread(i), F.lit(FLOORS[i])).alias(f"s{i}") for i in range(DIMS)),
    )
    scale = written(scale.filter(F.col("n") >= MIN_GROUP), "mcd-scale")
    plain = scale.select(
        "group", F.lit(0).alias("start"), *(F.col(f"med{i}").alias(f"m{i}") for i in range(DIMS)),
        *((F.col(f"s{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS),
    )
    squashed = x.join(F.broadcast(scale) if small else scale, "group").select(
        "group", *(F.tanh((F.col(f"x{i}") - F.col(f"med{i}")) / F.col(f"s{i}")).alias(f"t{i}") for i in range(DIMS))
    )
    spun = (
        squashed.groupBy("group")
        .agg(*[m for k, m in enumerate(_moments("t")) if k >= DIMS])
        .join(scale, "group")
        .select(
            "group", F.lit(1).alias("start"), *(F.col(f"med{i}").alias(f"m{i}") for i in range(DIMS)),
            *((F.col(f"c{i}{j}") * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}") for i, j in PAIRS),
        )
    )
    estimates = written(_with_root(plain.unionByName(spun), 1.0).withColumns({"open": F.lit(True), "step": F.lit(0)}), "mcd-step")
    keys = ["group", "start"]
    shown = ["open", "logdet", *ESTIMATE]
    while estimates.filter("open").limit(1).count():
        opened = estimates.filter("open")
        measured = _measured(x, opened, keys, small)
        inside = measured.groupBy(*keys).agg(F.percentile_approx("d2", COVERED, F.lit(1000)).alias("most"))
        core = measured.join(F.broadcast(inside) if small else inside, keys).filter(F.col("d2") <= F.col("most"))
        stepped = _with_root(core.groupBy(*keys).agg(*_moments()), _consistency(COVERED))
        # The start's own determinant isn't that of three quarters of the rows: the first step is never the last.
        before = estimates.select(*keys, F.struct("step", *shown).alias("old"))
        fell = (F.col("old.step") == 0) | F.coalesce(F.col("old.logdet") - F.col("logdet") > CONVERGED, F.lit(False))
        pick = lambda c: F.when(F.col("old.open") & fell, F.col(c)).otherwise(F.col(f"old.{c}")).alias(c)
        joined = before.join(stepped, keys, "left")
        estimates = written(joined.select(*keys, (F.col("old.step") + 1).alias("step"), (F.col("old.open") & fell).alias("open"), *map(pick, shown[1:])), "mcd-step")
    best = Window.partitionBy("group").orderBy("logdet", "start")
    raw = estimates.withColumn("k", F.row_number().over(best)).filter("k = 1")
    share = 0.975
    near = _measured(x, raw, ["group"], small).filter(F.col("d2") <= _chi2_quantile(share, DIMS))
    return _with_root(near.groupBy("group").agg(*_moments()), _consistency(share))


def judge(rows: DataFrame, estimates: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """rows with ``distance`` (squared; null where no estimate exists) and ``kept``.

    rows should be written ones: a filter on ``kept`` would else repeat the counting for every use of a count.
    """
    small = estimates.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    placed = _placed(rows, estimates, lang_col, source_col, small, _kept(rows, "distance", "kept"))
    root = {(i, j): F.col(f"l{i}{j}") for i in range(DIMS) for j in range(i + 1)}
    d2 = _distance(vector(F.col("typical")), [F.col(f"m{i}") for i in range(DIMS)], root)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= _chi2_quantile(1 - ALPHA, DIMS), F.lit(True))
    return placed.withColumn("distance", F.when(~F.col("base_failed"), d2)).withColumn("kept", kept).select("row.*", "distance", "kept")
