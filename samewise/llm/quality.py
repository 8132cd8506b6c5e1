"""Quality rules: base limits on counts, and robust multivariate outliers per language and source.

The statistics of a text are counted once and written; the minimum-covariance-determinant estimates come from all rows
that pass the base limits, by concentration steps from several starts, of which the one of least determinant counts; the steps are
aggregations over those small rows. Null texts count as empty
and fail the base limit; null lang or source is a group of its own; groups of fewer than `least` rows are held against all rows
of their language, and languages of fewer against all rows (if these are fewer too, nothing is rejected); ties keep; repeated
rows count each; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.common import bounded_batches, cut

#: What separates words, and the characters that count as symbols.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list) -> int:
    """Words in 3-word windows found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 20:  # so that the product of three stays within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, where, counts = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[where] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def statistics(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "replace").split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five statistics, lines that aren't blank."""

    def run(batches):
        for b in batches:
            found = [(*statistics(s := t.as_py() or ""), sum(1 for line in s.split("\n") if line.strip(SPACES))) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], *(pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 6))],
                names=["doc_id", "lang", "source", *STATS, "n_lines"]
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    return own.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{s} long" for s in (*STATS, "n_lines")))


#: The transformed vector. Each is a share or mean, so that long texts aren't outliers for their length; the square root
#: of the number of words evens out what a short text's share varies more by.
VECTOR = {
    "x_length": "(word_chars / n_words - 5)",
    "x_symbols": "asin(sqrt(least(1, n_symbols / word_chars)))",
    "x_lines": "asin(sqrt(n_dup_lines / n_lines))",
    "x_repeats": "asin(sqrt(least(1, n_repeat_words / n_words)))",
}
#: Added to each variance, as a statistic that hardly varies in a group has hardly any. The sampling variance of a transformed
#: share of n is 1 / (4 n): that of 25 words or lines, so that 23 % where a group has none is as far as the cutoff. (With that of
#: 100, 3.8 % of the texts of sf0.1 labelled good were rejected, with this 1.4 %; of those labelled bad all, with either.)
FLOOR = {"x_length": 0.05, "x_symbols": 0.0025, "x_lines": 0.01, "x_repeats": 0.01}
#: The squared distance beyond which a row is an outlier: chi-squared with four degrees of freedom exceeds it once in 20,000.
CUTOFF = 25.0
#: Fixed value: the median of chi-squared with four degrees of freedom.
MEDIAN_4 = 3.3567
GROUP = ("lang", "source")


def _distance(x: list[str]) -> Column:
    """Squared Mahalanobis distance from the columns m_* and p_*_* (inverse covariance)."""
    d = [F.col(a) - F.col(f"m_{a}") for a in x]
    return reduce(lambda a, b: a + b, [d[i] * d[j] * F.col(f"p_{min(i, j)}_{max(i, j)}") for i in range(len(x)) for j in range(len(x))])


def _moments(rows: DataFrame, x: list[str]) -> DataFrame:
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    return rows.groupBy(*GROUP, "start").agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m_{a}") for a in x), *(F.covar_pop(x[i], x[j]).alias(f"c_{i}_{j}") for i, j in pairs))


def _inverted(moments: DataFrame, x: list[str]) -> DataFrame:
    """The inverse of covariance plus floor, and that sum's log determinant, a row for each group and start."""
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    floor = np.diag([FLOOR[a] for a in x])

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                c = np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(x))] for i in range(len(x))])
                p = np.linalg.inv(c + floor)
                out.append({
                    **{k: r[k] for k in (*GROUP, "start", "n", *(f"m_{a}" for a in x))}, "log_det": float(np.linalg.slogdet(c + floor)[1]),
                    **{f"p_{i}_{j}": float(p[i, j]) for i, j in pairs}
                })
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([
        *((k, pa.string()) for k in GROUP), ("start", pa.int32()), ("n", pa.int64()), ("log_det", pa.float64()),
        *((f"m_{a}", pa.float64()) for a in x), *((f"p_{i}_{j}", pa.float64()) for i, j in pairs)
    ])
    return moments.mapInArrow(run, "lang string, source string, start int, n long, " + ", ".join(f"{f.name} double" for f in list(schema)[4:]))


def _beside(rows: DataFrame, groups: DataFrame, most: int, keys=GROUP) -> DataFrame:
    """rows with the columns of the groups of the same keys; groups are broadcast if they are `most` at most, and the hot ones are split by AQE beyond."""
    groups = groups.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in groups.columns if c not in keys))
    small = groups.limit(most + 1).count() <= most
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(F.broadcast(groups) if small else groups, same, "left").drop(*(f"__{k}" for k in keys))


#: Starts besides that from the medians: rows of some classes of a hash, a DRAWN-th of all each.
DRAWN, DRAWS = 8, (0, 3, 5)


def robust_estimates(rows: DataFrame, share: float = 0.75, steps: int = 10, settled: float = 0.01, most: int = 20_000) -> DataFrame:
    """By lang and source: n, centre, inverse covariance, and `scale` (median distance over that of chi-squared).

    From each start (the medians with a diagonal scale, and the moments of drawn rows), each concentration step re-estimates from the
    `share` of a group's rows nearest to the last estimate, until no log determinant falls by more than `settled`, or `steps` times.
    Of a group's starts the estimate of least determinant counts, of equal ones the first. rows: with GROUP and the vector."""
    x = list(VECTOR)
    start = rows.groupBy(*GROUP).agg(
        F.count("*").alias("n"), *(F.percentile_approx(a, 0.5).alias(f"m_{a}") for a in x),
        *(F.percentile_approx(a, [0.25, 0.75]).alias(f"q_{a}") for a in x)
    )
    spread = [((F.col(f"q_{a}")[1] - F.col(f"q_{a}")[0]) / 1.349) for a in x]
    diagonal = [(1 / (s * s + FLOOR[a])).alias(f"p_{i}_{i}") for i, (a, s) in enumerate(zip(x, spread))]
    zero = [F.lit(0.0).alias(f"p_{i}_{j}") for i in range(len(x)) for j in range(i + 1, len(x))]
    medians = start.select(*GROUP, F.lit(0).alias("start"), "n", F.lit(float("inf")).alias("log_det"), *(f"m_{a}" for a in x), *diagonal, *zero)
    draw = F.pmod(F.xxhash64(*x), F.lit(DRAWN))
    number = F.coalesce(*[F.when(draw == d, k + 1) for k, d in enumerate(DRAWS)])
    drawn = _inverted(_moments(rows.withColumn("start", number).where("start is not null"), x), x)
    now = cut(medians.unionByName(drawn.withColumn("log_det", F.lit(float("inf")))), "mcd")
    keys = [*GROUP, "start"]
    for _ in range(steps):
        far = _beside(rows, now, most).select(*keys, *x, _distance(x).alias("d2"))
        limits = cut(far.groupBy(*keys).agg(F.percentile_approx("d2", share).alias("limit_")), "mcd")
        before = now
        now = cut(_inverted(_moments(_beside(far, limits, most, keys).where("d2 <= limit_"), x), x), "mcd")
        fell = _beside(now, before.select(*keys, F.col("log_det").alias("last")), most, keys).where(F.col("last") - F.col("log_det") > settled)
        if not fell.limit(1).count():
            break
    best = now.groupBy(*GROUP).agg(F.min(F.struct("log_det", "start", *(c for c in now.columns if c not in (*keys, "log_det")))).alias("b"))
    now = cut(best.select(*GROUP, "b.*").drop("start", "log_det"), "mcd")
    far = _beside(rows, now, most).select(*GROUP, _distance(x).alias("d2"))
    scale = far.groupBy(*GROUP).agg(F.count("*").alias("n_all"), F.greatest(F.lit(1.0), F.percentile_approx("d2", 0.5) / MEDIAN_4).alias("scale"))
    return now.join(
        scale.select(F.col("lang").alias("l_"), F.col("source").alias("s_"), "n_all", "scale"),
        F.col("lang").eqNullSafe(F.col("l_")) & F.col("source").eqNullSafe(F.col("s_"))
    ).drop("l_", "s_", "n").withColumnRenamed("n_all", "n")


def _own() -> Column:
    """A source's name as a pool's: 's' and the source, or 'n'; 'l' is all of a language, 'a' all of all."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _pools(rows: DataFrame, least: int) -> DataFrame:
    """By lang and source: pool_lang and pool_source, the rows that the group is held against."""
    groups = cut(rows.groupBy(*GROUP).agg(F.count("*").alias("n_own")), "groups")
    langs = groups.groupBy(F.col("lang").alias("__l")).agg(F.sum("n_own").alias("n_lang"))
    both = groups.join(langs, F.col("lang").eqNullSafe(F.col("__l")))
    own, of_lang = F.col("n_own") >= least, F.col("n_lang") >= least
    return cut(both.select(*GROUP, F.when(own | of_lang, F.col("lang")).alias("pool_lang"), F.when(own, _own()).when(of_lang, "l").otherwise("a").alias("pool_source")), "pools")


def judge(docs: DataFrame, least_words: int = 50, most_repeated: int = 50, least: int = 40, cutoff: float = CUTOFF, most: int = 20_000) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance (squared, null where nothing was estimated), kept."""
    bounded_batches(docs.sparkSession)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    measured = cut(measure(docs).withColumn("base_failed", failed), "statistics")
    rows = measured.where(~F.col("base_failed")).select(*GROUP, *(F.expr(e).alias(a) for a, e in VECTOR.items()))
    pools = _pools(rows, least)
    # all rows by lang and source, and again where a small group needs them, by its language or all together
    wide = [
        rows.select(lang.alias("lang"), source.alias("source"), *VECTOR) for lang,
        source in ((F.col("lang"), _own()), (F.col("lang"), F.lit("l")), (F.lit(None).cast("string"), F.lit("a")))
    ]
    needed = F.broadcast(pools.select(
        F.col("pool_lang").alias("__l"), F.col("pool_source").alias("__s")
    ).distinct()) if pools.limit(most + 1).count() <= most else pools.select(F.col("pool_lang").alias("__l"), F.col("pool_source").alias("__s")).distinct()
    with_vector = reduce(DataFrame.unionByName, wide).join(needed, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")), "left_semi")
    estimates = cut(robust_estimates(with_vector, most=most), "mcd").where(F.col("n") >= least)
    of_group = pools.join(
        estimates.withColumnsRenamed({"lang": "__l", "source": "__s"}),
        F.col("pool_lang").eqNullSafe(F.col("__l")) & F.col("pool_source").eqNullSafe(F.col("__s"))
    ).drop("__l", "__s", "pool_lang", "pool_source")
    vector = [F.when(~F.col("base_failed"), F.expr(e)).alias(a) for a, e in VECTOR.items()]
    far = _beside(measured.select("*", *vector), cut(of_group, "mcd"), most)
    distance = F.when(~F.col("base_failed"), _distance(list(VECTOR)) / F.col("scale"))
    return far.select("doc_id", *GROUP, *STATS, "base_failed", distance.alias("distance")).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    )
