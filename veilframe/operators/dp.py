"""Central differential privacy.

Each function returns a plan: one aggregation, with noise in a projection above it. ``release`` charges
the ledger first, then fixes the plan's draws by writing them once, so that a retry or a second action
can't draw again for the same charge. Do not hand out a plan over ``SecureNoise`` without it.
"""

from __future__ import annotations

import hashlib
import math
from builtins import sum as builtin_sum
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.noise import HashNoise, SecureNoise
from veilframe.functions.text import let
from veilframe.plans.budget import BudgetAccountant, PrivacyError
from veilframe.plans.storage import persisted

SECURE = SecureNoise()
CLIP_BITS = 12


def release(plan: Callable[[], DataFrame], accountant: BudgetAccountant, epsilon: float, delta: float = 0.0) -> DataFrame:
    """Build the plan (which validates), spend, run it once, return what was drawn."""
    df = plan()
    accountant.spend(epsilon, delta)
    return persisted(df, "release")


def mechanism_of(epsilon: float, delta: float, mechanism: str | None) -> str:
    if not epsilon > 0:
        raise PrivacyError(f"epsilon must be positive, got {epsilon}")
    mech = "laplace" if mechanism is None else mechanism.strip().lower()
    if mech not in ("laplace", "gaussian"):
        raise PrivacyError(f"unknown mechanism {mechanism!r}")
    if mech == "gaussian" and not delta > 0:
        raise PrivacyError("the Gaussian mechanism needs delta > 0")
    return mech


def _sigma(delta: float) -> float:
    return math.sqrt(2 * math.log(1.25 / delta)) if delta > 0 else math.inf


def _draw(noise: SecureNoise, key: Column, mech: str, sensitivity: Column | float, epsilon: float, delta: float) -> Column:
    s = F.lit(float(sensitivity)) if isinstance(sensitivity, (int, float)) else sensitivity
    if mech == "laplace":
        return noise.laplace(s / epsilon, key)
    return F.when(s > 0, noise.gaussian(s * (_sigma(delta) / epsilon), key)).otherwise(0.0)


def _at_least_zero(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def noisy_count(true: Column, epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", noise: SecureNoise = SECURE, key: str | Column = "count") -> Column:
    """A true count with noise of sensitivity 1, not below 0."""
    mech = mechanism_of(epsilon, delta, mechanism)
    return _at_least_zero(true.cast("double") + _draw(noise, _key(key), mech, 1.0, epsilon, delta))


def noisy_sum(true: Column, sensitivity: float | Column, epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", noise: SecureNoise = SECURE, key: str | Column = "sum") -> Column:
    mech = mechanism_of(epsilon, delta, mechanism)
    return true.cast("double") + _draw(noise, _key(key), mech, sensitivity, epsilon, delta)


def noisy_mean(true_sum: Column, true_count: Column, sensitivity: float | Column, epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", min_count: int = 0, noise: SecureNoise = SECURE, key: str = "mean") -> Column:
    """Half the budget for the count, half for the sum; 0 where the noisy count is below ``min_count``
    or not positive. The count is drawn once, for the test and the division."""
    n = noisy_count(true_count, epsilon / 2, delta / 2, mechanism, noise, f"{key}.count")
    s = noisy_sum(true_sum, sensitivity, epsilon / 2, delta / 2, mechanism, noise, f"{key}.sum")
    return let(n, lambda drawn: F.when((drawn > 0) & (drawn >= min_count), s / drawn).otherwise(0.0))


def _key(key: str | Column) -> Column:
    return F.lit(key) if isinstance(key, str) else key


def count(df: DataFrame, column: str, epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", noise: SecureNoise = SECURE) -> DataFrame:
    """Noisy number of non-null values."""
    return df.agg(F.count(column).alias("n")).select(noisy_count(F.col("n"), epsilon, delta, mechanism, noise).alias("value"))


def _bounds(lower: float | None, upper: float | None, mech: str) -> None:
    if (lower is None) != (upper is None):
        raise PrivacyError("give both clip bounds or neither")
    if lower is not None and lower > upper:
        raise PrivacyError("the lower clip bound is above the upper")
    if lower is None and mech == "gaussian":
        raise PrivacyError("the Gaussian mechanism needs clip bounds")


def _clipped(c: Column, lower: float | None, upper: float | None) -> Column:
    c = F.coalesce(c.cast("double"), F.lit(0.0))
    if lower is not None:
        c = F.greatest(F.lit(float(lower)), c)
    if upper is not None:
        c = F.least(F.lit(float(upper)), c)
    return c


def _sum_parts(df: DataFrame, column: str, lower: float | None, upper: float | None) -> tuple[DataFrame, Column]:
    """(n, s[, lo, hi]) in one aggregation, and the sensitivity. Without bounds the data's own range is
    used, which does not protect its extremes."""
    v = F.col(column)
    aggs = [F.count("*").alias("n"), F.coalesce(F.sum(_clipped(v, lower, upper)), F.lit(0.0)).alias("s")]
    if lower is None:
        zeroed = _clipped(v, None, None)
        return df.agg(*aggs, F.min(zeroed).alias("lo"), F.max(zeroed).alias("hi")), F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0))
    return df.agg(*aggs), F.lit(float(upper - lower))


def sum(df: DataFrame, column: str, epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", lower: float | None = None, upper: float | None = None, noise: SecureNoise = SECURE) -> DataFrame:  # noqa: A001
    """Noisy sum; nulls count as 0, values are clipped to the bounds."""
    _bounds(lower, upper, mechanism_of(epsilon, delta, mechanism))
    parts, sensitivity = _sum_parts(df, column, lower, upper)
    return parts.select(noisy_sum(F.col("s"), sensitivity, epsilon, delta, mechanism, noise).alias("value"))


def mean(df: DataFrame, column: str, epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", lower: float | None = None, upper: float | None = None, noise: SecureNoise = SECURE) -> DataFrame:
    """Noisy mean over all rows, nulls as 0; an empty table gives 0."""
    _bounds(lower, upper, mechanism_of(epsilon, delta, mechanism))
    parts, sensitivity = _sum_parts(df, column, lower, upper)
    m = noisy_mean(F.col("s"), F.col("n"), sensitivity, epsilon, delta, mechanism, 0, noise)
    return parts.select(F.when(F.col("n") == 0, 0.0).otherwise(m).alias("value"))


def _domain(df: DataFrame, categories: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(categories)], "bucket string")


def histogram(df: DataFrame, column: str, categories: list[str], epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", noise: SecureNoise = SECURE, keep_others: bool = False) -> DataFrame:
    """(bucket, value): noisy counts of the declared categories, absent ones included. Values outside
    them are dropped, or kept with ``keep_others``."""
    mechanism_of(epsilon, delta, mechanism)
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("bucket")).agg(F.count("*").alias("n"))
    both = _domain(df, categories).join(counts, "bucket", "full_outer" if keep_others else "left")
    return noisy_histogram(both.select("bucket", F.coalesce("n", F.lit(0)).alias("value")), epsilon, delta, mechanism, noise)


def noisy_histogram(df: DataFrame, epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", noise: SecureNoise = SECURE) -> DataFrame:
    """Independent noise for each (bucket, value)."""
    return df.select("bucket", noisy_count(F.col("value"), epsilon, delta, mechanism, noise, F.col("bucket")).alias("value"))


def chunked_count(df: DataFrame, chunks: str, epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", noise: SecureNoise = SECURE) -> DataFrame:
    """Arrays of values; nulls in them count."""
    return df.agg(F.coalesce(F.sum(F.greatest(F.size(chunks), F.lit(0))), F.lit(0)).alias("n")).select(noisy_count(F.col("n"), epsilon, delta, mechanism, noise).alias("value"))


def _chunk_sum(chunks: str, lower: float | None, upper: float | None) -> Column:
    return F.aggregate(F.coalesce(F.col(chunks).cast("array<double>"), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + _clipped(x, lower, upper))


def _chunk_sensitivity(lower: float | None, upper: float | None) -> float:
    return float(upper - lower) if lower is not None and upper is not None else 1.0


def chunked_sum(df: DataFrame, chunks: str, epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", lower: float | None = None, upper: float | None = None, noise: SecureNoise = SECURE) -> DataFrame:
    """One-sided bounds are allowed; without both the sensitivity is 1."""
    s = df.agg(F.coalesce(F.sum(_chunk_sum(chunks, lower, upper)), F.lit(0.0)).alias("s"))
    return s.select(noisy_sum(F.col("s"), _chunk_sensitivity(lower, upper), epsilon, delta, mechanism, noise).alias("value"))


def chunked_mean(df: DataFrame, chunks: str, epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", lower: float | None = None, upper: float | None = None, min_count: int = 5, noise: SecureNoise = SECURE) -> DataFrame:
    """0 where there are fewer than ``min_count`` values."""
    parts = df.agg(F.coalesce(F.sum(F.greatest(F.size(chunks), F.lit(0))), F.lit(0)).alias("n"), F.coalesce(F.sum(_chunk_sum(chunks, lower, upper)), F.lit(0.0)).alias("s"))
    m = noisy_mean(F.col("s"), F.col("n"), _chunk_sensitivity(lower, upper), epsilon, delta, mechanism, min_count, noise)
    return parts.select(F.when(F.col("n") < min_count, 0.0).otherwise(m).alias("value"))


def chunked_histogram(df: DataFrame, chunks: str, categories: list[str], epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", noise: SecureNoise = SECURE) -> DataFrame:
    """Values outside the categories are kept."""
    return histogram(df.select(F.explode(chunks).alias("v")), "v", categories, epsilon, delta, mechanism, noise, keep_others=True)


def vector_dimension(df: DataFrame, column: str) -> int | None:
    """The largest dimension among the vectors; None if there are none."""
    return df.agg(F.max(F.when(F.col(column).isNotNull(), F.size(column)))).first()[0]


def _partial_sums(max_norm: float):
    """Of a partition's vectors (array<double>): their number, then the sums of the coordinates of the vectors
    scaled to norm ``max_norm`` at most."""

    def run(batches):
        total = np.zeros(1)
        for b in batches:
            v = b.column("v").drop_null()
            sizes = np.asarray(v.value_lengths())
            flat = v.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            if len(sizes) and sizes.max() >= len(total):
                total = np.append(total, np.zeros(int(sizes.max()) + 1 - len(total)))
            total[0] += len(sizes)
            for size in np.unique(sizes[sizes > 0]):
                own = np.flatnonzero(sizes == size)
                for lo in range(0, len(own), max(1, (1 << 20) // size)):
                    ends_here = ends[own[lo : lo + max(1, (1 << 20) // size)]]
                    rows = flat[(ends_here - size)[:, None] + np.arange(size)]
                    norm = np.sqrt((rows * rows).sum(axis=1))
                    factor = np.divide(max_norm, norm, out=np.ones(len(norm)), where=norm > max_norm)
                    total[1 : size + 1] += factor @ rows
        if total[0]:
            yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], ["t"])

    return run


def _vector_sums(df: DataFrame, column: str, max_norm: float) -> DataFrame:
    """One row (n, s): the number of vectors and the array of the sums of their coordinates. Shorter vectors count
    as zero where they end. A partition adds its vectors up as arrays, and only these sums are shuffled, by
    coordinate: the plan is the same for any dimension."""
    vectors = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v"))
    partial = vectors.mapInArrow(_partial_sums(max_norm), "t array<double>").select(F.posexplode("t").alias("pos", "x"))
    sums = partial.groupBy("pos").agg(F.sum("x").alias("x"))
    whole = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("t"))
    return whole.filter(F.size("t") > 0).select(F.get("t", F.lit(0)).alias("n"), F.slice("t", F.lit(2), F.size("t")).alias("s"))


def _vector_scale(dim: int, max_norm: float, epsilon: float, delta: float, mech: str) -> float:
    return max_norm * math.sqrt(2 * dim) / epsilon if mech == "laplace" else _sigma(delta) * max_norm * math.sqrt(dim) / epsilon


def vector_sum(df: DataFrame, column: str, max_norm: float, epsilon: float, delta: float = 1e-5, mechanism: str | None = "gaussian", noise: SecureNoise = SECURE) -> DataFrame:
    """(pos, value): noisy sum of L2-clipped vectors; no vectors give no rows."""
    mech, dim = mechanism_of(epsilon, delta, mechanism), vector_dimension(df, column)
    parts = _vector_sums(df, column, max_norm).select(F.posexplode("s").alias("pos", "s"))
    scale, key = _vector_scale(dim or 0, max_norm, epsilon, delta, mech), F.concat(F.lit("v"), F.col("pos"))
    return parts.select("pos", (F.col("s") + (noise.laplace(scale, key) if mech == "laplace" else noise.gaussian(scale, key))).alias("value"))


def vector_mean(df: DataFrame, column: str, max_norm: float, epsilon: float, delta: float = 1e-5, mechanism: str | None = "gaussian", min_count: int = 5, noise: SecureNoise = SECURE) -> DataFrame:
    """(pos, value): half the budget for the count; a noisy count below ``min_count`` gives zeros. All coordinates
    are divided by the one count that is drawn."""
    mech, dim = mechanism_of(epsilon, delta, mechanism), vector_dimension(df, column)
    scale, key = _vector_scale(dim or 0, max_norm, epsilon / 2, delta / 2, mech), F.concat(F.lit("v"), F.col("pos"))
    drawn = _vector_sums(df, column, max_norm).select(noisy_count(F.col("n"), epsilon / 2, delta / 2, mechanism, noise, "vector.count").alias("n"), "s")
    parts = drawn.select("n", F.posexplode("s").alias("pos", "s"))
    s = F.col("s") + (noise.laplace(scale, key) if mech == "laplace" else noise.gaussian(scale, key))
    return parts.select("pos", F.when((F.col("n") >= min_count) & (F.col("n") > 0), s / F.col("n")).otherwise(0.0).alias("value"))


def adaptive_clip(df: DataFrame, column: str, epsilon: float, quantile: float = 0.95, iterations: int = 15, initial: float = 10.0, noise: SecureNoise = SECURE) -> tuple[float, float]:
    """(smallest value, clip): binary search for the quantile in [0, initial].

    The search only ever compares with points of a dyadic grid, so one aggregation by grid cell answers
    ``CLIP_BITS`` of its questions; the cells of the interval that they leave answer the next ones. At most
    2**CLIP_BITS + 2 counts reach the driver at a time.
    """
    if not epsilon > 0:
        raise PrivacyError("epsilon must be positive")
    if not 0 <= iterations <= 60:
        raise PrivacyError("between 0 and 60 iterations")
    whole = 1 << iterations
    place = F.col(column).cast("double") / initial * whole
    low, high, least, n = 0, whole, None, 0
    for start in range(0, iterations, CLIP_BITS):
        bits = min(CLIP_BITS, iterations - start)
        width = (high - low) >> bits  # of a cell, in points of the finest grid
        base = low
        cell = F.greatest(F.lit(0), F.least(F.lit((1 << bits) + 1), F.ceil((place - base) / width)))
        rows = df.filter(F.col(column).isNotNull()).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("lo")).collect()
        if not rows:
            return 0.0, initial
        above = [0] * ((1 << bits) + 3)  # above[i]: values in cells beyond i
        for r in rows:
            above[r["cell"]] += r["n"]
        total = 0
        for i in range(len(above) - 1, -1, -1):
            above[i], total = total, total + above[i]
        n, least = total, min(r["lo"] for r in rows)
        for i in range(start, start + bits):
            mid = (low + high) // 2
            if above[(mid - base) // width] / n + _driver_laplace(noise, iterations / (n * epsilon), f"clip{i}") > 1 - quantile:
                low = mid
            else:
                high = mid
    if least is None:
        least = df.agg(F.min(column)).first()[0]
        return (0.0, initial) if least is None else (float(least), float(initial))
    return float(least), initial * high / whole


def _driver_laplace(noise: SecureNoise, scale: float, key: str) -> float:
    if isinstance(noise, HashNoise):
        u = (int(hashlib.md5(f"{key}|{noise.seed}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52) - 0.5
    else:
        import random

        u = random.SystemRandom().random() - 0.5
    return -scale * math.copysign(1, u) * math.log(max(1 - 2 * abs(u), 5e-324))


def group_by(df: DataFrame, group: str, target: str, agg: str, epsilon: float, delta: float = 1e-5, lower: float | None = None, upper: float | None = None, mechanism: str | None = "laplace", noise: SecureNoise = SECURE, semantics: str = "reference") -> DataFrame:
    """(group, value): noisy aggregates of the groups whose noisy size reaches 1 + 1/epsilon.

    A null group is "null"; targets that are no numbers count as 0. Reference semantics take any
    mechanism that is not laplace for Gaussian; intended semantics refuse unknown ones and delta <= 0.
    """
    if not epsilon > 0:
        raise PrivacyError("epsilon must be positive")
    mech = "laplace" if mechanism is None else mechanism.strip().lower()
    if semantics == "intended":
        mech = mechanism_of(epsilon, delta, mechanism)
    numeric = df.schema[target].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")
    v = _clipped(F.col(target) if numeric else F.lit(0.0), lower, upper)
    what = {"sum": F.sum(v), "mean": F.avg(v)}.get(agg.lower(), F.count("*").cast("double"))
    groups = df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("null")).alias("group")).agg(what.alias("a"), F.count("*").alias("n"))
    sensitivity = _chunk_sensitivity(lower, upper)
    drawn = noise.laplace(sensitivity / epsilon, F.col("group")) if mech == "laplace" else noise.gaussian(_sigma(delta) * sensitivity / epsilon, F.col("group"))
    size = F.col("n") + noise.laplace(1 / epsilon, F.concat(F.col("group"), F.lit("#size")))
    return groups.select("group", (F.col("a") + drawn).alias("value"), size.alias("size")).filter(F.col("size") >= 1 + 1 / epsilon).select("group", "value")


def aggregate(df: DataFrame, specs: dict[str, tuple[str, dict]], epsilon: float, delta: float = 0.0, mechanism: str | None = "laplace", noise: SecureNoise = SECURE) -> DataFrame:
    """(column, statistic, bucket, value) for specs {column: (count|sum|mean|histogram, options)}.

    The budget is split evenly between the specs. Counts, sums and means share one pass.
    """
    share, d = epsilon / len(specs), delta / len(specs)
    mech = mechanism_of(share, d, mechanism)
    one, parts, out = [], [], None
    for i, (column, (what, options)) in enumerate(specs.items()):
        lower, upper = options.get("clip_lower"), options.get("clip_upper")
        if what == "histogram":
            own = histogram(df, column, options["categories"], share, d, mechanism, noise).select(F.lit(column).alias("column"), F.lit(what).alias("statistic"), "bucket", "value")
            out = own if out is None else out.unionByName(own)
            continue
        if what not in ("count", "sum", "mean"):
            raise PrivacyError(f"unknown statistic {what!r}")
        if what != "count":
            _bounds(lower, upper, mech)
            if lower is None:
                raise PrivacyError(f"{column}: sums and means need clip bounds")
            one.append(F.coalesce(F.sum(_clipped(F.col(column), lower, upper)), F.lit(0.0)).alias(f"s{i}"))
        one += [F.count(column if what == "count" else "*").alias(f"n{i}")]
        value = {"count": lambda i=i, c=column: noisy_count(F.col(f"n{i}"), share, d, mechanism, noise, f"{c}.count"), "sum": lambda i=i, c=column, s=(upper or 0) - (lower or 0): noisy_sum(F.col(f"s{i}"), float(s), share, d, mechanism, noise, f"{c}.sum"), "mean": lambda i=i, c=column, s=(upper or 0) - (lower or 0): noisy_mean(F.col(f"s{i}"), F.col(f"n{i}"), float(s), share, d, mechanism, 0, noise, f"{c}.mean")}[what]()
        parts.append(F.struct(F.lit(column).alias("column"), F.lit(what).alias("statistic"), F.lit(None).cast("string").alias("bucket"), value.alias("value")))
    if parts:
        flat = df.agg(*one).select(F.inline(F.array(*parts)))
        out = flat if out is None else flat.unionByName(out)
    return out


def with_details(df: DataFrame, epsilon: float, delta: float, scale: float, mechanism: str = "laplace", confidence: float = 0.95) -> DataFrame:
    """The released value with its noise scale, the budget spent and a confidence interval."""
    half = -scale * math.log(1 - confidence) if mechanism == "laplace" else 1.959963984540054 * scale
    return df.select("*", F.lit(scale).alias("noise_scale"), F.lit(epsilon).alias("epsilon_spent"), F.lit(delta).alias("delta_spent"), (F.col("value") - half).alias("ci_lower"), (F.col("value") + half).alias("ci_upper"))
