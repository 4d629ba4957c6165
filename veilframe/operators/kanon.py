"""k-anonymity: generalisation hierarchies for records, Mondrian partitioning for tables.

Beyond k rows a class, a table can be held to l-diversity (``l`` different values of a sensitive column in every
class) and t-closeness (the distribution of that column in every class lies within ``t`` of that in the whole table).
Mondrian then admits a split only if both halves keep to them. Nulls are a sensitive value of their own.

The distance of distributions is the earth mover's. Between words every two are 1 apart, so it is half the sum of
differences. Numbers are ordered: i and j of m values are abs(i - j) / (m - 1) apart; where there are more than
``buckets`` values, value v stands at floor(buckets * share of rows below v) and m is ``buckets``. Nulls come first.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.plans.budget import PrivacyError
from veilframe.plans.storage import dropped, persisted


class Hierarchy(Protocol):
    max_level: int

    def generalize(self, value: Column, level: int) -> Column: ...


class AgeHierarchy:
    """Bands of 5, 10 and 20 years, then a star; what is no integer is a star from level 1 on."""

    max_level = 4

    def generalize(self, value: Column, level: int) -> Column:
        value = value.cast("string")
        if level <= 0:
            return value
        if level > 3:
            return F.when(value.isNotNull(), F.lit("*"))
        width = 5 * (1 << (level - 1))
        age = F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("int"))
        start = (age - age % width).cast("int")
        return F.when(value.isNull(), value).otherwise(F.coalesce(F.concat(F.lit("["), start.cast("string"), F.lit("-"), (start + width).cast("string"), F.lit("]")), F.lit("*")))


class ZipcodeHierarchy:
    """3, 2 and 1 leading characters, then a star; codes too short for a level stay."""

    max_level = 4

    def generalize(self, value: Column, level: int) -> Column:
        value = value.cast("string")
        if level <= 0:
            return value
        if level > 3:
            return F.when(value.isNotNull(), F.lit("*"))
        keep = 4 - level
        return F.when(F.length(value) >= keep, F.concat(F.substring(value, 1, keep), F.lit("*" * (6 - keep)))).otherwise(value)


class GenderHierarchy:
    max_level = 1

    def generalize(self, value: Column, level: int) -> Column:
        value = value.cast("string")
        return value if level <= 0 else F.when(value.isNotNull(), F.lit("*"))


def choose_level(k: int, hierarchy: Hierarchy) -> int:
    return max(1, min(k // 5, hierarchy.max_level))


def anonymize_record(df: DataFrame, quasi_identifiers: list[str], hierarchies: dict[str, Hierarchy] | None, k: int) -> DataFrame:
    """Each quasi-identifier that has a hierarchy, generalised; nulls and other columns stay."""
    found = {q: h for q in quasi_identifiers if (h := (hierarchies or {}).get(q))}
    return df.select(*(found[c].generalize(F.col(c), choose_level(k, found[c])).alias(c) if c in found else F.col(c) for c in df.columns))


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


LOCAL_ROWS, BUCKETS, SLACK = 50_000, 1000, 1e-9
_UNORDERED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


@dataclass
class Sensitive:
    """What classes must keep to. ``values``: (_s, _g, _code) of every sensitive value, its share of all rows and
    its place; ``whole``: the share of rows up to each place if the column is ordered, at most ``buckets`` numbers."""

    l: int
    t: float
    values: DataFrame
    whole: np.ndarray | None
    distinct: int


def _text(c: Column, numeric: bool) -> Column:
    """A sensitive value as a key that is never null."""
    value = (c.cast("double") + 0.0).cast("string") if numeric else F.concat(F.lit("="), c.cast("string"))
    return F.coalesce(value, F.lit("null")).alias("_s")


def sensitive_values(df: DataFrame, column: str, l: int = 1, t: float = 1.0, buckets: int = BUCKETS) -> Sensitive:  # noqa: E741
    """The distribution of a column over the whole table."""
    if l < 1 or not t >= 0 or buckets < 2:
        raise PrivacyError("l is at least 1, t at least 0, buckets at least 2")
    numeric = isinstance(df.schema[column].dataType, _NUMBERS)
    c = F.col(column)
    counts = df.groupBy(_text(c, numeric)).agg(F.count("*").alias("_c"), F.min(c.cast("double") if numeric else F.lit(0.0)).alias("_v"))
    counts = persisted(counts, "sensitive")
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("_c"), F.lit(0))).first()
    if not numeric:
        return Sensitive(l, t, counts.select("_s", (F.col("_c") / total).alias("_g"), F.lit(0).alias("_code")), None, distinct)
    if distinct <= buckets:
        placed = counts.withColumn("_code", F.row_number().over(Window.orderBy(F.asc_nulls_first("_v"))) - 1)  # a bounded table
    else:
        below = _running(counts.withColumn("_one", F.lit(1)), ["_one", "_v"], F.col("_c"))
        placed = below.withColumn("_code", F.floor(buckets * (F.col("_upto") - F.col("_c")) / total).cast("int"))
    placed = persisted(placed.select("_s", (F.col("_c") / total).alias("_g"), "_code"), "sensitive")
    whole = np.zeros(min(distinct, buckets))
    for r in placed.groupBy("_code").agg(F.sum("_g").alias("g")).collect():  # one row a place
        whole[r["_code"]] = r["g"]
    return Sensitive(l, t, placed, np.cumsum(whole), distinct)


def _measures(rows: DataFrame, by: list[str], whole: np.ndarray | None) -> DataFrame:
    """(by, _n, _l, _t): of each class of ``rows`` (by, _s, _g, _code) its size, its number of different sensitive
    values and its distance from the whole table. Only counts of values are gathered."""
    held = rows.groupBy(*by, "_s").agg(F.count("*").alias("_c"), F.min("_g").alias("_g"), F.min("_code").alias("_code"))
    if whole is None:
        sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
        return held.join(sizes, by).groupBy(*by).agg(F.first("_n").alias("_n"), F.count("*").alias("_l"), F.sum(F.greatest(F.lit(0.0), F.col("_c") / F.col("_n") - F.col("_g"))).alias("_t"))
    # At most one entry a place.
    placed = held.groupBy(*by, "_code").agg(F.sum("_c").alias("_c"), F.count("*").alias("_l"))
    one = placed.groupBy(*by).agg(F.sum("_c").alias("_n"), F.sum("_l").alias("_l"), F.map_from_entries(F.collect_list(F.struct("_code", "_c"))).alias("_m"))
    m = len(whole)
    if m < 2:
        return one.select(*by, "_n", "_l", F.lit(0.0).alias("_t"))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0.0).alias("moved"))
    places = F.arrays_zip(F.sequence(F.lit(0), F.lit(m - 2)).alias("i"), F.array(*map(F.lit, whole[: m - 1].tolist())).alias("g"))

    def step(a: Column, p: Column) -> Column:
        upto = a["upto"] + F.coalesce(F.try_element_at("_m", p["i"]), F.lit(0))
        return F.struct(upto.alias("upto"), (a["moved"] + F.abs(upto / F.col("_n") - p["g"])).alias("moved"))

    return one.select(*by, "_n", "_l", F.aggregate(places, start, step, lambda a: a["moved"] / (m - 1)).alias("_t"))


def closeness(df: DataFrame, classes: list[str], sensitive: str, buckets: int = BUCKETS) -> DataFrame:
    """(classes, size, distinct_values, distance) of each class: what l and t it keeps to."""
    s = sensitive_values(df, sensitive, buckets=buckets)
    numeric = isinstance(df.schema[sensitive].dataType, _NUMBERS)
    keys = [f"_k{i}" for i in range(len(classes))]
    # A missing class value is a class as any other; joins on it go by its text.
    rows = df.select(*(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias(k) for c, k in zip(classes, keys, strict=True)), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(classes)), _text(F.col(sensitive), numeric)).join(s.values, "_s")
    names = rows.groupBy(*keys).agg(*(F.first(f"_o{i}").alias(f"_o{i}") for i in range(len(classes))))
    found = _measures(rows, keys, s.whole).join(names, keys)
    return found.select(*(F.col(f"_o{i}").alias(c) for i, c in enumerate(classes)), F.col("_n").alias("size"), F.col("_l").alias("distinct_values"), F.col("_t").alias("distance"))


def mondrian_partitions(df: DataFrame, quasi_identifiers: list[str], k: int, max_depth: int = 10, order: str | None = None, local_rows: int = LOCAL_ROWS, rows: int | None = None, sensitive: str | None = None, rule: Sensitive | None = None, leaves: bool = False) -> DataFrame:
    """``df`` with ``_pid``, the partition each row falls in, written once. ``leaves``, for tables of ``local_rows`` at most,
    adds the range or the value set of the partition for each quasi-identifier, and nothing is written.

    Every level splits all partitions of 2k rows or more at their middle row, along the quasi-identifier of
    the widest span (first if several). Nulls sort before all values and take no part in spans; ``order``
    breaks ties, its nulls first, and a hash of the row those that are left. With a ``rule`` on the column
    ``sensitive`` the identifiers are tried from the widest span on, and the first whose halves both keep to it is taken;
    a partition for which there is none stays whole.

    While partitions are larger than ``local_rows`` a level is a few Spark jobs over (row, quasi-identifiers)
    alone: spans and sizes are one aggregation, the value that the middle row holds comes from running
    totals of value counts, laid out in ranges, only rows of that very value are ranked, and halves are judged by
    counts of their sensitive values. Smaller partitions finish their levels in one task each, by the same rules on
    arrays. The other columns are joined back at the end. ``rows`` is the number of rows of ``df`` if known.
    """
    if order and isinstance(df.schema[order].dataType, _UNORDERED):
        raise PrivacyError(f"rows can't be ordered by {order!r}")
    numeric = [isinstance(df.schema[q].dataType, _NUMBERS) for q in quasi_identifiers]
    keys = [F.col(q).cast("double" if n else "string").alias(f"_q{i}") for i, (q, n) in enumerate(zip(quasi_identifiers, numeric, strict=True))]
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    row_hash = F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")
    keys += [(F.col(order) if order else row_hash).alias("_pos"), row_hash.alias("_hash")]
    told = ["_s", "_g", "_code"] if rule else []
    if rule:
        keys.append(_text(F.col(sensitive), isinstance(df.schema[sensitive].dataType, _NUMBERS)))
    known = lambda x: x.join(rule.values, "_s") if rule else x
    limits = rule and (rule.l, rule.t, rule.whole)
    if (df.count() if rows is None else rows) <= local_rows:
        # ``_own`` stands for the columns of ``df``, whatever their names.
        own = known(df.select(F.struct(*df.columns).alias("_own"), F.lit(1).cast("long").alias("_pid"), *keys))
        more = [T.StructField(c, T.DoubleType() if n else T.StringType()) for i, n in enumerate(numeric) for c in ((f"_lo{i}", f"_hi{i}") if n else (f"_text{i}",))]
        kind = T.StructType([*own.select("_own", "_pid").schema, *(more if leaves else [])])
        placed = own.groupBy("_pid").applyInArrow(_local_levels("_own", numeric, k, max_depth, limits, leaves), kind)
        return placed.select("_own.*", *(c for c in placed.columns if c != "_own")) if leaves else persisted(placed.select("_own.*", "_pid"), "mondrian")
    source = persisted(df.select(F.struct(*df.columns).alias("_own"), F.monotonically_increasing_id().alias("_id"), *keys), "rows")
    columns = ["_id", "_pos", "_hash", *(f"_q{i}" for i in range(len(numeric))), *told]
    current = persisted(known(source).select(*columns, F.lit(1).cast("long").alias("_pid"), F.lit(False).alias("_whole")), "mondrian")
    for level in range(max_depth):
        stats = persisted(_choices(current.filter("NOT _whole"), numeric, k), "spans")
        largest = stats.agg(F.max("_n")).first()[0]
        if largest is None:
            dropped(stats)
            break
        if largest <= local_rows:
            here = current.filter("NOT _whole").groupBy("_pid").applyInArrow(_local_levels("_id", numeric, k, max_depth - level, limits), "_id long, _pid long")
            done, current = current, persisted(here.unionByName(current.filter("_whole").select("_id", "_pid")), "placed")
            dropped(done, stats)
            break
        if rule:
            current = _admitted_halves(current, stats, numeric, rule)
        else:
            scratch: list[DataFrame] = []
            halved = _halved(current.join(stats.select("_pid", "_n", F.get("_dims", F.lit(0)).alias("_dim")), "_pid", "left"), numeric, scratch)
            done, current = current, persisted(halved.select(*current.columns), "mondrian")
            dropped(done, *scratch)
        dropped(stats)
    out = persisted(source.select("_id", "_own").join(current.select("_id", "_pid"), "_id").select("_own.*", "_pid"), "partitions")
    dropped(source, current)
    return out


def _admitted_halves(current: DataFrame, stats: DataFrame, numeric: list[bool], rule: Sensitive) -> DataFrame:
    """``current`` after one level: each partition of ``stats`` is halved along the first of its dimensions whose halves
    both keep to the rule, or marked ``_whole``."""
    pending = stats
    for i in range(len(numeric)):
        scratch: list[DataFrame] = []
        chosen = pending.select("_pid", "_n", F.get("_dims", F.lit(i)).alias("_dim"))
        trial = persisted(_halved(current.join(chosen, "_pid"), numeric, scratch).select("_id", F.col("_pid").alias("_half"), "_s", "_g", "_code"), "trial")
        fits = (F.col("_l") >= rule.l) & (F.col("_t") <= rule.t + SLACK)
        kept = _measures(trial, ["_half"], rule.whole).groupBy(F.floor(F.col("_half") / 2).alias("_pid")).agg(F.count_if(fits).alias("fit")).filter("fit = 2").select("_pid")
        kept = persisted(kept, "kept")
        moved = trial.withColumn("_pid", F.floor(F.col("_half") / 2)).join(kept, "_pid", "left_semi").select("_id", "_half")
        before, current = current, persisted(current.join(moved, "_id", "left").withColumn("_pid", F.coalesce("_half", "_pid")).select(*current.columns), "mondrian")
        earlier, pending = pending, persisted(pending.join(kept, "_pid", "left_anti"), "pending")
        dropped(before, trial, kept, *scratch, *([earlier] if earlier is not stats else []))
        if pending.isEmpty():
            dropped(pending)
            return current
    refused = pending.select("_pid", F.lit(True).alias("_refused"))
    before, current = current, persisted(current.join(refused, "_pid", "left").withColumn("_whole", F.col("_whole") | F.coalesce("_refused", F.lit(False))).select(*current.columns), "mondrian")
    dropped(before, pending)
    return current


def _choices(current: DataFrame, numeric: list[bool], k: int) -> DataFrame:
    """(_pid, _n, _dims): the size of every partition of 2k rows or more and its dimensions by falling span."""
    spans = [
        F.coalesce(F.max(f"_q{i}") - F.min(f"_q{i}"), F.lit(0.0)) if n else F.greatest(F.count_distinct(f"_q{i}") - 1, F.lit(0)).cast("double")
        for i, n in enumerate(numeric)
    ]
    stats = current.groupBy("_pid").agg(F.count("*").alias("_n"), *(s.alias(f"_s{i}") for i, s in enumerate(spans))).filter(F.col("_n") >= 2 * k)
    falling = [F.struct(F.when(F.isnan(f"_s{i}"), float("-inf")).otherwise(-F.col(f"_s{i}")).alias("span"), F.lit(i).alias("dim")) for i in range(len(numeric))]
    return stats.select("_pid", "_n", F.transform(F.array_sort(F.array(*falling)), lambda x: x["dim"]).alias("_dims"))


def _halved(joined: DataFrame, numeric: list[bool], scratch: list[DataFrame]) -> DataFrame:
    """Rows with their (_n, _dim) moved to partition 2p or 2p + 1. ``scratch`` gets the tables to drop afterwards."""
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    for i, n in enumerate(numeric):
        if n:
            number = F.when(F.col("_dim") == i, F.coalesce(f"_q{i}", F.lit(float("-inf")))).otherwise(number)
        else:
            text = F.when(F.col("_dim") == i, F.coalesce(f"_q{i}", F.lit(""))).otherwise(text)
    valued = joined.withColumn("_v", F.struct(number.alias("number"), text.alias("text")))
    counts = valued.filter("_n IS NOT NULL").groupBy("_pid", "_n", "_v").agg(F.count("*").alias("_c"))
    upto = _running(counts, ["_pid", "_v"], F.col("_c"), scratch)
    half = F.floor(F.col("_n") / 2)
    split = persisted(upto.filter((F.col("_upto") > half) & (F.col("_upto") - F.col("_c") <= half)).select("_pid", F.col("_v").alias("_split"), (half - F.col("_upto") + F.col("_c")).alias("_take")), "splits")
    sided = valued.join(split, "_pid", "left")
    # Of the rows that hold the middle value, the first ``_take`` stay on the left.
    tied = persisted(sided.filter((F.col("_v") == F.col("_split")) & (F.col("_take") > 0)).select("_id", "_pid", "_pos", "_hash", "_take"), "ties")
    left = _running(tied, ["_pid", "_pos", "_hash", "_id"], F.lit(1), scratch).filter(F.col("_upto") <= F.col("_take")).select("_id", F.lit(True).alias("_left"))
    scratch += [split, tied]
    right = (F.col("_v") > F.col("_split")) | (F.col("_v") == F.col("_split")) & F.col("_left").isNull()
    return sided.join(left, "_id", "left").withColumn("_pid", F.when(F.col("_split").isNull(), F.col("_pid")).otherwise(2 * F.col("_pid") + right.cast("long")))


def _running(df: DataFrame, by: list[str], weight: Column, scratch: list[DataFrame] | None = None) -> DataFrame:
    """``df`` with ``_upto``, the total of ``weight`` up to each row within its first column of ``by``.

    Rows are laid out in ranges; a row's total is that within its range plus that of earlier ranges. ``scratch`` gets
    the table that the result reads.
    """
    laid = df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    laid = persisted(laid.withColumn("_local", F.sum(weight).over(Window.partitionBy("_range", by[0]).orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, 0))), "ranges")
    if scratch is not None:
        scratch.append(laid)
    sizes = laid.groupBy(by[0], "_range").agg(F.max("_local").alias("_all"))
    before = sizes.select(by[0], "_range", (F.sum("_all").over(Window.partitionBy(by[0]).orderBy("_range")) - F.col("_all")).alias("_before"))
    return laid.join(before, [by[0], "_range"]).withColumn("_upto", F.col("_before") + F.col("_local")).drop("_range", "_local", "_before")


def _ranks(c: pa.ChunkedArray) -> np.ndarray:
    """Dense ranks in Spark's order: nulls first, then values, NaN last."""
    if pa.types.is_floating(c.type):
        v, there = c.to_numpy(), np.asarray(c.is_valid())
        kind = np.where(there, np.where(np.isnan(v), 2, 1), 0)
        plain = np.unique(np.where(kind == 1, v, 0.0), return_inverse=True)[1]
        return kind.astype(np.int64) * len(v) + plain
    if pa.types.is_boolean(c.type):
        c = c.cast(pa.int8())
    return np.asarray(pc.rank(c, "ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)


def _local_levels(keep: str, numeric: list[bool], k: int, depth: int, limits: tuple[int, float, np.ndarray | None] | None = None, leaves: bool = False):
    """The levels from here on for one partition: the same splits, on arrays. Gives (keep, _pid). ``limits``: l,
    t and the shares up to each place of the whole table. ``leaves``: also what the rows of a partition have in common."""

    def keeps(s: np.ndarray, g: np.ndarray, code: np.ndarray) -> bool:
        """Whether rows with these sensitive values, their shares and places keep to the limits."""
        l, t, whole = limits  # noqa: E741
        found, first, counts = np.unique(s, return_index=True, return_counts=True)
        if len(found) < l:
            return False
        if whole is None:
            return np.maximum(0.0, counts / len(s) - g[first]).sum() <= t + SLACK
        if len(whole) < 2:
            return True
        upto = np.cumsum(np.bincount(code, minlength=len(whole))) / len(s)
        return np.abs(upto - whole)[:-1].sum() / (len(whole) - 1) <= t + SLACK

    def run(part: pa.Table) -> pa.Table:
        keys, values, present = [], [], []
        for i, n in enumerate(numeric):
            c = part.column(f"_q{i}")
            present.append(np.asarray(c.is_valid()))
            values.append(c.fill_null(-np.inf).to_numpy() if n else _ranks(c.fill_null("")))
            keys.append(values[-1])
        place, spare = _ranks(part.column("_pos")), part.column("_hash").to_numpy()
        if limits:
            s, g, code = np.unique(np.asarray(part.column("_s").to_pylist(), object), return_inverse=True)[1], part.column("_g").to_numpy(), part.column("_code").to_numpy()
        pid = np.full(len(part), part.column("_pid")[0].as_py(), np.int64)
        todo = [(np.arange(len(part)), int(pid[0]), depth)]
        while todo:
            rows, own, left = todo.pop()
            if len(rows) < 2 * k or left <= 0:
                pid[rows] = own
                continue
            spans = []
            for n, v, there in zip(numeric, values, present, strict=True):
                v = v[rows][there[rows]]
                spans.append(0.0 if not len(v) else float(v.max() - v.min()) if n else float(len(np.unique(v)) - 1))
            half = len(rows) // 2
            for dim in np.argsort(-np.nan_to_num(spans, nan=np.inf, posinf=np.inf), kind="stable")[: None if limits else 1]:
                laid = rows[np.lexsort((spare[rows], place[rows], keys[dim][rows]))]
                if not limits or all(keeps(s[x], g[x], code[x]) for x in (laid[:half], laid[half:])):
                    todo += [(laid[:half], 2 * own, left - 1), (laid[half:], 2 * own + 1, left - 1)]
                    break
            else:
                pid[rows] = own
        out = {keep: part.column(keep), "_pid": pa.array(pid)}
        if leaves:
            own = np.unique(pid, return_inverse=True)[1]
            groups = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own))[:-1])
            for i, (n, v, there) in enumerate(zip(numeric, values, present, strict=True)):
                if n:
                    ends = [_ends(v[g][there[g]]) for g in groups]
                    out |= {name: pa.array([ends[x][side] for x in own], pa.float64()) for side, name in enumerate((f"_lo{i}", f"_hi{i}"))}
                else:
                    texts = np.asarray(part.column(f"_q{i}").to_pylist(), object)
                    said = [_set_text({x for x in texts[g] if x is not None}) for g in groups]
                    out[f"_text{i}"] = pa.array([said[x] for x in own], pa.string())
        return pa.table(out)

    return run


def _ends(v: np.ndarray) -> tuple[float | None, float | None]:
    """Smallest and largest value, NaN above all; None of none."""
    if not len(v):
        return None, None
    odd = np.isnan(v)
    return float(v.min()) if not odd.any() else float("nan") if odd.all() else float(v[~odd].min()), float("nan") if odd.any() else float(v.max())


def _set_text(found: set[str]) -> str | None:
    return None if not found else found.pop() if len(found) == 1 else "{" + ",".join(sorted(found)) + "}"


def k_anonymize_table(df: DataFrame, quasi_identifiers: list[str], k: int = 5, max_depth: int = 10, order: str | None = None, keep_partition: bool = False, sensitive: str | None = None, l: int = 1, t: float = 1.0, buckets: int = BUCKETS) -> DataFrame:  # noqa: E741
    """The table with its quasi-identifiers generalised, as strings, over Mondrian partitions of at
    least k rows. Other columns and the number of rows stay. With a ``sensitive`` column every class has ``l`` different
    values of it and lies within ``t`` of the whole table; a table with fewer than ``l`` is refused."""
    if not quasi_identifiers:
        raise PrivacyError("no quasi-identifiers")
    if missing := [q for q in [*quasi_identifiers, *([sensitive] if sensitive else [])] if q not in df.columns]:
        raise PrivacyError(f"no such columns: {missing}")
    n = df.count()
    if n and n < k:
        raise PrivacyError(f"{n} rows are fewer than k = {k}")
    rule = sensitive_values(df, sensitive, l, t, buckets) if sensitive else None
    if rule and n and rule.distinct < l:
        raise PrivacyError(f"{rule.distinct} sensitive values are fewer than l = {l}")
    numeric = {q: isinstance(df.schema[q].dataType, _NUMBERS) for q in quasi_identifiers}
    if n <= LOCAL_ROWS:
        joined = mondrian_partitions(df, quasi_identifiers, k, max_depth, order, rows=n, sensitive=sensitive, rule=rule, leaves=True)
    else:
        # Ranges and value sets of a leaf are one aggregation, joined back by partition.
        parts = mondrian_partitions(df, quasi_identifiers, k, max_depth, order, rows=n, sensitive=sensitive, rule=rule)
        aggs = []
        for i, q in enumerate(quasi_identifiers):
            if numeric[q]:
                aggs += [F.min(F.col(q).cast("double")).alias(f"_lo{i}"), F.max(F.col(q).cast("double")).alias(f"_hi{i}")]
            else:
                found = F.array_sort(F.collect_set(F.col(q).cast("string")))
                text = F.when(F.size(found) == 1, F.element_at(found, 1)).when(F.size(found) > 1, F.concat(F.lit("{"), F.array_join(found, ","), F.lit("}")))
                aggs.append(text.alias(f"_text{i}"))
        joined = parts.join(parts.groupBy("_pid").agg(*aggs), "_pid")
    out = {}
    for i, q in enumerate(quasi_identifiers):
        c = F.col(q).cast("string")
        if numeric[q]:
            lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            whole = (lo == F.floor(lo)) & (hi == F.floor(hi))
            lo_text, hi_text = (F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string")) for v in (lo, hi))
            out[q] = F.when(lo.isNull(), c).when(lo == hi, lo.cast("string")).otherwise(F.concat(F.lit("["), lo_text, F.lit("-"), hi_text, F.lit("]")))
        else:
            out[q] = F.coalesce(f"_text{i}", c)
    cols = [out[c].alias(c) if c in out else F.col(c) for c in df.columns]
    return joined.select(*cols, *(["_pid"] if keep_partition else []))


def k_anonymize_strings(df: DataFrame, quasi_identifiers: list[str], k: int = 5, max_depth: int = 10, order: str | None = None) -> DataFrame:
    """The entry point for records of strings: every quasi-identifier is categorical."""
    cast = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in quasi_identifiers else F.col(c) for c in df.columns))
    return k_anonymize_table(cast, quasi_identifiers, k, max_depth, order)


def diversity(df: DataFrame, quasi_identifiers: list[str], sensitive: str) -> DataFrame:
    """(class columns, size, distinct sensitive values) of each equivalence class."""
    return df.groupBy(*quasi_identifiers).agg(F.count("*").alias("size"), F.count_distinct(sensitive).alias("distinct_values"))
