import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions.noise import HashNoise
from veilframe.operators import dp, kanon, ldp, obfuscate
from veilframe.plans.budget import BudgetAccountant, BudgetExhausted, PrivacyError


@pytest.fixture
def numbers(spark):
    return spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(None,)], "v double")


def value(df):
    return df.first()["value"]


def test_large_epsilon_is_exact(spark, numbers):
    assert value(dp.count(numbers, "v", 1e9)) == pytest.approx(5, abs=1e-3)
    assert value(dp.sum(numbers, "v", 1e9, lower=0, upper=10)) == pytest.approx(15, abs=1e-3)
    assert value(dp.sum(numbers, "v", 1e9)) == pytest.approx(15, abs=1e-3)
    assert value(dp.mean(numbers, "v", 1e9, lower=0, upper=10)) == pytest.approx(2.5, abs=1e-3)
    assert value(dp.mean(numbers.limit(0), "v", 1.0, lower=0, upper=1)) == 0
    c = spark.createDataFrame([([1.0, 2.0],), ([3.0, None],), (None,)], "c array<double>")
    assert value(dp.chunked_count(c, "c", 1e9)) == pytest.approx(4, abs=1e-3)
    assert value(dp.chunked_sum(c, "c", 1e9, 0, "laplace", 0, 10)) == pytest.approx(6, abs=1e-3)
    assert value(dp.chunked_mean(c, "c", 1e9, min_count=5)) == 0


def test_validation(numbers):
    for bad in (dict(epsilon=0), dict(epsilon=1, mechanism="geometric"), dict(epsilon=1, mechanism="gaussian")):
        with pytest.raises(PrivacyError):
            dp.count(numbers, "v", **bad)
    for bad in (dict(lower=1), dict(lower=2, upper=1), dict(mechanism="gaussian", delta=1e-5)):
        with pytest.raises(PrivacyError):
            dp.sum(numbers, "v", 1.0, **bad)
    with pytest.raises(PrivacyError):
        dp.group_by(numbers, "v", "v", "sum", 1.0, mechanism="other", semantics="intended")


def test_histograms(spark):
    d = spark.createDataFrame([(x,) for x in "eng hr eng sales eng other".split()] + [(None,)], "d string")
    got = {r["bucket"]: round(r["value"]) for r in dp.histogram(d, "d", ["eng", "hr", "marketing"], 1e9).collect()}
    assert got == {"eng": 3, "hr": 1, "marketing": 0}
    c = spark.createDataFrame([(["eng", "x"],)], "c array<string>")
    assert {r["bucket"]: round(r["value"]) for r in dp.chunked_histogram(c, "c", ["eng", "hr"], 1e9).collect()} == {"eng": 1, "hr": 0, "x": 1}


def test_vectors(spark):
    v = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],), ([5.0, 6.0],), (None,)], "v array<double>")
    assert [round(r["value"], 2) for r in dp.vector_sum(v, "v", 10.0, 1e9).orderBy("pos").collect()] == [9, 12]
    assert [round(r["value"], 2) for r in dp.vector_mean(v, "v", 10.0, 1e9, min_count=2).orderBy("pos").collect()] == [3, 4]
    assert [r["value"] for r in dp.vector_mean(v, "v", 10.0, 1e9, min_count=50).collect()] == [0, 0]
    assert dp.vector_sum(v.limit(0), "v", 1.0, 1.0).count() == 0
    clipped = dp.vector_sum(spark.createDataFrame([([3.0, 4.0],)], "v array<double>"), "v", 1.0, 1e9).orderBy("pos").collect()
    assert [round(r["value"], 3) for r in clipped] == [0.6, 0.8]


def test_adaptive_clip(spark):
    """The one-pass grid answers as the plain binary search does."""
    values = [1.0, 5.0, 10.0, 15.0, 20.0, 7.5, 2.5, 3.75]
    low, high = 0.0, 10.0
    for i in range(15):
        mid = (low + high) / 2
        share = sum(v > mid for v in values) / len(values) + dp._driver_laplace(HashNoise("s"), 15 / (len(values) * 5.0), f"clip{i}")
        low, high = (mid, high) if share > 0.05 else (low, mid)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert dp.adaptive_clip(df, "v", 5.0, noise=HashNoise("s")) == (1.0, pytest.approx(high))
    assert dp.adaptive_clip(df.limit(0), "v", 1.0) == (0.0, 10.0)
    low, high = 0.0, 1000.0
    for i in range(30):  # several aggregations, each over the interval that the one before left
        mid = (low + high) / 2
        share = sum(v > mid for v in values) / len(values) + dp._driver_laplace(HashNoise("t"), 30 / (len(values) * 1e6), f"clip{i}")
        low, high = (mid, high) if share > 0.4 else (low, mid)
    assert dp.adaptive_clip(df, "v", 1e6, 0.6, 30, 1000.0, HashNoise("t")) == (1.0, pytest.approx(high, abs=1e-9))


def test_secure_noise_scale(spark):
    n = 4000
    draws = [r["x"] for r in spark.range(n).select(dp.SECURE.laplace(2.0, F.lit("k")).alias("x")).collect()]
    assert abs(sum(draws) / n) < 0.3
    assert sum(map(abs, draws)) / n == pytest.approx(2.0, rel=0.15)
    g = [r["x"] for r in spark.range(n).select(dp.SECURE.gaussian(3.0, F.lit("k")).alias("x")).collect()]
    assert math.sqrt(sum(x * x for x in g) / n) == pytest.approx(3.0, rel=0.1)


def test_ledger_and_release(spark, numbers):
    BudgetAccountant.reset("t")
    a = BudgetAccountant.instance("t", 1.0, 1e-4)
    assert BudgetAccountant.instance("t", 1.0, 1e-4) is a
    with pytest.raises(PrivacyError):
        BudgetAccountant.instance("t", 2.0, 1e-4)
    with pytest.raises(PrivacyError):
        BudgetAccountant.instance(" ")
    got = dp.release(lambda: dp.count(numbers, "v", 0.6), a, 0.6)
    assert got.first() == got.first()  # drawn once
    with pytest.raises(BudgetExhausted):
        dp.release(lambda: dp.count(numbers, "v", 0.6), a, 0.6)
    assert a.remaining()["epsilon"] == pytest.approx(0.4)
    with pytest.raises(PrivacyError):
        dp.release(lambda: dp.count(numbers, "v", -1.0), a, 0.1)
    assert a.remaining()["epsilon"] == pytest.approx(0.4)


def test_groupby_threshold(spark):
    rows = [("a", 1.0)] * 50 + [(None, 1.0)] * 50 + [("rare", 1.0)]
    got = dp.group_by(spark.createDataFrame(rows, "g string, v double"), "g", "v", "sum", 2.0, lower=0, upper=1, noise=HashNoise("a"))
    assert {"a", "null"} <= {r["group"] for r in got.collect()}
    text = dp.group_by(spark.createDataFrame([("a", "5")] * 40, "g string, v string"), "g", "v", "sum", 1e9)
    assert value(text) == pytest.approx(0, abs=1e-3)


def test_ldp(spark):
    r = spark.createDataFrame([(x,) for x in (0, 1, 1, 0, 1)], "v int")
    assert ldp.estimate_binary(r, "v", 1.0).first()[0] == pytest.approx(0.716395, abs=1e-5)
    assert ldp.estimate_binary(r, "v", 0.0).first()[0] == 0.5
    assert ldp.estimate_binary(r.limit(0), "v", 1.0).first()[0] == 0
    c = spark.createDataFrame([(x,) for x in ["eng", "hr", "eng", "sales", "odd"]], "v string")
    got = ldp.estimate_histogram(c, "v", ["eng", "hr", "sales"], 1.0).collect()
    assert sum(x["frequency"] for x in got) == pytest.approx(1)
    assert ldp.estimate_histogram(c, "v", ["eng"], 1.0).collect()[0]["frequency"] == 1
    out = c.select(ldp.perturb_categorical(F.col("v"), ["eng", "hr", "sales"], 0.1, F.col("v")).alias("p")).collect()
    assert {r["p"] for r in out} <= {"eng", "hr", "sales", "odd"}


def mondrian(rows, qi, k, depth):
    """The recursive definition, on plain rows."""

    def span(part, q):
        v = [r[q] for r in part if r[q] is not None]
        if not v:
            return 0
        return max(v) - min(v) if isinstance(v[0], int | float) else len(set(v)) - 1

    def key(r, q):
        v = r[q]
        return v if isinstance(v, str) else float("-inf") if v is None and q != "s" else "" if v is None else v

    def split(part, depth):
        if len(part) < 2 * k or depth <= 0:
            return [part]
        best = max(qi, key=lambda q: span(part, q))
        part = sorted(part, key=lambda r: (key(r, best), r["id"]))
        return split(part[: len(part) // 2], depth - 1) + split(part[len(part) // 2 :], depth - 1)

    return {frozenset(r["id"] for r in p) for p in split(rows, depth)}


@pytest.mark.parametrize(("n", "local"), [(11, 0), (97, 0), (97, 40), (300, 50_000)])
def test_mondrian_is_the_recursion(spark, n, local):
    rng = random.Random(n)
    rows = [{"id": i, "a": rng.choice([None, *range(50)]), "b": rng.random() * 10, "s": rng.choice(["x", "y", "z", None])} for i in range(n)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, a int, b double, s string")
    parts = kanon.mondrian_partitions(df, ["a", "b", "s"], 3, 6, "id", local).groupBy("_pid").agg(F.collect_list("id").alias("ids")).collect()
    assert {frozenset(p["ids"]) for p in parts} == mondrian(rows, ["a", "b", "s"], 3, 6)
    out = kanon.k_anonymize_table(df, ["a", "b", "s"], 3, 6, order="id", keep_partition=True)
    assert out.count() == n
    assert out.groupBy("_pid").count().agg(F.min("count")).first()[0] >= 3


@pytest.mark.parametrize(("qi", "order"), [(["number", "text", "real"], "place"), (["day", "flag"], "text")])
def test_mondrian_is_the_same_at_every_size(spark, qi, order):
    """In one task or level by level: nulls, NaN, ties, dates and booleans."""
    rng = random.Random(3)
    some = lambda v: None if rng.random() < 0.2 else v
    rows = [(i, some(rng.randrange(4)), some(rng.choice("ab")), some(rng.choice([0.5, float("nan"), -1.0])), some(datetime.date(2024, 1, rng.randrange(1, 5))), some(rng.random() < 0.5), None if i == 7 else -i) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, number int, text string, real double, day date, flag boolean, place int").repartition(3)
    key = F.collect_set("id") if order == "place" else F.count("*")
    found = [sorted((r["_pid"], str(sorted(r["n"]) if order == "place" else r["n"])) for r in kanon.mondrian_partitions(df, qi, 4, 3, order, n).groupBy("_pid").agg(key.alias("n")).collect()) for n in (10, 10**6)]
    assert found[0] == found[1] and len(found[0]) == 8
    with pytest.raises(PrivacyError):
        kanon.mondrian_partitions(df.withColumn("a", F.array("id")), ["number"], 4, order="a")


def test_leaves_are_the_same_at_every_size(spark, monkeypatch):
    """Ranges and value sets made in the task and by aggregation: nulls, NaN, constants, every kind of value."""
    rng = random.Random(6)
    some = lambda v: None if rng.random() < 0.3 else v
    rows = [(i, some(rng.randrange(90)), some(rng.choice(["a", "b", "é", "日", ""])), some(rng.choice([0.5, float("nan"), -1.0, 7.0, 1e12])), some(datetime.date(2024, 1, rng.randrange(1, 5))), None, "clash") for i in range(80)]
    df = spark.createDataFrame(rows, "id int, number int, text string, real double, day date, nothing int, _text0 string").repartition(3).drop("_text0")
    found = []
    for local in (10**6, 10):
        monkeypatch.setattr(kanon, "LOCAL_ROWS", local)
        for qi in (["number", "text", "real"], ["day", "nothing"], ["text"]):
            found.append(sorted(map(str, kanon.k_anonymize_table(df, qi, 4, 3, order="id", keep_partition=True).collect())))
    assert found[:3] == found[3:]


def test_mondrian_order_of_every_type(spark):
    """The order column itself may be null, NaN, a date or a boolean."""
    rng = random.Random(4)
    for kind, values in (("int", [None, 1, 2, 3]), ("double", [None, float("nan"), 1.5, -2.0]), ("boolean", [None, True, False]), ("string", [None, "", "é", "z"]), ("date", [None, datetime.date(2024, 1, 1), datetime.date(2023, 1, 1)])):
        df = spark.createDataFrame([(i, rng.choice("xy"), v) for i, v in enumerate(values * 10)], f"id int, q string, o {kind}")
        found = []
        for local in (10, 10**6):
            got = kanon.mondrian_partitions(df, ["q"], 10, 1, "o", local)
            found.append(sorted(map(str, ((r["_pid"], r["q"], r["o"], r["n"]) for r in got.groupBy("_pid", "q", "o").agg(F.count("*").alias("n")).collect()))))
        assert found[0] == found[1]


def test_kanon_edges(spark):
    rows = [("30", "100000", "F"), ("31", "100001", "F"), ("32", "100002", "M"), ("33", "100003", "M")]
    df = spark.createDataFrame(rows, "age string, zip string, gender string")
    got = {tuple(r) for r in kanon.k_anonymize_strings(df, ["age", "zip", "gender"], 2, 10, order="age").collect()}
    assert got == {("{30,31}", "{100000,100001}", "F"), ("{32,33}", "{100002,100003}", "M")}
    with pytest.raises(PrivacyError):
        kanon.k_anonymize_table(df, ["age"], 5)
    with pytest.raises(PrivacyError):
        kanon.k_anonymize_table(df, [])
    with pytest.raises(PrivacyError):
        kanon.k_anonymize_table(df, ["nope"])
    assert kanon.k_anonymize_table(df.limit(0), ["age"], 5).count() == 0
    h = {"age": kanon.AgeHierarchy(), "zip": kanon.ZipcodeHierarchy(), "gender": kanon.GenderHierarchy()}
    assert tuple(kanon.anonymize_record(df.limit(1), ["age", "zip", "gender"], h, 2).first()) == ("[30-35]", "100***", "*")
    assert tuple(kanon.anonymize_record(df.limit(1), ["age"], None, 2).first()) == rows[0]
    constant = kanon.k_anonymize_table(spark.createDataFrame([(30, "a")] * 4, "age int, s string"), ["age", "s"], 2, 1)
    assert {tuple(r) for r in constant.collect()} == {("30.0", "a")}


def test_obfuscation(spark):
    q = spark.createDataFrame([("我想了解高血压的治疗",), ("no term here",)], "q string")
    for seed in ("s", None):
        for r in q.select("q", obfuscate.obfuscate("q", 3, "Medical", seed=seed).alias("o")).collect():
            assert len(r["o"]["queries"]) == 4 and r["o"]["queries"][r["o"]["real_index"]] == r["q"] and r["o"]["domain"] == "medical"
            assert r["o"]["strategy"] == ("slot_filling" if "高血压" in r["q"] else "length_similarity")
            assert len(set(r["o"]["queries"])) == 4
    many = q.select(obfuscate.obfuscate("q", 15, seed="s").alias("o")).collect()
    assert [r["o"]["strategy"] for r in many] == ["length_similarity"] * 2
    few = q.select("q", obfuscate.obfuscate("q", 5, "general", generic_pool=["only one"], seed="s").alias("o")).first()
    assert sorted(few["o"]["queries"]) == sorted(["only one"] * 5 + [few["q"]])
    assert q.select(obfuscate.obfuscate("q", 0, seed="s").alias("o")).first()["o"]["queries"] == ["我想了解高血压的治疗"]
    with pytest.raises(PrivacyError):
        obfuscate.obfuscate("q", -1)


# -- draws of the secure source: what a statistic mentions often is drawn once ---------------------------


@pytest.mark.parametrize("true", ["a", "c", "e"])
def test_categorical_reports_keep_their_promise(spark, true):
    """The true value with e / (e + 4), every other with 1 / (e + 4), whatever its place."""
    n = 40_000
    reports = spark.range(n).select(ldp.perturb_categorical(F.lit(true), list("abcde"), 1.0, F.col("id").cast("string")).alias("r"))
    got = {r["r"]: r["count"] for r in reports.groupBy("r").count().collect()}
    for c in "abcde":
        p = (math.e if c == true else 1) / (math.e + 4)
        assert abs(got[c] - n * p) < 4 * math.sqrt(n * p * (1 - p)), (true, got)
    unknown = spark.range(n).select(ldp.perturb_categorical(F.lit("x"), list("abcde"), 1.0, F.col("id").cast("string")).alias("r")).groupBy("r").count().collect()
    q = 4 / 5 / (math.e + 4)
    assert all(abs(r["count"] - n * q) < 4 * math.sqrt(n * q * (1 - q)) for r in unknown if r["r"] != "x")


def test_noisy_means_divide_by_the_count_they_test(spark):
    """Few rows and much noise: the drawn count is often 0, where the mean is 0 and never fails."""
    n = 10_000
    drawn = spark.range(n).select(dp.noisy_mean(F.lit(12.0), F.lit(3), 1e-9, 0.5, min_count=2, key="m").alias("m"))
    got = drawn.agg(F.count("m").alias("n"), F.sum((F.col("m") == 0).cast("int")).alias("zero"), F.min("m").alias("lo"), F.max("m").alias("hi")).first()
    # The sum is next to exact: a mean is 12 / count with a count of 2 at least, or 0.
    assert got["n"] == n and 0 < got["zero"] < n and got["lo"] >= 0 and got["hi"] <= 6.001
    few = spark.createDataFrame([(float(i),) for i in range(6)], "v double")
    for _ in range(15):
        assert math.isfinite(value(dp.mean(few, "v", 0.05, lower=0, upper=5)))
        assert all(math.isfinite(r["value"]) for r in dp.aggregate(few, {"v": ("mean", {"clip_lower": 0, "clip_upper": 5})}, 0.05).collect())


def test_coordinates_share_one_drawn_count(spark):
    """Sums next to exact and counts of much noise: all coordinates of a release give the same count."""
    v = spark.createDataFrame([([1.0] * 40,)] * 60, "v array<double>")
    counts = set()
    for _ in range(6):
        got = [r["value"] for r in dp.vector_mean(v, "v", 100.0, 0.4, 1e-5, min_count=0, noise=_CountNoise()).collect()]
        assert len(got) == 40 and len({round(x, 9) for x in got}) == 1
        counts.add(round(got[0], 9))
    assert len(counts) > 1


class _CountNoise(type(dp.SECURE)):
    """Draws for the count only."""

    def gaussian(self, sigma, key):
        return F.when(key == "vector.count", super().gaussian(sigma, key)).otherwise(0.0)


def test_vectors_of_many_dimensions(spark):
    """The plan does not grow with the dimension; lengths differ, norms are clipped, nulls count as zero."""
    rng = random.Random(1)
    rows = [[rng.uniform(-1, 1) for _ in range(3000 - 7 * (i % 3))] for i in range(60)] + [[], [None, 3.0], None]
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>").repartition(5)
    want = [0.0] * 3000
    for r in filter(None, rows):
        norm = math.sqrt(sum(x * x for x in r if x is not None))
        for i, x in enumerate(r):
            want[i] += (x or 0.0) * min(1.0, 2.0 / norm)
    summed = dp.vector_sum(df, "v", 2.0, 1e12)
    got = {r["pos"]: r["value"] for r in summed.collect()}
    assert sorted(got) == list(range(3000)) and all(abs(got[i] - want[i]) < 1e-6 for i in range(3000))
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert size(summed) < size(dp.vector_sum(df.select(F.slice("v", 1, 2).alias("v")), "v", 2.0, 1e12)) + 200
    with pytest.raises(PrivacyError):
        dp.adaptive_clip(df.select(F.get("v", F.lit(0)).alias("x")), "x", 1.0, iterations=63)


# -- l-diversity and t-closeness -------------------------------------------------------------------------


def distance(part, rows, column, buckets):
    """The earth mover's distance of two lists of values, from its definition."""
    if isinstance(next((r[column] for r in rows if r[column] is not None), ""), str):
        share = lambda x, v: sum(r[column] == v for r in x) / len(x)
        return sum(abs(share(part, v) - share(rows, v)) for v in {r[column] for r in rows}) / 2
    key = lambda v: (v is not None, 0 if v is None else v)
    values = sorted({r[column] for r in rows}, key=key)
    place, m = {v: i for i, v in enumerate(values)}, len(values)
    if m > buckets:
        place, m = {v: math.floor(buckets * sum(key(r[column]) < key(v) for r in rows) / len(rows)) for v in values}, buckets
    upto = lambda x, i: sum(place[r[column]] <= i for r in x) / len(x)
    return sum(abs(upto(part, i) - upto(rows, i)) for i in range(m - 1)) / (m - 1) if m > 1 else 0.0


def diverse(rows, qi, column, k, depth, l, t, buckets):  # noqa: E741
    def span(part, q):
        v = [r[q] for r in part if r[q] is not None]
        return 0 if not v else max(v) - min(v) if isinstance(v[0], int | float) else len(set(v)) - 1

    def fits(part):
        return len({r[column] for r in part}) >= l and distance(part, rows, column, buckets) <= t + 1e-9

    def split(part, left):
        if len(part) >= 2 * k and left > 0:
            for q in sorted(qi, key=lambda q: -span(part, q)):
                laid = sorted(part, key=lambda r: (("" if q == "s" else float("-inf")) if r[q] is None else r[q], r["id"]))
                halves = laid[: len(laid) // 2], laid[len(laid) // 2 :]
                if all(map(fits, halves)):
                    return split(halves[0], left - 1) + split(halves[1], left - 1)
        return [part]

    return {frozenset(r["id"] for r in p) for p in split(rows, depth)}


@pytest.mark.parametrize("column", ["word", "number"])
@pytest.mark.parametrize(("local", "buckets"), [(0, 1000), (60, 1000), (10**6, 1000), (40, 5), (10**6, 5)])
def test_diverse_classes_are_those_of_the_recursion(spark, column, local, buckets):
    """Every arm, level by level, mixed and in one task: nulls, hot values, refused splits and second choices."""
    rng = random.Random(11)
    rows = []
    for i in range(160):
        a = rng.choice([None, *range(30)])
        rows.append({"id": i, "a": a, "s": rng.choice(["x", "y", "z", None]), "word": rng.choice(["u", "u", "u", "v", None]) if (a or 0) < 15 else rng.choice(["w", "w", "v", "u"]), "number": None if rng.random() < 0.1 else (a or 0) + rng.randrange(6), "_g": "clash"})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, a int, s string, word string, number int, _g string").repartition(3)
    l, t = (3, 0.3) if column == "word" else (4, 0.2)  # noqa: E741
    rule = kanon.sensitive_values(df, column, l, t, buckets)
    got = kanon.mondrian_partitions(df, ["a", "s"], 4, 5, "id", local, sensitive=column, rule=rule)
    assert got.columns == [*df.columns, "_pid"]
    parts = {frozenset(r["ids"]) for r in got.groupBy("_pid").agg(F.collect_list("id").alias("ids")).collect()}
    assert parts == diverse(rows, ["a", "s"], column, 4, 5, l, t, buckets) and 1 < len(parts) < len(mondrian(rows, ["a", "s"], 4, 5))
    by = {r["_pid"]: r for r in kanon.closeness(got, ["_pid"], column, buckets).collect()}
    for r in got.groupBy("_pid").agg(F.collect_list("id").alias("ids")).collect():
        own = [rows[i] for i in r["ids"]]
        c = by[r["_pid"]]
        assert c["size"] == len(own) and c["distinct_values"] == len({x[column] for x in own}) >= l
        assert abs(c["distance"] - distance(own, rows, column, buckets)) < 1e-9 and c["distance"] <= t + 1e-9


def test_limits_that_cannot_be_kept(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], None) for i in range(20)], "a int, s string, n int")
    with pytest.raises(PrivacyError):
        kanon.k_anonymize_table(df, ["a"], 2, sensitive="s", l=3)
    with pytest.raises(PrivacyError):
        kanon.k_anonymize_table(df, ["a"], 2, sensitive="no")
    for bad in (dict(l=0), dict(t=-0.1), dict(t=float("nan")), dict(buckets=1)):
        with pytest.raises(PrivacyError):
            kanon.k_anonymize_table(df, ["a"], 2, sensitive="s", **bad)
    whole = kanon.k_anonymize_table(df, ["a"], 2, sensitive="s", l=2, t=0.0, keep_partition=True)
    assert all(r["d"] == 0 for r in kanon.closeness(whole, ["_pid"], "s").select(F.col("distance").alias("d")).collect())
    assert kanon.k_anonymize_table(df.limit(0), ["a"], 2, sensitive="s", l=3).count() == 0
    assert kanon.k_anonymize_table(df, ["a"], 2, sensitive="n", l=1, t=0.0).count() == 20
    classes = kanon.closeness(spark.createDataFrame([(None, "x"), (None, "y"), (1, "x")], "k int, s string"), ["k"], "s")
    assert {(r["k"], r["size"], round(r["distance"], 6)) for r in classes.collect()} == {(None, 2, 0.166667), (1, 1, 0.333333)}


# -- batches of obfuscated queries: made once a row, by many tasks -----------------------------------------------------------


@pytest.mark.parametrize(("domain", "dummies"), [("medical", 3), ("medical", 0), ("general", 15), (None, 25)])
def test_batch_sends_what_obfuscate_gives(spark, domain, dummies):
    asked = [(1, "流感和失眠怎么办"), (2, "今天吃什么"), (3, obfuscate.MEDICAL_QUERIES[0]), (4, ""), (5, None), (6, "q" * 60), (7, "医保 or 社保卡"), (7, "医保 or 社保卡")]
    df = spark.createDataFrame(asked, "id int, asked string")
    one = df.select("id", obfuscate.obfuscate("asked", dummies, domain, seed="s").alias("o")).collect()
    want = [(r["id"], i, x, i == r["o"]["real_index"]) for r in one for i, x in enumerate(r["o"]["queries"] or ())]
    got = obfuscate.obfuscate_batch(df, "asked", dummies=dummies, domain=domain, seed="s").select("id", "position", "query", "is_real").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_batch_without_seed_marks_the_real_query(spark):
    df = spark.range(2000).selectExpr("id", "concat('我想了解高血压的治疗', id) AS asked")
    sent = obfuscate.obfuscate_batch(df, "asked", dummies=3)
    assert sent.columns == ["id", "asked", "position", "query", "is_real"]
    got = sent.collect()
    assert len(got) == 8000 and all(r["is_real"] == (r["query"] == r["asked"]) for r in got)
    assert {r["position"] for r in got if r["is_real"]} == {0, 1, 2, 3}


def test_batch_obfuscates_once_a_row(spark):
    df = spark.range(5).selectExpr("concat('流感', id) AS asked")
    digests = lambda q: q._jdf.queryExecution().optimizedPlan().toString().count("md5(")
    once = digests(df.select(obfuscate.obfuscate("asked", 3, seed="s").alias("o")))
    assert 0 < digests(obfuscate.obfuscate_batch(df, "asked", dummies=3, seed="s")) <= once


def test_customers_of_one_row_group_ask_from_many_tasks(spark):
    from veilframe import queries

    held = queries.asked(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= 4 and max(r["count"] for r in held) <= 2 * min(r["count"] for r in held)
