"""The registered queries of the privacy operators and the same results in DuckDB SQL.

Every query runs over whole tables. Values that the tables lack (phone, card and identity numbers) are
derived from keys, in both engines by the same rule.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import masks
from veilframe.functions.noise import HashNoise, hash_gaussian_sql, hash_laplace_sql, hash_uniform_sql
from veilframe.operators import dp, kanon, ldp, obfuscate
from veilframe.plans.storage import shared_dir
from veilframe.sources import arrow

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = "7"
NOISE = HashNoise(SEED)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly over tasks. A row group of a Parquet file is read by one task, and a million customers
    fit in one: work that is large for its bytes would stay in that task, however many cores there are."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def people(spark: SparkSession, d: str, deal: bool = False) -> DataFrame:
    """Customers with a phone, identity, card and e-mail derived from the key; dealt out for what judges every field."""
    customers = t(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    check = F.substr(F.lit("10X98765432"), (F.col("c_custkey") % 11 + 1).cast("int"), F.lit(1))
    return (dealt(customers) if deal else customers).select(
        "c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal",
        F.concat(F.lit("138"), F.lpad(key, 8, "0")).alias("mobile_phone"),
        F.concat(F.lit("11010119900101"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), check).alias("id_card"),
        F.concat(F.lit("4"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 15, "0")).alias("bank_no"),
        F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("@"), key)).when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("user"), key)).otherwise(F.concat(F.lit("u"), key, F.lit("@mail.example"))).alias("email"),
        F.concat(F.lit("No."), key, F.lit(" "), "c_mktsegment").alias("address"),
    )


PEOPLE = """(SELECT c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal,
  '138' || lpad(c_custkey::VARCHAR, 8, '0') AS mobile_phone,
  '11010119900101' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || substr('10X98765432', (c_custkey % 11 + 1)::INT, 1) AS id_card,
  '4' || lpad((c_custkey * 7919)::VARCHAR, 15, '0') AS bank_no,
  CASE WHEN c_custkey % 7 = 0 THEN '@' || c_custkey WHEN c_custkey % 5 = 0 THEN 'user' || c_custkey ELSE 'u' || c_custkey || '@mail.example' END AS email,
  'No.' || c_custkey || ' ' || c_mktsegment AS address FROM customer)"""

# -- masking -----------------------------------------------------------------------------------------


def default_sql(c: str, p: int = 3, s: int = 3) -> str:
    return f"CASE WHEN length({c}) > {p + s} THEN substr({c}, 1, {p}) || repeat('*', length({c}) - {p + s}) || right({c}, {s}) ELSE {c} END"


MASK_SQL: dict[str, Callable[[str], str]] = {
    "mobile": lambda c: f"CASE WHEN length({c}) = 11 THEN substr({c}, 1, 3) || '****' || substr({c}, 8) ELSE {c} END",
    "id_card": lambda c: f"CASE WHEN length({c}) = 18 THEN substr({c}, 1, 6) || '********' || substr({c}, 15) ELSE {c} END",
    "name": lambda c: f"CASE WHEN length({c}) = 0 THEN {c} WHEN length({c}) = 2 THEN substr({c}, 1, 1) || '*' ELSE substr({c}, 1, 1) || '**' || right({c}, 1) END",
    "bank_card": lambda c: f"CASE WHEN length({c}) >= 8 THEN substr({c}, 1, 4) || ' **** **** ' || right({c}, 4) ELSE {c} END",
    "email": lambda c: f"CASE WHEN length({c}) = 0 THEN {c} WHEN strpos({c}, '@') <= 1 THEN {default_sql(c, 2, 2)} ELSE substr({c}, 1, 1) || '***' || substr({c}, strpos({c}, '@')) END",
    "address": lambda c: f"CASE WHEN length({c}) > 6 THEN substr({c}, 1, 6) || '***' ELSE {c} END",
    "default": default_sql,
}
_SUBJECT = {"mobile": "mobile_phone", "id_card": "id_card", "name": "c_name", "bank_card": "bank_no", "email": "email", "address": "address", "default": "c_mktsegment"}
for _kind, _column in _SUBJECT.items():
    query(f"mask_{_kind}", f"SELECT c_custkey, {MASK_SQL[_kind](_column)} AS masked FROM {PEOPLE} p")(
        lambda s, d, k=_kind, c=_column: people(s, d).select("c_custkey", masks.MASKS[k](c).alias("masked"))
    )

_LONG = ("c_name", "mobile_phone", "id_card", "email", "address", "c_mktsegment", "bank_no")
_LONG_SQL = " UNION ALL ".join(f"SELECT c_custkey, '{c}' AS field, {c} AS value FROM {PEOPLE} p" for c in _LONG)


def long_people(s: SparkSession, d: str) -> DataFrame:
    return people(s, d, deal=True).select("c_custkey", F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in _LONG))))


def _by_kind_sql(name: str, value: str) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower({name}), '{w}')" for w in words) + f" THEN {MASK_SQL[k](value)}" for k, words in masks.FIELD_KINDS)
    return f"CASE {arms} ELSE {default_sql(value)} END"


@query("mask_value", f"SELECT c_custkey, field, {_by_kind_sql('field', 'value')} AS masked FROM ({_LONG_SQL}) l")
def _(s, d):
    return long_people(s, d).select("c_custkey", "field", masks.mask_by_name("field", "value").alias("masked"))


@query("guess_field_type", "SELECT DISTINCT field, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(field), '{w}')" for w in words) + f" THEN '{k}'" for k, words in masks.FIELD_KINDS) + f" ELSE 'default' END AS kind FROM ({_LONG_SQL}) l")
def _(s, d):
    kinds = F.create_map(*[F.lit(x) for c in _LONG for x in (c, masks.guess_field_type(c))])
    return long_people(s, d).select("field").distinct().select("field", kinds[F.col("field")].alias("kind"))


@query("mask_record", "SELECT c_custkey, c_nationkey, c_acctbal, " + ", ".join(f"{MASK_SQL[masks.guess_field_type(c)](c)} AS {c}" for c in _LONG) + f" FROM {PEOPLE} p")
def _(s, d):
    return masks.mask_record(people(s, d)).select("c_custkey", "c_nationkey", "c_acctbal", *_LONG)


@query("mask_dataframe", f"SELECT s_suppkey, {MASK_SQL['name']('s_name')} AS s_name, s_nationkey, s_acctbal FROM supplier")
def _(s, d):
    return masks.mask_dataframe(t(s, d, "supplier"), columns=["s_nationkey"])


@query("mask_dataframe_intended", "SELECT p_partkey, " + MASK_SQL["name"]("p_name") + " AS p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(s, d):
    return masks.mask_dataframe(t(s, d, "part"), columns=["p_name"], semantics="intended")


@query("mask_batch", f"SELECT c_custkey, array_to_string([{MASK_SQL['name']('c_name')}, {MASK_SQL['email']('email')}], '|') AS masked FROM {PEOPLE} p")
def _(s, d):
    p = people(s, d).select("c_custkey", F.array(F.lit("name"), F.lit("email"), F.lit("phone")).alias("n"), F.array("c_name", "email").alias("v"))
    return p.select("c_custkey", F.array_join(masks.mask_batch("n", "v"), "|").alias("masked"))


@query("mask_map", f"SELECT c_custkey, {MASK_SQL['mobile']('mobile_phone')} AS phone, {MASK_SQL['default']('c_mktsegment')} AS segment FROM {PEOPLE} p")
def _(s, d):
    m = masks.mask_map(F.create_map(F.lit("phone"), F.col("mobile_phone"), F.lit("segment"), F.col("c_mktsegment")))
    return people(s, d).select("c_custkey", m.alias("m")).select("c_custkey", F.col("m")["phone"].alias("phone"), F.col("m")["segment"].alias("segment"))


@query("truncate", "SELECT p_partkey, CASE WHEN length(p_name) > 6 THEN substr(p_name, 1, 6) || '***' ELSE p_name END AS short FROM part")
def _(s, d):
    return t(s, d, "part").select("p_partkey", masks.truncate("p_name", 6).alias("short"))


def hmac_sql(c: str, salt: str) -> str:
    key = salt.encode().ljust(64, b"\0")
    inner, outer = ("'" + "".join(f"\\x{b ^ pad:02X}" for b in key) + "'::BLOB" for pad in (0x36, 0x5C))
    return f"substr(base64(unhex(sha256({outer} || unhex(sha256({inner} || encode({c})))))), 1, 16)"


@query("hmac_token", f"SELECT c_custkey, {hmac_sql('c_custkey::VARCHAR', 'demo-salt')} AS token FROM customer")
def _(s, d):
    return t(s, d, "customer").select("c_custkey", masks.hmac_token(F.col("c_custkey").cast("string"), "demo-salt").alias("token"))


@query("hmac_join", f"SELECT {hmac_sql('c_mktsegment', 'demo-salt')} AS token, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(s, d):
    token = lambda c: masks.hmac_token(F.col(c).cast("string"), "demo-salt")
    c = t(s, d, "customer").select(token("c_custkey").alias("id"), token("c_mktsegment").alias("token"))
    return c.join(t(s, d, "orders").select(token("o_custkey").alias("id")), "id").groupBy("token").agg(F.count("*").alias("orders"))


@query("redact", "SELECT p_partkey, CASE WHEN coalesce(p_type, '') = '' THEN '' ELSE substr(p_type, 1, 4) || '***' END AS r4, CASE WHEN coalesce(p_name, '') = '' THEN '' ELSE substr(p_name, 1, 8) || '***' END AS r8, '[REDACTED]' AS full_mask FROM part")
def _(s, d):
    return t(s, d, "part").select("p_partkey", masks.redact("p_type", 4).alias("r4"), masks.redact_for_log("p_name").alias("r8"), masks.full_mask().alias("full_mask"))


@query("redact_record", "SELECT s_suppkey, CASE WHEN coalesce(s_name, '') = '' THEN '' ELSE substr(s_name, 1, 8) || '***' END AS s_name, s_nationkey, s_acctbal FROM supplier")
def _(s, d):
    return masks.redact_record(t(s, d, "supplier"))


@query("redact_map", f"SELECT c_custkey, substr(email, 1, 8) || '***' AS email, c_mktsegment AS segment FROM {PEOPLE} p")
def _(s, d):
    m = masks.redact_map(F.create_map(F.lit("User-E_Mail"), F.col("email"), F.lit("segment"), F.col("c_mktsegment")))
    return people(s, d).select("c_custkey", m.alias("m")).select("c_custkey", F.col("m")["User-E_Mail"].alias("email"), F.col("m")["segment"].alias("segment"))


# -- central differential privacy --------------------------------------------------------------------


def lap(scale: float | str, key: str) -> str:
    return hash_laplace_sql(str(scale), key if key.startswith("(") else f"'{key}'", SEED)


def gau(sigma: float | str, key: str) -> str:
    return hash_gaussian_sql(str(sigma), key if key.startswith("(") else f"'{key}'", SEED)


def sigma(delta: float, epsilon: float, sensitivity: float = 1.0) -> float:
    return math.sqrt(2 * math.log(1.25 / delta)) * sensitivity / epsilon


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


@query("dp_count", f"SELECT round(greatest(0.0, count(l_quantity) + {lap(1 / 0.5, 'count')}), 4) AS value FROM lineitem")
def _(s, d):
    return rounded(dp.count(t(s, d, "lineitem"), "l_quantity", 0.5, noise=NOISE))


@query("dp_count_gaussian", f"SELECT round(greatest(0.0, count(l_quantity) + {gau(sigma(1e-5, 0.5), 'count')}), 4) AS value FROM lineitem")
def _(s, d):
    return rounded(dp.count(t(s, d, "lineitem"), "l_quantity", 0.5, 1e-5, "gaussian", NOISE))


@query("dp_sum", f"SELECT round(sum(least(40.0, greatest(5.0, l_quantity))) + {lap(35.0 / 1.0, 'sum')}, 4) AS value FROM lineitem")
def _(s, d):
    return rounded(dp.sum(t(s, d, "lineitem"), "l_quantity", 1.0, lower=5, upper=40, noise=NOISE))


@query("dp_sum_unbounded", f"SELECT round(sum(l_quantity) + {lap('(max(l_quantity) - min(l_quantity)) / 1.0', 'sum')}, 4) AS value FROM lineitem")
def _(s, d):
    return rounded(dp.sum(t(s, d, "lineitem"), "l_quantity", 1.0, noise=NOISE))


_MEAN = "CASE WHEN greatest(0.0, n + {c}) > 0 {m} THEN ({s} + {v}) / greatest(0.0, n + {c}) ELSE 0.0 END"


@query("dp_mean", "SELECT round(" + _MEAN.format(c=lap(2.0, "mean.count"), s="s", v=lap(2 * 50.0, "mean.sum"), m="") + ", 4) AS value FROM (SELECT count(*) AS n, sum(least(50.0, greatest(0.0, l_quantity))) AS s FROM lineitem)")
def _(s, d):
    return rounded(dp.mean(t(s, d, "lineitem"), "l_quantity", 1.0, lower=0, upper=50, noise=NOISE))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "9-NONE"]
_DOMAIN_SQL = "(SELECT unnest([" + ", ".join(f"'{p}'" for p in _PRIORITIES) + "]) AS bucket)"


@query("dp_histogram", f"SELECT bucket, round(greatest(0.0, coalesce(n, 0) + {lap(1.0, '(bucket)')}), 4) AS value FROM {_DOMAIN_SQL} LEFT JOIN (SELECT o_orderpriority AS bucket, count(*) AS n FROM orders GROUP BY 1) c USING (bucket)")
def _(s, d):
    return rounded(dp.histogram(t(s, d, "orders"), "o_orderpriority", _PRIORITIES, 1.0, noise=NOISE))


@query("dp_noisy_count", f"SELECT l_returnflag, round(greatest(0.0, count(*) + {lap(2.0, '(l_returnflag)')}), 4) AS value FROM lineitem GROUP BY 1")
def _(s, d):
    g = t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return rounded(g.select("l_returnflag", dp.noisy_count(F.col("n"), 0.5, noise=NOISE, key=F.col("l_returnflag")).alias("value")))


@query("dp_noisy_sum", f"SELECT l_returnflag, round(sum(l_quantity) + {lap(50.0 / 0.5, '(l_returnflag)')}, 4) AS value FROM lineitem GROUP BY 1")
def _(s, d):
    g = t(s, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("s"))
    return rounded(g.select("l_returnflag", dp.noisy_sum(F.col("s"), 50.0, 0.5, noise=NOISE, key=F.col("l_returnflag")).alias("value")))


@query("dp_noisy_mean", "SELECT l_returnflag, round(" + _MEAN.format(c=lap(4.0, "mean.count"), s="s", v=lap(200.0, "mean.sum"), m=f"AND greatest(0.0, n + {lap(4.0, 'mean.count')}) >= 5") + ", 4) AS value FROM (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1)")
def _(s, d):
    g = t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"))
    return rounded(g.select("l_returnflag", dp.noisy_mean(F.col("s"), F.col("n"), 50.0, 0.5, min_count=5, noise=NOISE).alias("value")))


@query("dp_noisy_histogram", f"SELECT event_type AS bucket, round(greatest(0.0, count(*) + {gau(sigma(1e-5, 1.0), '(event_type)')}), 4) AS value FROM events GROUP BY 1")
def _(s, d):
    g = t(s, d, "events").groupBy(F.col("event_type").alias("bucket")).agg(F.count("*").alias("value"))
    return rounded(dp.noisy_histogram(g, 1.0, 1e-5, "gaussian", NOISE))


def chunks(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("c"))


@query("dp_chunked_count", f"SELECT round(greatest(0.0, count(*) + {lap(1.0, 'count')}), 4) AS value FROM lineitem")
def _(s, d):
    return rounded(dp.chunked_count(chunks(s, d), "c", 1.0, noise=NOISE))


@query("dp_chunked_sum", f"SELECT round(sum(least(30.0, l_quantity)) + {lap(1.0, 'sum')}, 4) AS value FROM lineitem")
def _(s, d):
    return rounded(dp.chunked_sum(chunks(s, d), "c", 1.0, upper=30, noise=NOISE))


@query("dp_chunked_mean", "SELECT round(CASE WHEN n < 5 THEN 0.0 ELSE " + _MEAN.format(c=lap(2.0, "mean.count"), s="s", v=lap(100.0, "mean.sum"), m=f"AND greatest(0.0, n + {lap(2.0, 'mean.count')}) >= 5") + " END, 4) AS value FROM (SELECT count(*) AS n, sum(least(50.0, greatest(0.0, l_quantity))) AS s FROM lineitem)")
def _(s, d):
    return rounded(dp.chunked_mean(chunks(s, d), "c", 1.0, lower=0, upper=50, noise=NOISE))


@query("dp_chunked_histogram", f"SELECT coalesce(a.bucket, c.bucket) AS bucket, round(greatest(0.0, coalesce(n, 0) + {lap(1.0, '(coalesce(a.bucket, c.bucket))')}), 4) AS value FROM {_DOMAIN_SQL} a FULL JOIN (SELECT o_orderpriority AS bucket, count(*) AS n FROM orders GROUP BY 1) c ON a.bucket = c.bucket")
def _(s, d):
    c = t(s, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("c"))
    return rounded(dp.chunked_histogram(c, "c", _PRIORITIES, 1.0, noise=NOISE))


_CLIPPED = """(SELECT i - 1 AS pos, count(*) AS n, sum(x * f) AS s FROM (
  SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, CASE WHEN norm > 0.9 THEN 0.9 / norm ELSE 1.0 END AS f
  FROM (SELECT embedding, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS norm FROM embeddings)) GROUP BY 1)"""


@query("dp_vector_sum", f"SELECT pos::INT AS pos, round(s + {gau(sigma(1e-5, 1.0, 0.9) * 8, '(concat(chr(118), pos))')}, 3) AS value FROM {_CLIPPED}")
def _(s, d):
    return rounded(dp.vector_sum(t(s, d, "embeddings"), "embedding", 0.9, 1.0, 1e-5, noise=NOISE), 3)


_VN = f"greatest(0.0, n + {gau(sigma(0.5e-5, 0.5), 'vector.count')})"


@query("dp_vector_mean", f"SELECT pos::INT AS pos, round(CASE WHEN {_VN} >= 5 THEN (s + {gau(sigma(0.5e-5, 0.5, 0.9) * 8, '(concat(chr(118), pos))')}) / {_VN} ELSE 0.0 END, 4) AS value FROM {_CLIPPED}")
def _(s, d):
    return rounded(dp.vector_mean(t(s, d, "embeddings"), "embedding", 0.9, 1.0, 1e-5, noise=NOISE))


def _clip_sql(column: str, table: str, epsilon: float, q: float, rounds: int, top: float) -> str:
    steps = [f"s0 AS (SELECT 0.0::DOUBLE AS low, {top}::DOUBLE AS high)"]
    for i in range(rounds):
        share = f"(SELECT count(*) FILTER (WHERE {column} > (low + high) / 2)::DOUBLE / count({column}) + {lap(f'{rounds} / (count({column}) * {epsilon})', f'clip{i}')} FROM {table})"
        steps.append(f"s{i + 1} AS (SELECT CASE WHEN {share} > {1 - q!r} THEN (low + high) / 2 ELSE low END AS low, CASE WHEN {share} > {1 - q!r} THEN high ELSE (low + high) / 2 END AS high FROM s{i})")
    return f"WITH {', '.join(steps)} SELECT (SELECT min({column}) FROM {table})::DOUBLE AS lower, round(high, 6) AS upper FROM s{rounds}"


@query("dp_adaptive_clip", _clip_sql("l_quantity", "lineitem", 1.0, 0.95, 10, 64.0))
def _(s, d):
    lo, hi = dp.adaptive_clip(t(s, d, "lineitem"), "l_quantity", 1.0, 0.95, 10, 64.0, NOISE)
    return s.createDataFrame([(lo, round(hi, 6))], "lower double, upper double")


def _group_sql(table: str, group: str, value: str, agg: str, epsilon: float, noise: str) -> str:
    size = lap(1 / epsilon, "(g || '#size')")
    return f"SELECT g AS \"group\", round(a + {noise}, 4) AS value FROM (SELECT coalesce({group}::VARCHAR, 'null') AS g, {agg.format(v=value)} AS a, count(*) AS n FROM {table} GROUP BY 1) WHERE n + {size} >= {1 + 1 / epsilon}"


@query("dp_groupby", _group_sql("lineitem", "l_suppkey", "least(50.0, greatest(0.0, l_quantity))", "sum({v})", 0.02, lap(50 / 0.02, "(g)")))
def _(s, d):
    return rounded(dp.group_by(t(s, d, "lineitem"), "l_suppkey", "l_quantity", "sum", 0.02, lower=0, upper=50, noise=NOISE))


@query("dp_groupby_mean_gaussian", _group_sql("events", "event_type", "least(100.0, greatest(0.0, value))", "avg({v})", 1.0, gau(sigma(1e-5, 1.0, 100.0), "(g)")))
def _(s, d):
    return rounded(dp.group_by(t(s, d, "events"), "event_type", "value", "mean", 1.0, lower=0, upper=100, mechanism="gaussian", noise=NOISE))


@query("dp_groupby_count", _group_sql("events", "user_id", "1", "count(*)", 0.5, lap(2.0, "(g)")))
def _(s, d):
    return rounded(dp.group_by(t(s, d, "events"), "user_id", "value", "count", 0.5, noise=NOISE))


_FLAGS = "(SELECT unnest(['A', 'N', 'R']) AS bucket)"
_A_MEAN = _MEAN.format(c=lap(6.0, "l_quantity.mean.count"), s="s", v=lap(6.0 * 50, "l_quantity.mean.sum"), m="")


@query("dp_aggregate", f"""SELECT 'l_quantity' AS "column", 'mean' AS statistic, NULL::VARCHAR AS bucket, round({_A_MEAN}, 4) AS value FROM (SELECT count(*) AS n, sum(least(50.0, greatest(0.0, l_quantity))) AS s FROM lineitem)
UNION ALL SELECT 'l_tax', 'count', NULL, round(greatest(0.0, count(l_tax) + {lap(3.0, "l_tax.count")}), 4) FROM lineitem
UNION ALL SELECT 'l_returnflag', 'histogram', bucket, round(greatest(0.0, coalesce(n, 0) + {lap(3.0, "(bucket)")}), 4) FROM {_FLAGS} LEFT JOIN (SELECT l_returnflag AS bucket, count(*) AS n FROM lineitem GROUP BY 1) c USING (bucket)""")  # fmt: skip
def _(s, d):
    specs = {"l_quantity": ("mean", {"clip_lower": 0, "clip_upper": 50}), "l_tax": ("count", {}), "l_returnflag": ("histogram", {"categories": ["A", "N", "R"]})}
    return rounded(dp.aggregate(t(s, d, "lineitem"), specs, 1.0, noise=NOISE))


@query("dp_count_details", f"SELECT round(v, 4) AS value, 2.0::DOUBLE AS noise_scale, 0.5::DOUBLE AS epsilon_spent, 0.0::DOUBLE AS delta_spent, round(v + 2.0 * ln(0.05), 4) AS ci_lower, round(v - 2.0 * ln(0.05), 4) AS ci_upper FROM (SELECT greatest(0.0, count(l_quantity) + {lap(2.0, 'count')}) AS v FROM lineitem)")
def _(s, d):
    return rounded(dp.with_details(dp.count(t(s, d, "lineitem"), "l_quantity", 0.5, noise=NOISE), 0.5, 0.0, 2.0))


@query("dp_arrow_count", f"SELECT round(greatest(0.0, count(*) + {lap(1.0, 'count')}), 4) AS value FROM supplier")
def _(s, d):
    path = f"{shared_dir(s)}/veilframe/arrow-{uuid.uuid4().hex}"
    arrow.write_arrow(t(s, d, "supplier").select("s_acctbal"), path)
    return rounded(dp.count(arrow.read_arrow(s, path), "s_acctbal", 1.0, noise=NOISE))


# -- local differential privacy ----------------------------------------------------------------------


def _uni(key: str) -> str:
    return hash_uniform_sql(key, SEED)


_P2 = ldp._keep(1.0)
_BINARY = f"(SELECT doc_id, CASE WHEN {_uni('doc_id::VARCHAR')} < {_P2!r} THEN toxic ELSE 1 - toxic END AS reported FROM labels)"


def binary_reports(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "labels").select("doc_id", ldp.perturb_binary(F.col("toxic"), 1.0, F.col("doc_id").cast("string"), NOISE).alias("reported"))


query("ldp_binary", f"SELECT * FROM {_BINARY}")(binary_reports)


@query("ldp_binary_estimate", f"SELECT round(greatest(0.0, least(1.0, (avg(CASE WHEN reported = 1 THEN 1.0 ELSE 0.0 END) - {1 - _P2!r}) / {2 * _P2 - 1!r})), 6) AS frequency FROM {_BINARY}")
def _(s, d):
    return rounded(ldp.estimate_binary(binary_reports(s, d), "reported", 1.0), 6)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_PK = ldp._keep(1.0, 5)
_QK = (1 - _PK) / 4
_SEG_SQL = "[" + ", ".join(f"'{x}'" for x in _SEGMENTS) + "]"
_CATEGORICAL = f"""(SELECT c_custkey, CASE WHEN u < {_PK!r} THEN c_mktsegment ELSE seg[CASE WHEN idx = 0 THEN least(floor(v * 5), 4) + 1 ELSE least(floor(v * 4), 3) + CASE WHEN least(floor(v * 4), 3) >= idx - 1 THEN 2 ELSE 1 END END::INT] END AS reported
FROM (SELECT c_custkey, c_mktsegment, {_SEG_SQL} AS seg, coalesce(list_position({_SEG_SQL}, c_mktsegment), 0) AS idx, {_uni('c_custkey::VARCHAR')} AS u, {_uni("(c_custkey::VARCHAR || '#other')")} AS v FROM customer))"""


def categorical_reports(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "customer").select("c_custkey", ldp.perturb_categorical(F.col("c_mktsegment"), _SEGMENTS, 1.0, F.col("c_custkey").cast("string"), NOISE).alias("reported"))


query("ldp_categorical", f"SELECT * FROM {_CATEGORICAL}")(categorical_reports)


@query("ldp_categorical_estimate", f"""WITH r AS (SELECT * FROM {_CATEGORICAL}), e AS (
  SELECT bucket, greatest(0.0, least(1.0, ((SELECT count(*) FROM r WHERE reported = bucket)::DOUBLE / (SELECT count(*) FROM r) - {_QK!r}) / {_PK - _QK!r})) AS e FROM (SELECT unnest({_SEG_SQL}) AS bucket))
SELECT bucket, round(e / sum(e) OVER (), 6) AS frequency FROM e""")
def _(s, d):
    return rounded(ldp.estimate_histogram(categorical_reports(s, d), "reported", _SEGMENTS, 1.0), 6)


# -- k-anonymity -------------------------------------------------------------------------------------


def ages(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "customer")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 50 == 0, "n/a").otherwise(F.floor(F.col("c_acctbal") / 100).cast("string")).alias("age"), F.lpad((F.col("c_custkey") * 37 % 1000000).cast("string"), 6, "0").alias("zip"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"))


AGES = "(SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'n/a' ELSE floor(c_acctbal / 100)::BIGINT::VARCHAR END AS age, lpad((c_custkey * 37 % 1000000)::VARCHAR, 6, '0') AS zip, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM customer)"


def _age_sql(width: int) -> str:
    start = f"(try_cast(age AS INT) - try_cast(age AS INT) % {width})"
    return f"CASE WHEN regexp_full_match(age, '[+-]?[0-9]+') THEN '[' || {start} || '-' || ({start} + {width}) || ']' ELSE '*' END"


@query("kanon_age", f"SELECT c_custkey, age AS l0, {_age_sql(5)} AS l1, {_age_sql(10)} AS l2, {_age_sql(20)} AS l3, '*' AS l4 FROM {AGES} a")
def _(s, d):
    return ages(s, d).select("c_custkey", *(kanon.AgeHierarchy().generalize(F.col("age"), i).alias(f"l{i}") for i in range(5)))


@query("kanon_zip", f"SELECT c_custkey, zip AS l0, substr(zip, 1, 3) || '***' AS l1, substr(zip, 1, 2) || '****' AS l2, substr(zip, 1, 1) || '*****' AS l3, '*' AS l4 FROM {AGES} a")
def _(s, d):
    return ages(s, d).select("c_custkey", *(kanon.ZipcodeHierarchy().generalize(F.col("zip"), i).alias(f"l{i}") for i in range(5)))


@query("kanon_gender", f"SELECT c_custkey, gender AS l0, '*' AS l1 FROM {AGES} a")
def _(s, d):
    return ages(s, d).select("c_custkey", *(kanon.GenderHierarchy().generalize(F.col("gender"), i).alias(f"l{i}") for i in range(2)))


@query("kanon_record", f"SELECT c_custkey, {_age_sql(10)} AS age, substr(zip, 1, 2) || '****' AS zip, '*' AS gender FROM {AGES} a")
def _(s, d):
    h = {"age": kanon.AgeHierarchy(), "zip": kanon.ZipcodeHierarchy(), "gender": kanon.GenderHierarchy()}
    return kanon.anonymize_record(ages(s, d), ["age", "zip", "gender"], h, 10)


_QI = ["c_nationkey", "c_acctbal", "c_mktsegment"]


def mondrian_sql(strings: bool, k: int = 5, depth: int = 10) -> str:
    """The level-by-level splits unrolled; row order within equal values is by key."""
    text = lambda c: f"coalesce({c}::VARCHAR, '')"
    cols = [f"{text(c) if strings else c} AS {c}" for c in _QI]
    steps = [f"l0 AS (SELECT c_custkey, c_name, {', '.join(cols)}, 1::BIGINT AS pid FROM customer)"]
    span = lambda c: f"count(DISTINCT {c}) - 1" if strings or c == "c_mktsegment" else f"(max({c}) - min({c}))::DOUBLE"
    for i in range(depth):
        steps.append(f"s{i} AS (SELECT pid, count(*) AS n, {', '.join(f'{span(c)} AS w{j}' for j, c in enumerate(_QI))} FROM l{i} GROUP BY pid)")
        dim = "CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END"
        by = ", ".join(f"CASE WHEN ({dim}) = {j} THEN {c} END" for j, c in enumerate(_QI))
        ranked = f"SELECT l{i}.*, n, row_number() OVER (PARTITION BY pid ORDER BY {by}, c_custkey) AS rn FROM l{i} JOIN s{i} USING (pid)"
        steps.append(f"l{i + 1} AS (SELECT c_custkey, c_name, {', '.join(_QI)}, CASE WHEN n >= {2 * k} THEN 2 * pid + (rn > n // 2)::BIGINT ELSE pid END AS pid FROM ({ranked}))")

    def leaf(c: str) -> str:
        if strings or c == "c_mktsegment":
            return f"CASE WHEN count(DISTINCT {c}) OVER w = 1 THEN {c} ELSE '{{' || array_to_string(list_sort(list_distinct(list({c}) OVER w)), ',') || '}}' END"
        lo, hi = (f"({f}({c}) OVER w)::DOUBLE" for f in ("min", "max"))
        whole = lambda v: f"CASE WHEN {lo} = floor({lo}) AND {hi} = floor({hi}) THEN {v}::BIGINT::VARCHAR ELSE {v}::VARCHAR END"
        return f"CASE WHEN {lo} = {hi} THEN {lo}::VARCHAR ELSE '[' || {whole(lo)} || '-' || {whole(hi)} || ']' END"

    return f"WITH {', '.join(steps)} SELECT c_custkey, c_name, {', '.join(f'{leaf(c)} AS {c}' for c in _QI)} FROM l{depth} WINDOW w AS (PARTITION BY pid)"


@query("kanon_table", mondrian_sql(False))
def _(s, d):
    return kanon.k_anonymize_table(t(s, d, "customer"), _QI, 5, 10, order="c_custkey")


@query("kanon_table_strings", mondrian_sql(True))
def _(s, d):
    return kanon.k_anonymize_strings(t(s, d, "customer"), _QI, 5, 10, order="c_custkey")


@query("kanon_class_check", "SELECT count(*) AS records, true AS all_at_least_k FROM customer")
def _(s, d):
    a = kanon.k_anonymize_table(t(s, d, "customer"), _QI, 5, 10, order="c_custkey", keep_partition=True)
    return a.groupBy("_pid").agg(F.count("*").alias("n")).agg(F.sum("n").alias("records"), F.bool_and(F.col("n") >= 5).alias("all_at_least_k"))


def diverse_sql(qi: list[str], texts: list[str], sensitive: str, place: str, places: int | None, k: int, depth: int, l: int, t: float) -> str:  # noqa: E741
    """Levels of attempts: a partition is halved along the first identifier, from the widest span on, whose halves both
    have ``l`` values and lie within ``t``. ``place``: of the value in the whole order; ``places`` None: words."""
    cols = ", ".join(qi)
    steps = [f"c0 AS (SELECT c_custkey, c_name, {cols}, {sensitive} AS s, {place} AS code, count(*) OVER (PARTITION BY {sensitive})::DOUBLE / count(*) OVER () AS g, 1::BIGINT AS pid, false AS set FROM customer)"]
    if places:
        steps.append(f"whole AS (SELECT r, (count(*) FILTER (code <= r))::DOUBLE / count(*) AS upto FROM c0, range({places - 1}) u(r) GROUP BY r)")
    at = 0
    for _ in range(depth):
        for j in range(len(qi)):
            a, b = f"c{at}", f"c{at + 1}"
            spans = ", ".join((f"count(DISTINCT {q})::DOUBLE - 1" if q in texts else f"(max({q}) - min({q}))::DOUBLE") + f" AS w{i}" for i, q in enumerate(qi))
            rank = lambda i: " + ".join(f"(w{o} > w{i} OR w{o} = w{i} AND {o} < {i})::INT" for o in range(len(qi)) if o != i)
            by = ", ".join(f"CASE WHEN {rank(i)} = {j} THEN {q} END" for i, q in enumerate(qi))
            distance = "sum(greatest(0, n::DOUBLE / size - g))"
            steps += [
                f"w{at} AS MATERIALIZED (SELECT pid, count(*) AS n, {spans} FROM {a} WHERE NOT set GROUP BY pid HAVING count(*) >= {2 * k})",
                f"h{at} AS MATERIALIZED (SELECT {a}.*, (row_number() OVER (PARTITION BY pid ORDER BY {by}, c_custkey) > n // 2)::BIGINT AS half FROM {a} JOIN w{at} USING (pid) WHERE NOT set)",
            ]
            if places:
                steps.append(f"d{at} AS (SELECT pid, half, sum(abs(f - upto)) / {places - 1} AS dist FROM (SELECT pid, half, r, (count(*) FILTER (code <= r))::DOUBLE / count(*) AS f FROM h{at}, range({places - 1}) u(r) GROUP BY ALL) JOIN whole USING (r) GROUP BY ALL)")
            else:
                steps.append(f"d{at} AS (SELECT pid, half, {distance} AS dist FROM (SELECT pid, half, s, g, count(*) AS n, sum(count(*)) OVER (PARTITION BY pid, half) AS size FROM h{at} GROUP BY pid, half, s, g) GROUP BY pid, half)")
            steps += [
                f"k{at} AS (SELECT pid FROM d{at} JOIN (SELECT pid, half, count(DISTINCT s) AS l FROM h{at} GROUP BY ALL) USING (pid, half) GROUP BY pid HAVING bool_and(l >= {l} AND dist <= {t + 1e-9}))",
                f"{b} AS MATERIALIZED (SELECT c.c_custkey, c.c_name, {', '.join('c.' + q for q in qi)}, c.s, c.code, c.g, CASE WHEN k.pid IS NULL THEN c.pid ELSE 2 * c.pid + half END AS pid, {'false' if j == len(qi) - 1 else 'c.set OR k.pid IS NOT NULL'} AS set FROM {a} c LEFT JOIN k{at} k ON c.pid = k.pid AND NOT c.set LEFT JOIN h{at} h ON h.c_custkey = c.c_custkey)",
            ]
            at += 1
    return f"WITH {', '.join(steps)} SELECT c_custkey, pid FROM c{at}"


# The widest span is the balance's for long; words are 1 apart.
@query("kanon_diverse", diverse_sql(["c_nationkey", "c_acctbal"], [], "c_mktsegment", "0", None, 5, 6, 4, 0.2))
def _(s, d):
    rows = t(s, d, "customer")
    rule = kanon.sensitive_values(rows, "c_mktsegment", 4, 0.2)
    return kanon.mondrian_partitions(rows, ["c_nationkey", "c_acctbal"], 5, 6, "c_custkey", sensitive="c_mktsegment", rule=rule).select("c_custkey", F.col("_pid").alias("pid"))


# Balances are ordered, in 50 places by the share of smaller ones.
@query("kanon_close", diverse_sql(["c_nationkey", "c_mktsegment"], ["c_mktsegment"], "c_acctbal", "floor(50 * (rank() OVER (ORDER BY c_acctbal) - 1) / count(*) OVER ())::INT", 50, 5, 6, 6, 0.1))
def _(s, d):
    rows = t(s, d, "customer")
    rule = kanon.sensitive_values(rows, "c_acctbal", 6, 0.1, 50)
    return kanon.mondrian_partitions(rows, ["c_nationkey", "c_mktsegment"], 5, 6, "c_custkey", sensitive="c_acctbal", rule=rule).select("c_custkey", F.col("_pid").alias("pid"))


@query("kanon_diverse_check", "SELECT count(*) AS records, true AS all_at_least_k, true AS all_diverse, true AS all_close FROM customer")
def _(s, d):
    rows = t(s, d, "customer")
    held = kanon.k_anonymize_table(rows, ["c_nationkey", "c_acctbal"], 5, 10, order="c_custkey", keep_partition=True, sensitive="c_mktsegment", l=3, t=0.25)
    c = kanon.closeness(held, ["_pid"], "c_mktsegment")
    return c.agg(F.sum("size").alias("records"), F.bool_and(F.col("size") >= 5).alias("all_at_least_k"), F.bool_and(F.col("distinct_values") >= 3).alias("all_diverse"), F.bool_and(F.col("distance") <= 0.25 + 1e-9).alias("all_close"))


@query("t_closeness", """WITH w AS (SELECT c_mktsegment AS s, count(*)::DOUBLE / sum(count(*)) OVER () AS g FROM customer GROUP BY 1),
c AS (SELECT c_nationkey, c_mktsegment AS s, count(*) AS n, sum(count(*)) OVER (PARTITION BY c_nationkey) AS size FROM customer GROUP BY c_nationkey, c_mktsegment)
SELECT c_nationkey, CAST(any_value(size) AS BIGINT) AS size, count(*) AS distinct_values, round(sum(greatest(0, n / size - g)), 6) AS distance FROM c JOIN w USING (s) GROUP BY 1""")
def _(s, d):
    return rounded(kanon.closeness(t(s, d, "customer"), ["c_nationkey"], "c_mktsegment"), 6)


# One level: the widest identifier is the balance; ranks split it at the middle row.
@query("kanon_one_split", """WITH r AS (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) > count(*) OVER () // 2 AS upper FROM customer)
SELECT c_custkey, '[' || CASE WHEN w THEN lo::BIGINT::VARCHAR ELSE lo::VARCHAR END || '-' || CASE WHEN w THEN hi::BIGINT::VARCHAR ELSE hi::VARCHAR END || ']' AS c_acctbal FROM (
  SELECT c_custkey, min(c_acctbal) OVER (PARTITION BY upper) AS lo, max(c_acctbal) OVER (PARTITION BY upper) AS hi, lo = floor(lo) AND hi = floor(hi) AS w FROM r)""")
def _(s, d):
    return kanon.k_anonymize_table(t(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey", "c_acctbal"], 5, 1, order="c_custkey").select("c_custkey", "c_acctbal")


@query("l_diversity", "SELECT c_nationkey, count(*) AS size, count(DISTINCT c_mktsegment) AS distinct_values FROM customer GROUP BY 1")
def _(s, d):
    return kanon.diversity(t(s, d, "customer"), ["c_nationkey"], "c_mktsegment")


# -- query obfuscation -------------------------------------------------------------------------------


def _list_sql(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _shuffled_sql(items: str, q: str) -> str:
    return f"list_transform(list_sort(list_transform({items}, lambda x: md5('{SEED}|' || {q} || '|' || x) || x)), lambda y: substr(y, 33))"


_POS = f"(('0x' || substr(md5('{SEED}|' || q), 1, 7))::BIGINT % 4)"
_ASKED = ["我想了解高血压的治疗", "流感和失眠怎么办", "今天吃什么"]


def asked(s: SparkSession, d: str) -> DataFrame:
    return dealt(t(s, d, "customer").select("c_custkey")).select("c_custkey", F.concat(F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("c_custkey") % 3 + 1).cast("int")), F.col("c_custkey").cast("string")).alias("q"))


ASKED = f"(SELECT c_custkey, {_list_sql(_ASKED)}[c_custkey % 3 + 1] || c_custkey AS q FROM customer)"


def _similar_sql(pool: str) -> str:
    others = f"list_filter({pool}, lambda x: x <> q)"
    near = lambda n: f"list_filter({others}, lambda x: abs(length(x) - length(q)) <= {n})"
    close = f"CASE WHEN len({near(6)}) > 0 THEN {near(6)} WHEN len({near(12)}) > 0 THEN {near(12)} ELSE {others} END"
    order = _shuffled_sql(f"({close})", "q")
    return f"list_slice(list_concat({order}, {order}, {order}), 1, 3)"


def _obfuscated_sql(source: str, key: str, fakes: str, strategy: str) -> str:
    return f"SELECT {key}, array_to_string(list_concat(list_slice(f, 1, pos), [q], list_slice(f, pos + 1, 3)), '|') AS queries, pos::INT AS real_index, strategy FROM (SELECT {key}, q, {_POS} AS pos, {fakes} AS f, {strategy} AS strategy FROM {source} a)"


def _slots_sql() -> str:
    arms = []
    for term in obfuscate.DISEASES:
        others = _list_sql(o for o in obfuscate.DISEASES if o != term)
        arms.append(f"WHEN contains(q, '{term}') THEN list_transform(list_slice({_shuffled_sql(others, 'q')}, 1, 3), lambda o: replace(q, '{term}', o))")
    return f"CASE {' '.join(arms)} ELSE {_similar_sql(_list_sql(obfuscate.MEDICAL_QUERIES))} END"


_HAS_TERM = "CASE WHEN " + " OR ".join(f"contains(q, '{x}')" for x in obfuscate.DISEASES) + " THEN 'slot_filling' ELSE 'length_similarity' END"


@query("qol_slot_fill", _obfuscated_sql(ASKED, "c_custkey", _slots_sql(), _HAS_TERM))
def _(s, d):
    o = obfuscate.obfuscate("q", 3, "medical", seed=SEED)
    return asked(s, d).select("c_custkey", o.alias("o")).select("c_custkey", F.array_join("o.queries", "|").alias("queries"), "o.real_index", "o.strategy")


_POOL = [f"how do I reset item {i:03d}" + " please" * (i % 5) for i in range(12)]
_BENCH = "(SELECT item_id, text AS q FROM benchmark)"


@query("qol_length_similar", _obfuscated_sql(_BENCH, "item_id", _similar_sql(_list_sql(_POOL)), "'length_similarity'"))
def _(s, d):
    o = obfuscate.obfuscate("q", 3, "general", generic_pool=_POOL, seed=SEED)
    return t(s, d, "benchmark").select("item_id", F.col("text").alias("q")).select("item_id", o.alias("o")).select("item_id", F.array_join("o.queries", "|").alias("queries"), "o.real_index", "o.strategy")


@query("qol_batch", f"SELECT c_custkey, i - 1 AS position, x AS query, x = q AS is_real FROM (SELECT c_custkey, q, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT c_custkey, q, list_concat(list_slice(f, 1, pos), [q], list_slice(f, pos + 1, 3)) AS l FROM (SELECT c_custkey, q, {_POS} AS pos, {_slots_sql()} AS f FROM {ASKED} a)))")
def _(s, d):
    return obfuscate.obfuscate_batch(asked(s, d).withColumnRenamed("q", "asked"), "asked", dummies=3, seed=SEED).select("c_custkey", F.col("position").cast("long").alias("position"), "query", "is_real")


def queries() -> dict[str, Query]:
    import veilframe.rule_queries  # noqa: F401  (registers the rest)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
