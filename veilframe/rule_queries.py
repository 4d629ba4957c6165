"""Queries of matchers, classification, pipelines, budget, parameters, ingest and load statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import ID_CHECKS, ID_WEIGHTS, normalised_text
from veilframe.operators import stats
from veilframe.plans import classify, ledger, matchers, packs, params, pipeline
from veilframe.plans.classify import Classifier
from veilframe.plans.matchers import Field
from veilframe.plans.model import Matcher, Rule
from veilframe.plans.storage import shared_dir
from veilframe.queries import _LONG, _LONG_SQL, AGES, MASK_SQL, PEOPLE, ages, long_people, people, query, t
from veilframe.sources import ingest

# -- matchers ----------------------------------------------------------------------------------------


def plain_sql(x: str) -> str:
    return f"regexp_replace(lower({x}), '[_\\-\\s]+', '', 'g')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def digits_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def luhn_sql(x: str) -> str:
    d = f"substr(reverse({x}), i::INT, 1)::INT"
    return f"(coalesce(list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END ELSE {d} END)), 0) % 10 = 0)"


def id_card_sql(x: str) -> str:
    total = " + ".join(f"coalesce(try_cast(substr({x}, {i + 1}, 1) AS INT), 0) * {w}" for i, w in enumerate(ID_WEIGHTS))
    return f"(regexp_full_match({x}, '[0-9]{{17}}.') AND upper(substr({x}, 18, 1)) = substr('{ID_CHECKS}', (({total}) % 11 + 1)::INT, 1))"


def hit_sql(m: Matcher, name: str, value: str) -> str:
    """A matcher's reference semantics in SQL, written apart from the compiler under test."""
    p = m.params
    if m.operator == "regex":
        return f"coalesce(regexp_matches({value}, {_q(p['pattern'])}), false)"
    if m.operator == "keyword_contains":
        subject = plain_sql(name if "name" in p.get("fields", ()) else value)
        return "coalesce(" + " OR ".join(f"contains({subject}, {_q(normalised_text(k))})" for k in p["keywords"]) + ", false)"
    if m.operator == "id_card_checksum":
        return f"coalesce({id_card_sql(value)}, false)"
    if m.operator == "medical_card_checksum":
        return f"coalesce(length({digits_sql(value)}) BETWEEN 8 AND 12 AND {luhn_sql(digits_sql(value))}, false)"
    if m.operator == "luhn_checksum":
        return f"coalesce(length({digits_sql(value)}) >= 13 AND {luhn_sql(digits_sql(value))}, false)"
    return "false"



def _match(name: str, params_: dict, table: str, key: str, column: str, sql: str, source: str | None = None) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = {"people": people, "ages": ages}[table](s, d) if table in ("people", "ages") else t(s, d, table)
        return df.select(key, matchers.get(name)(Field(F.lit(column), F.col(column)), params_).alias("hit"))

    source = source or {"people": f"{PEOPLE} p", "ages": f"{AGES} a"}.get(table, table)
    query(f"match_{name}", f"SELECT {key}, {sql} AS hit FROM {source}")(run)


_match("regex", {"pattern": r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]+"}, "documents", "doc_id", "text", r"coalesce(regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+\.[a-z]+'), false)")
_match("keyword_contains", {"keywords": ["id_iot", "clown", "path etic"]}, "documents", "doc_id", "text", "coalesce(" + " OR ".join(f"contains({plain_sql('text')}, '{k}')" for k in ("idiot", "clown", "pathetic")) + ", false)")
_match("keyword_equals", {"keywords": ["red-widget", "Blue Bolt"]}, "part", "p_partkey", "p_name", f"coalesce({plain_sql('p_name')} IN ('redwidget', 'bluebolt'), false)")
_match("prefix", {"prefixes": ["ECO", "SM"]}, "part", "p_partkey", "p_type", "coalesce(starts_with(p_type, 'ECO') OR starts_with(p_type, 'SM'), false)")
_match("suffix", {"suffixes": ["ring", "bolt"]}, "part", "p_partkey", "p_name", "coalesce(ends_with(p_name, 'ring') OR ends_with(p_name, 'bolt'), false)")
_match("length_range", {"min": "9", "max": 10}, "part", "p_partkey", "p_name", "coalesce(length(p_name) BETWEEN 9 AND 10, false)")
_match("id_card_checksum", {}, "people", "c_custkey", "id_card", f"coalesce({id_card_sql('id_card')}, false)")
_match("medical_card_checksum", {}, "people", "c_custkey", "mobile_phone", f"coalesce(length({digits_sql('mobile_phone')}) BETWEEN 8 AND 12 AND {luhn_sql(digits_sql('mobile_phone'))}, false)")
_match("luhn_checksum", {}, "people", "c_custkey", "bank_no", f"coalesce(length({digits_sql('bank_no')}) >= 13 AND {luhn_sql(digits_sql('bank_no'))}, false)")
_match("value_range", {"max": "40.5"}, "ages", "c_custkey", "age", "coalesce(try_cast(age AS DOUBLE) >= 5e-324 AND try_cast(age AS DOUBLE) <= 40.5, false)")
_match("contains_digit_ratio", {"threshold": 0.2}, "people", "c_custkey", "address", "coalesce(length(address) > 0 AND length(regexp_replace(address, '[^0-9]', '', 'g'))::DOUBLE / length(address) >= 0.2, false)")


@query("match_date_range", r"""SELECT o_orderkey, coalesce(regexp_matches(note, '\d{4}[-/]\d{2}[-/]\d{2}'), false) AS hit FROM (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'due ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') || ' noon' WHEN 2 THEN strftime(o_orderdate, '%Y.%m.%d') END AS note FROM orders)""")
def _(s, d):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    note = F.when(k == 0, F.concat(F.lit("due "), F.date_format(day, "yyyy-MM-dd"))).when(k == 1, F.concat(F.date_format(day, "yyyy/MM/dd"), F.lit(" noon"))).when(k == 2, F.date_format(day, "yyyy.MM.dd"))
    return t(s, d, "orders").select("o_orderkey", matchers.get("date_range")(Field(F.lit("note"), note), {}).alias("hit"))


# A name that starts with c_, one that holds what is no pattern, and one by its script.
@query("match_field_name_match", "SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS hit FROM part")
def _(s, d):
    name = F.element_at(F.array(*map(F.lit, ("C_name", "my(KEY)", "acct_c_id", "患者姓名", "key"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t(s, d, "part").select("p_partkey", matchers.get("field_name_match")(Field(name, F.col("p_name")), {"patterns": ["^c_", "(key", r"\p{IsHan}{2}"]}).alias("hit"))


#: Patterns of the engine's own dialect, by column: classes, named groups, possessive quantifiers, look-behind,
#: and what is no pattern there.
_DIALECT = {"letters": r"^\p{Lu}\p{Ll}+\P{L}", "named": r"(?<user>[a-z0-9]+)@(?<host>[a-z]+)", "possessive": r"[a-z]++, [a-z]", "behind": r"(?<=[.]) [A-Z]", "open": r"(", "foreign": r"(?P<y>[a-z]+)"}


@query("match_regex_dialect", r"""SELECT doc_id, coalesce(regexp_matches(text, '^\p{Lu}\p{Ll}+\P{L}'), false) AS letters, coalesce(regexp_matches(text, '[a-z0-9]+@[a-z]+'), false) AS named,
  coalesce(regexp_matches(text, '[a-z], [a-z]'), false) AS possessive, coalesce(regexp_matches(text, '[.] [A-Z]'), false) AS behind, false AS open, false AS foreign FROM documents""")
def _(s, d):
    f = Field(F.lit("note"), F.col("text"))
    return t(s, d, "documents").select("doc_id", *(matchers.get("regex")(f, {"pattern": p}).alias(n) for n, p in _DIALECT.items()))


@query("match_icd10_range", "SELECT p_partkey, upper(code) >= 'B20' AND upper(code) <= 'B24' OR upper(code) >= 'X1' AS hit FROM (SELECT p_partkey, substr('ABCX', (p_partkey % 4 + 1)::INT, 1) || (p_partkey % 90 + 10) AS code FROM part)")
def _(s, d):
    code = F.concat(F.substr(F.lit("ABCX"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)), (F.col("p_partkey") % 90 + 10).cast("string"))
    hit = matchers.get("icd10_range")(Field(F.lit("icd"), code), {"ranges": [{"from": "b20", "to": "B.24"}, {"from": "X1"}]})
    return t(s, d, "part").select("p_partkey", hit.alias("hit"))


# -- classification ----------------------------------------------------------------------------------


def field_sql(c: Classifier, source: str, key: str, ids: bool = False) -> str:
    """Rules, suppression and level of (key, field, value) rows in SQL; with ``ids`` also all kept rules."""
    rules = sorted((r for r in c.rules if r.enabled), key=lambda r: -r.priority)

    def hit(r: Rule) -> str:
        return "(" + (" AND " if r.match_logic.upper() == "AND" else " OR ").join(hit_sql(m, "field", "value") for m in r.matchers) + ")"

    tags = ", ".join(f"CASE WHEN {hit(r)} THEN {{'id': {_q(r.id)}, 'level': '{r.level}', 'rank': {c.taxonomy.rank(r.level)}}} END" for r in rules)
    gone = []
    for down in (x for x in c.downgrades if x.force_suppress):
        words = " OR ".join(f"contains({p}, {_q(normalised_text(k))})" for k in down.keywords for p in (f"coalesce({plain_sql('value')}, '')", plain_sql("field")))
        exempt = ", ".join(_q(e) for e in down.exempt_rules) or "''"
        gone.append(f"(({words}) AND x.rank > {c.taxonomy.rank(down.max_force_suppress_level)} AND x.id NOT IN ({exempt}))")
    drop = " OR ".join(gone) or "false"
    return f"""WITH tagged AS (SELECT {key}, field, value, list_filter([{tags}], lambda x: x IS NOT NULL) AS tags FROM ({source}) src),
kept AS (SELECT {key}, field, value, tags, list_filter(tags, lambda x: NOT ({drop})) AS kept FROM tagged)
SELECT {key} AS record_id, field, len(kept)::INT AS n_tags, (len(tags) - len(kept))::INT AS n_suppressed, kept[1].id AS first_rule,
  coalesce(list_filter(kept, lambda x: x.rank = list_max(list_transform(kept, lambda y: y.rank)))[1].level, '{c.taxonomy.default_level}') AS final_level,
  coalesce(len(kept) > 1 AND list_max(list_transform(kept, lambda y: y.rank)) - list_min(list_transform(kept, lambda y: y.rank)) > 1, false) AS conflict{", list_transform(kept, lambda x: x.id) AS rule_ids" if ids else ""} FROM kept"""


def field_columns(c: Classifier, key: str, name, value) -> list:
    r = c.field(name, value)
    return [F.col(key).alias("record_id"), F.col("field"), r.alias("r")]


def _summary(df: DataFrame) -> DataFrame:
    return df.select("record_id", "field", F.size("r.tags").alias("n_tags"), F.size("r.suppressed").alias("n_suppressed"), F.get("r.tags", F.lit(0))["rule_id"].alias("first_rule"), "r.final_level", "r.conflict")


def _texts(s: SparkSession, d: str, field: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", F.lit(field).alias("field"), F.col("text").alias("value"))


for _name, _options, _field in (
    ("default", {}, "note"), ("general_pii", {"domain": "general-pii"}, "note"), ("medical", {"domain": "medical"}, "note"), ("medical_ops", {"domain": "medical"}, "bed_occupancy"),
    ("finance", {"domain": "finance"}, "note"), ("gd_health", {"domain": "gd_health"}, "note"), ("sc_health", {"domain": "sc_health_db51"}, "note"),
):
    _c = classify.build(**_options)
    query(f"classify_text_{_name}", field_sql(_c, f"SELECT doc_id, '{_field}' AS field, text AS value FROM documents", "doc_id"))(
        lambda s, d, c=_c, f=_field: _summary(_texts(s, d, f).select(*field_columns(c, "doc_id", F.col("field"), F.col("value"))))
    )

_FALLBACK = classify.build(profiles={})
query("classify_text_fallback", field_sql(_FALLBACK, _LONG_SQL, "c_custkey"))(
    lambda s, d: _summary(long_people(s, d).select(*field_columns(_FALLBACK, "c_custkey", F.col("field"), F.col("value"))))
)

_PII = classify.build("general-pii")


@query("classify_field", field_sql(_PII, _LONG_SQL, "c_custkey"))
def _(s, d):
    return _summary(long_people(s, d).select(*field_columns(_PII, "c_custkey", F.col("field"), F.col("value"))))


@query("classify_fields", f"SELECT record_id, field, final_level, CASE WHEN length(v) > 100 THEN substr(v, 1, 100) || '...' ELSE v END AS value FROM ({field_sql(_PII, _LONG_SQL, 'c_custkey')}) f JOIN (SELECT c_custkey AS record_id, field, value AS v FROM ({_LONG_SQL}) l) l USING (record_id, field)")
def _(s, d):
    return _PII.classify_fields(people(s, d, deal=True).select("c_custkey", *_LONG), "c_custkey").select("record_id", "field", "final_level", "value")


def _record_sql(c: Classifier, source: str, key: str, replace: str | None = None, extra: int = 0) -> str:
    level = f"'{replace}'" if replace else "coalesce(arg_max(final_level, rank * 1000 - pos), '" + c.taxonomy.default_level + "')"
    ranks = " ".join(f"WHEN '{x}' THEN {r}" for x, r in c.taxonomy.levels.items())
    order = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(_LONG))
    return f"SELECT record_id, {level} AS final_level, sum(n_tags)::BIGINT + {extra} AS n_tags FROM (SELECT *, CASE final_level {ranks} ELSE 0 END AS rank, CASE field {order} ELSE 99 END AS pos FROM ({field_sql(c, source, key)}) x) GROUP BY 1"


@query("classify_record", _record_sql(_PII, _LONG_SQL, "c_custkey"))
def _(s, d):
    return _PII.classify_records(people(s, d, deal=True).select("c_custkey", *_LONG), "c_custkey").select("record_id", "final_level", F.col("n_tags").cast("long").alias("n_tags"))


_NAMED = {"c_name": "name", "id_card": "idcard", "mobile_phone": "mobile"}
_NAMED_SQL = " UNION ALL ".join(f"SELECT c_custkey, '{b}' AS field, {a} AS value FROM {PEOPLE} p" for a, b in _NAMED.items())


def named_people(s: SparkSession, d: str) -> DataFrame:
    return people(s, d, deal=True).select("c_custkey", *(F.col(a).alias(b) for a, b in _NAMED.items()))


@query("classify_composite", _record_sql(_PII, _NAMED_SQL, "c_custkey", "L5", 1))
def _(s, d):
    return _PII.classify_records(named_people(s, d), "c_custkey").select("record_id", "final_level", F.col("n_tags").cast("long").alias("n_tags"))


@query("classify_table", f"SELECT count(*) AS records, arg_max(final_level, CASE final_level WHEN 'L5' THEN 5 WHEN 'L4' THEN 4 WHEN 'L3' THEN 3 WHEN 'L2' THEN 2 ELSE 1 END * 100000000 - record_id) AS final_level, 0.95::DOUBLE AS confidence, false AS needs_review, sum(n_tags)::BIGINT AS n_tags FROM ({_record_sql(_PII, _LONG_SQL, 'c_custkey')})")
def _(s, d):
    return _PII.classify_table(people(s, d, deal=True).select("c_custkey", *_LONG), "c_custkey")


@query("rule_hits", f"SELECT rule_id, count(*) AS hits FROM (SELECT unnest(rule_ids) AS rule_id FROM ({field_sql(_PII, _LONG_SQL, 'c_custkey', ids=True)})) GROUP BY 1")
def _(s, d):
    return params.rule_hit_counts(_PII.classify_fields(people(s, d, deal=True).select("c_custkey", *_LONG), "c_custkey"))


@query("level_rollup", f"SELECT final_level, count(*) AS fields FROM ({field_sql(_PII, _LONG_SQL, 'c_custkey')}) GROUP BY 1")
def _(s, d):
    c = _PII.classify_fields(people(s, d, deal=True).select("c_custkey", *_LONG), "c_custkey")
    return c.groupBy("final_level").agg(F.count("*").alias("fields"))


@query("ner_tags", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'L4' ELSE 'L3' END AS level, CASE WHEN lang = 'en' THEN 'PERSONAL_BASIC' ELSE lang END AS category FROM documents")
def _(s, d):
    e = F.array(F.struct(F.col("source").alias("text"), F.col("lang").alias("label"), F.lit(0.8).alias("score")))
    return t(s, d, "documents").select("doc_id", F.element_at(_PII.ner_tags(e, {"en": "L4:PERSONAL_BASIC"}), 1).alias("x")).select("doc_id", "x.level", "x.category")


def _coverage_sql() -> str:
    """A row for each rule pack that is listed."""
    arms = []
    for name in classify.list_domains():
        c = classify.build(name)
        arms.append(f"SELECT '{name}' AS domain, {len([r for r in c.rules if r.enabled])}::BIGINT AS rules, count(*) AS fields, count(*) FILTER (n_tags > 0) AS tagged FROM ({field_sql(c, _LONG_SQL, 'c_custkey')}) f")
    return " UNION ALL ".join(arms)


@query("catalogue", _coverage_sql())
def _(s, d):
    return classify.coverage(long_people(s, d).select("field", "value"))


# -- pipelines ---------------------------------------------------------------------------------------

_MED = classify.build("medical")
_MED_FIELDS = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS field, {c}::VARCHAR AS value FROM documents" for c in ("doc_id", "text", "source"))


@query("medical_pipeline", f"SELECT doc_id, {MASK_SQL['default']('text')} AS text, {MASK_SQL['default']('source')} AS source, l.final_level AS max_level FROM documents JOIN ({_record_sql(_MED, _MED_FIELDS, 'doc_id')}) l ON doc_id = record_id")
def _(s, d):
    return pipeline.medical_process(t(s, d, "documents").select("doc_id", "text", "source"))


@query("classify_record_medical", _record_sql(_MED, _MED_FIELDS, "doc_id"))
def _(s, d):
    return _MED.classify_records(t(s, d, "documents").select("doc_id", "text", "source"), "doc_id", ["doc_id", "text", "source"]).select("record_id", "final_level", F.col("n_tags").cast("long").alias("n_tags"))


@query("process_records", f"SELECT c_custkey, {MASK_SQL['name']('c_name')} AS c_name, {MASK_SQL['default']('c_mktsegment')} AS c_mktsegment FROM customer")
def _(s, d):
    return pipeline.process_records(t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), mask_l4=True, mask_l5=False)


@query("process_records_off", "SELECT c_custkey, c_name FROM customer")
def _(s, d):
    return pipeline.process_records(t(s, d, "customer").select("c_custkey", "c_name"), mask_l4=False, mask_l5=False)


# -- budget and parameters ---------------------------------------------------------------------------


# Orders as charges of 100 ledgers: eighths of epsilon, and a delta for two of three.
_CHARGES = """WITH RECURSIVE c AS (
  SELECT o_orderkey, o_custkey % 100 AS ns, (o_orderkey % 7 + 1) / 8.0::DOUBLE AS e, (o_orderkey % 3) / 1048576.0::DOUBLE AS d, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS i FROM orders
), w(ns, i, o_orderkey, accepted, e, d) AS (
  SELECT ns, 0::BIGINT, NULL::BIGINT, false, 0.0::DOUBLE, 0.0::DOUBLE FROM c WHERE i = 1
  UNION ALL SELECT c.ns, c.i, c.o_orderkey, f, CASE WHEN f THEN w.e + c.e ELSE w.e END, CASE WHEN f THEN w.d + c.d ELSE w.d END
  FROM w JOIN c ON c.ns = w.ns AND c.i = w.i + 1, LATERAL (SELECT w.e + c.e <= 10 AND w.d + c.d <= 0.0000457763671875 AS f)
)"""


def _replayed(s: SparkSession, d: str) -> DataFrame:
    charges = t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("ns"))
    return ledger.replay(charges, "ns", ["o_orderkey"], (F.col("o_orderkey") % 7 + 1) / 8, (F.col("o_orderkey") % 3) / (1 << 20), 10.0, 0.0000457763671875)


@query("budget_replay", f"{_CHARGES} SELECT o_orderkey, ns, accepted, e AS spent_epsilon, d AS spent_delta FROM w WHERE i > 0")
def _(s, d):
    return _replayed(s, d)


@query("budget_remaining", f"{_CHARGES} SELECT ns::VARCHAR AS namespace, 10 - max(e) AS epsilon, 0.0000457763671875::DOUBLE - max(d) AS delta, count(*) FILTER (NOT accepted AND i > 0) AS refused FROM w GROUP BY ns")
def _(s, d):
    left = _replayed(s, d).groupBy(F.col("ns").cast("string").alias("namespace"))
    return left.agg((10 - F.max("spent_epsilon")).alias("epsilon"), (0.0000457763671875 - F.max("spent_delta")).alias("delta"), F.count_if(~F.col("accepted")).alias("refused"))


# Requests of orders: by priority as namespace, with parameters of their own for some.
@query("param_resolve", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 4 - 1) / 2.0::DOUBLE WHEN o_orderpriority = '1-URGENT' THEN 2.0::DOUBLE ELSE 0.25::DOUBLE END AS epsilon,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 1e-6::DOUBLE ELSE 1e-5::DOUBLE END AS delta, CASE WHEN o_orderkey % 5 = 0 THEN 'laplace' ELSE 'gaussian' END AS mechanism,
  NOT (o_orderkey % 3 = 0 AND o_orderkey % 4 <= 1) AS valid FROM orders""")
def _(s, d):
    r = params.ParameterResolver({"primitives": {"dp": {"epsilon": 0.25, "mechanism": "gaussian"}}}, {"1-URGENT": {"dp": {"epsilon": 2.0}}, "2-HIGH": {"dp": {"delta": 1e-6}}})
    asked = {"epsilon": F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 4 - 1) / 2), "mechanism": F.when(F.col("o_orderkey") % 5 == 0, "laplace")}
    return r.resolve_rows(t(s, d, "orders"), "dp", asked, F.col("o_orderpriority")).select("o_orderkey", "params.*", "valid")


@query("recommend_params", "WITH v AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem) SELECT max(x) FILTER (WHERE r = floor(0.05 * n)) AS clip_lower, max(x) FILTER (WHERE r = ceil(0.95 * n) - 1) AS clip_upper, least(1e-5, 1 / (10.0 * max(n) * max(n)))::DOUBLE AS delta, 1.0::DOUBLE AS epsilon, 10::INT AS k, 10::INT AS max_depth FROM v")
def _(s, d):
    return params.recommend(t(s, d, "lineitem"), "l_extendedprice")


# -- ingest ------------------------------------------------------------------------------------------


@query("ingest_csv", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def _(s, d):
    path = _stage(s, t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "csv")
    return ingest.read_csv(s, path)


@query("ingest_json", "SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def _(s, d):
    path = _stage(s, t(s, d, "customer").select("c_name", "c_custkey"), "json")
    return ingest.read_json(s, path)


@query("process_file", f"SELECT {MASK_SQL['default']('k')} AS s_suppkey, {MASK_SQL['name']('s_name')} AS s_name FROM (SELECT s_suppkey::VARCHAR AS k, s_name FROM supplier)")
def _(s, d):
    # A folder of part files named like an upload.
    path = _stage(s, t(s, d, "supplier").select("s_suppkey", "s_name"), "csv")
    return ingest.process_file(s, path, "mask_dataframe", limit=None)


def _stage(s: SparkSession, df: DataFrame, kind: str) -> str:
    path = f"{shared_dir(s)}/veilframe/{uuid.uuid4().hex}.{kind}"
    ingest.write(df, path, kind)
    return path


# -- load statistics ---------------------------------------------------------------------------------


@query("round_robin", "SELECT node, count(*) AS n FROM (SELECT (event_id % 3)::INT AS node FROM events) GROUP BY 1")
def _(s, d):
    return t(s, d, "events").select(stats.round_robin(F.col("event_id"), 3).alias("node")).groupBy("node").agg(F.count("*").alias("n"))


@query("node_stats", "SELECT event_type AS node, count(*) AS count, sum((value < 20)::INT)::BIGINT AS ok, count(*) - sum((value < 20)::INT)::BIGINT AS fail, round(avg(value), 2) AS avg_ms, round(min(value), 2) AS min_ms, round(max(value), 2) AS max_ms FROM events GROUP BY 1")
def _(s, d):
    e = t(s, d, "events").withColumn("ok", F.col("value") < 20)
    return stats.node_stats(e, "event_type", "value", "ok")


@query("latency_percentiles", "SELECT count(value) AS n, round(count(value) / 60.0, 2)::DOUBLE AS qps, round(avg(value), 2) AS avg_ms, round(min(value), 2) AS min_ms, round(max(value), 2) AS max_ms, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, round(quantile_cont(value, 0.99), 2) AS p99 FROM events")
def _(s, d):
    return stats.concurrency_stats(t(s, d, "events"), "value", 60.0)


@query("bench_percentiles", "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events) SELECT share::DOUBLE AS share, value FROM v JOIN (SELECT unnest([0.5, 0.95, 0.99]) AS share) s ON r = floor(n * share::DOUBLE)")
def _(s, d):
    return stats.bench_percentiles(t(s, d, "events"), "value")


# -- intended semantics ------------------------------------------------------------------------------


# Names that no rule knows, so that only what is a card number by its digits is C4.
@query("intended_standard", f"SELECT c_custkey AS record_id, CASE WHEN {luhn_sql('bank_no')} THEN 'C4' ELSE 'C3' END AS final_level FROM {PEOPLE} p")
def _(s, d):
    c = classify.build(standard="jrt0197", semantics="intended")
    return c.classify_records(people(s, d, deal=True).select("c_custkey", F.col("bank_no").alias("ref"), F.col("c_mktsegment").alias("segment")), "c_custkey").select("record_id", "final_level")


@query("intended_icd10", "SELECT p_partkey, CASE WHEN code BETWEEN 'B20' AND 'B24' OR code BETWEEN 'A50' AND 'A64' OR code BETWEEN 'F20' AND 'F29' OR code BETWEEN 'C00' AND 'C97' THEN true ELSE false END AS hit FROM (SELECT p_partkey, substr('ABCF', (p_partkey % 4 + 1)::INT, 1) || (p_partkey % 90 + 10) AS code FROM part)")
def _(s, d):
    code = F.concat(F.substr(F.lit("ABCF"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)), (F.col("p_partkey") % 90 + 10).cast("string"), F.lit(".900"))
    rule = next(r for r in packs.MEDICAL.rules if r.id == "RULE_MED_ICD10")
    return t(s, d, "part").select("p_partkey", classify.build("medical", semantics="intended").rule_hits(rule, F.lit("icd"), code).alias("hit"))
