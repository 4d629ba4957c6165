import pytest
from pyspark.sql import functions as F

from veilframe import queries
from veilframe.plans import classify, loader, matchers, packs, params, pipeline
from veilframe.plans.budget import PrivacyError
from veilframe.plans.matchers import Field
from veilframe.plans.model import Downgrade, Matcher, Policy, Profile, Rule


def hit(spark, operator, value, params_=None, name="f", semantics="reference"):
    df = spark.createDataFrame([(name, value)], "n string, v string")
    return df.select(matchers.get(operator)(Field(F.col("n"), F.col("v"), semantics), params_ or {}).alias("h")).first()["h"]


@pytest.mark.parametrize(
    ("operator", "value", "params_", "want"),
    [
        ("regex", "abc", {"pattern": "B", "case_insensitive": "true"}, True), ("regex", "abc", {"pattern": "x" * 513}, False), ("regex", "abc", {"pattern": "("}, False), ("regex", None, {"pattern": "a"}, False),
        ("keyword_contains", "my ID-Card", {"keywords": ["id_card"]}, True), ("keyword_equals", "I D", {"keywords": ["i-d"]}, True),
        ("prefix", "BAM1", {"prefixes": ["BAM"]}, True), ("suffix", "x.vcf", {"suffixes": [".vcf"]}, True), ("length_range", "abc", {"min": "2", "max": "bad"}, True),
        ("id_card_checksum", "110101199001011237", {}, True), ("id_card_checksum", "11010119900101123x", {}, False), ("id_card_checksum", "1101", {}, False),
        ("luhn_checksum", "4111 1111 1111 1111", {}, True), ("luhn_checksum", "4111111111111112", {}, False), ("luhn_checksum", "18", {}, False), ("medical_card_checksum", "00000000", {}, True),
        ("icd10_range", "b24", {"ranges": [{"from": "B20", "to": "B24"}]}, True), ("icd10_range", "B24.1", {"ranges": [{"from": "B20", "to": "B24"}]}, False), ("icd10_range", "B22", {"intervals": [{"start": "B20", "end": "B24"}]}, False),
        ("date_range", "on 2024-01-02", {}, True), ("value_range", "0", {}, False), ("value_range", "-1", {"min": -5}, True), ("value_range", "NaN", {}, False), ("value_range", "x", {}, False),
        ("contains_digit_ratio", "a1", {}, True), ("contains_digit_ratio", "", {}, False), ("field_name_match", "", {"patterns": ["^F$"]}, True), ("field_name_match", "", {"patterns": ["f("]}, False),
    ],
)
def test_matchers(spark, operator, value, params_, want):
    assert hit(spark, operator, value, params_) is want


def test_traps(spark):
    # The declared target is not read: a name keyword tests the value unless fields say so.
    assert hit(spark, "keyword_contains", "x", {"keywords": ["phone"]}, name="phone") is False
    assert hit(spark, "keyword_contains", "x", {"keywords": ["phone"], "fields": ["name"]}, name="phone") is True
    assert hit(spark, "value_range", "0", {}, semantics="intended") is True
    assert hit(spark, "icd10_range", "B22.9", {"intervals": [{"start": "B20", "end": "B24"}]}, semantics="intended") is True
    with pytest.raises(PrivacyError):
        classify.build(standard="jrt0197")
    assert classify.build(standard="jrt0197", semantics="intended").taxonomy.default_level == "C3"
    assert classify.build("finance").taxonomy.rank("C4") == 0
    with pytest.raises(PrivacyError):
        classify.build("../etc")
    # Unregistered operators miss; composites need whole-word names and a domain.
    assert classify.build("medical").composite_level(["diagnosis_name", "gene_x"]) is None
    assert classify.build("medical").composite_level(["diagnosis", "gene"]) == "L5"
    assert classify.build().composite_level(["name", "idcard", "mobile"]) is None


def test_field_goldens(spark):
    r = classify.dry_run("mobile_phone", "13800138000", spark, domain="general-pii")
    assert r["final_level"] == "L3" and r["tags"][0]["rule_id"] == "RULE_PII_PHONE" and r["confidence"] == 0.95 and r["engine_layer"] == "rule" and not r["needs_review"]
    assert classify.dry_run("note", None, spark)["final_level"] == "L1"
    assert classify.dry_run("note", "x" * 101, spark)["value"] == "x" * 100 + "..."
    assert classify.dry_run("d", "HIV positive", spark, domain="medical")["final_level"] == "L5"
    # An operational name strips what ranks above the cap, whatever evidence the value holds.
    r = classify.dry_run("inventory", "HIV positive", spark, domain="medical")
    assert r["final_level"] == "L1" and {t["level"] for t in r["suppressed"]} == {"L4", "L5"}
    r = classify.dry_run("inventory", "HIV positive", spark, domain="medical", semantics="intended")
    assert r["final_level"] == "L5"


def test_engine(spark):
    rules = (
        Rule("low", "L1", "a", 1, (Matcher("prefix", {"prefixes": ("x",)}),)), Rule("off", "L5", "a", 9, (Matcher("prefix", {"prefixes": ("x",)}),), enabled=False),
        Rule("both", "L4", None, 5, (Matcher("prefix", {"prefixes": ("x",)}), Matcher("suffix", {"suffixes": ("y",)})), "AND"), Rule("none", "L5", "a", 8, ()), Rule("odd", "L5", "a", 8, (Matcher("nope"),)),
    )
    p = Profile("p", rules, (Downgrade("d", (), "L1", "c", True, "L3", ("bo?h",)), Downgrade("e", ("zz",), "L1", "c", True, "")))
    out = classify.dry_run("f", "xy", spark, domain="p", profiles={"p": p})
    assert [t["rule_id"] for t in out["tags"]] == ["both", "low"] and out["tags"][0]["category"] == "unknown" and out["conflict"] and out["final_level"] == "L4"
    assert classify.dry_run("f", "xyzz", spark, domain="p", profiles={"p": p})["tags"] == []
    matchers.register("always", lambda f, p: F.lit(True))
    assert matchers.has("always") and "always" in matchers.names()
    del matchers.REGISTRY["always"]


def test_records(spark):
    df = spark.createDataFrame([(1, "张三", "110101199001011237", "13800138000"), (2, "x", "y", "z")], "id long, name string, id_card string, phone string")
    got = {r["record_id"]: r["final_level"] for r in classify.build().classify_records(df, "id").collect()}
    assert got == {1: "L3", 2: "L1"}
    table = classify.build().classify_table(df, "id").first()
    assert (table["records"], table["final_level"], table["n_tags"]) == (2, "L3", 2)
    llm = lambda rows: rows.select("record_id", "field", F.lit("L4").alias("level"))
    c = classify.build(policy=Policy(enable_llm=True))
    assert c.classify_fields(df, "id", llm=llm).filter("engine_layer = 'llm'").count() == 0  # never asked: rules are sure
    c = classify.build(policy=Policy(enable_llm=True), semantics="intended")
    assert c.classify_fields(df.withColumn("zz", F.lit("y")), "id", ["zz"], llm=llm).filter("engine_layer = 'llm'").count() == 2


def test_pipelines(spark):
    df = spark.createDataFrame([("张三丰", "hiv"), ("李四", "flu")], "name string, diagnosis string")
    got = [tuple(r) for r in pipeline.medical_process(df).orderBy("name").collect()]
    assert ("张**丰", "hiv", "L5") in got and ("李*", "flu", "L1") in got
    assert pipeline.process_records(df, False, False).collect() == df.collect()
    kept = pipeline.process_records(df, True, True, semantics="intended").collect()
    assert [r["name"] for r in kept] == ["张**丰", "李四"]


def test_medical_query_reads_every_field(spark, tmp_path):
    spark.createDataFrame([(1, "flu", "hiv ward"), (2, "hiv", "ward"), (3, "flu", "ward"), (4, None, None)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["medical_pipeline"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["max_level"] for r in got} == {1: "L5", 2: "L5", 3: "L1", 4: "L1"}


def test_params(spark, tmp_path):
    r = params.ParameterResolver.load(str(tmp_path / "p.json"))
    r.save("dp", {"epsilon": 0.3})
    assert params.ParameterResolver.load(str(tmp_path / "p.json")).resolve("dp")["epsilon"] == 0.3
    for primitive, bad in (("dp", {"epsilon": 0}), ("k_anonymity", {"k": 1}), ("classification", {"default_level": "high"})):
        with pytest.raises(PrivacyError):
            r.resolve(primitive, bad)
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert tuple(params.recommend(df, "v", 2).first()) == (1.0, 10.0, 1e-5, 1.0, 2, 10)
    assert tuple(params.recommend(df.filter("v = 3"), "v").first())[:2] == (2.0, 4.0)
    m = params.Metrics()
    m.count("mask")
    m.timed("mask", 0.5)
    assert m.snapshot()["counters"] == {"mask": 1}


def test_patterns_are_the_engines_own(spark):
    """What Spark's own dialect accepts counts, not Python's."""
    for value, pattern, want in (
        ("Zoë", r"^\p{L}+$", True), ("Z0", r"^\p{L}+$", False), ("y2024", r"(?<y>\d{4})", True), ("aaab", "a++b", True), ("aaa", "a++a", False), ("x1", r"(?<=x)\d", True),
        ("x", "(?P<y>x)", False), ("x", "(", False), ("x", "[", False), ("X", "x", False),
    ):
        assert hit(spark, "regex", value, {"pattern": pattern}) is want, pattern
        assert hit(spark, "date_range", value, {"pattern": pattern}) is want
    assert hit(spark, "field_name_match", "", {"patterns": ["(?P<f"]}, name="x(?p<F>") is True
    c = classify.build("medical")
    assert c.suppressible(Downgrade("d", (), "L1", "c", True, "L3", ("RULE_MED_G_[0-9]*", "RULE_MED_SE?"))) == [r.id for r in c.rules if r.id != "RULE_MED_SEQ"]


def test_rule_hits_count_every_tag(spark):
    df = spark.createDataFrame([(1, "13000000001"), (2, "18300000002"), (3, "x")], "id long, mobile string")
    c = classify.build("general-pii")
    own = c.classify_fields(df, "id")
    want = {"RULE_PII_PHONE": 2, "RULE_PII_MEDICAL_CARD": sum(int(r["h"]) for r in df.select(matchers.get("medical_card_checksum")(Field(F.lit("m"), F.col("mobile")), {}).alias("h")).collect())}
    got = {r["rule_id"]: r["hits"] for r in params.rule_hit_counts(own).collect()}
    assert got == {k: v for k, v in want.items() if v}
    m = params.Metrics()
    watched, add = m.watch(own, ["RULE_PII_PHONE", "RULE_PII_NAME"])
    assert watched.count() == 3
    add()
    assert m.counters["fields"] == 3 and m.counters["rule:RULE_PII_PHONE"] == 2 and m.counters["rule:RULE_PII_NAME"] == 0 and m.counters["needs_review"] == 0
    assert "audit_timestamp" in classify.audited(own).columns


def test_rule_store(spark, tmp_path):
    """The bundled packs go through files and come back the same; own packs load, reload, and stay inside."""
    store = loader.write_bundled(str(tmp_path / "rules"))
    assert {n: store.profile(n) for n in store.names("domains")} == packs.PROFILES
    assert {n: store.taxonomy(n) for n in store.names("taxonomies")} == packs.TAXONOMIES
    assert {n: store.standard(n) for n in store.names("standards")} == packs.STANDARDS
    for options in ({}, {"domain": "medical"}, {"domain": "finance"}):
        assert store.classifier(**options) == classify.build(**options)
        wise = loader.RuleStore(str(tmp_path / "rules"), "intended")
        assert wise.classifier(**options) == classify.build(**options, semantics="intended")
    assert wise.classifier(standard="jrt0197") == classify.build(standard="jrt0197", semantics="intended")
    with pytest.raises(PrivacyError):
        store.classifier(standard="jrt0197")  # as shipped, taxonomies don't parse
    own = Profile("own", (Rule("R", "L4", "c", 1, (Matcher("prefix", {"prefixes": ("x",)}),)),))
    store.write(own)
    df = spark.createDataFrame([(1, "xy")], "id long, f string")
    assert store.classifier("own").classify_records(df, "id").first()["final_level"] == "L4"
    path = tmp_path / "rules" / "domains" / "own.json"
    path.write_text(path.read_text().replace('"L4"', '"L5"'))
    assert store.classifier("own").classify_records(df, "id").first()["final_level"] == "L4"
    store.reload()
    assert store.classifier("own").classify_records(df, "id").first()["final_level"] == "L5"
    for bad in ("../own", "a/b", "a\\b", "", "nope"):
        with pytest.raises(PrivacyError):
            store.profile(bad)
    (tmp_path / "secret.json").write_text("{}")
    (tmp_path / "rules" / "domains" / "link.json").symlink_to(tmp_path / "secret.json")
    with pytest.raises(PrivacyError):
        store.profile("link")
    (tmp_path / "rules" / "domains" / "list.json").write_text("[]")
    with pytest.raises(PrivacyError):
        store.profile("list")
    pytest.importorskip("yaml")
    (tmp_path / "rules" / "domains" / "y.yaml").write_text("domain: y\nunknown: 1\nrules:\n  - id: R\n    level: L2\n    matchers:\n      - operator: regex\n        params: {pattern: '^a'}\n")
    assert store.profile("y") == Profile("y", (Rule("R", "L2", None, 50, (Matcher("regex", {"pattern": "^a"}),)),))


# -- coverage of all packs: same judgement as the tags, rows of one row group over many tasks ------------------------------


@pytest.mark.parametrize("semantics", ["reference", "intended"])
def test_coverage_judges_as_the_tags_do(spark, semantics):
    values = ["HIV positive", "库存 hiv", "inventory: hiv", "110101199001011237", "13800138000", "12345674", "4111 1111 1111 1111", "a@mail.example", "患者姓名", "xx身份证", "é身份证", "face-id", "plain", "", None]
    rows = spark.createDataFrame([(n, v) for n in ("note", "inventory", "id_card", "门诊量") for v in values], "field string, value string")
    got = {r["domain"]: (r["fields"], r["tagged"]) for r in classify.coverage(rows, semantics=semantics).collect()}
    assert set(got) == set(classify.list_domains())
    for name, found in got.items():
        c = classify.build(name, semantics=semantics)
        kept = rows.select(F.size(c.kept_tags(F.col("field"), F.col("value"))).alias("n"))
        assert found == (rows.count(), kept.filter("n > 0").count())


def test_coverage_with_packs_changed_to_suppress(spark, monkeypatch):
    down = Downgrade("d", ("stock",), "L1", "x", True, "L3", ("KEEP*",))
    rules = tuple(Rule(i, level, "c", p, (Matcher("keyword_contains", {"keywords": (w,)}),)) for i, level, p, w in (("HIGH", "L5", 3, "hiv"), ("KEEP_1", "L5", 2, "gene"), ("LOW", "L2", 1, "名"), ("OFF", "L2", 1, "hiv")))
    pack = Profile("own", (*rules[:3], Rule("OFF", "L2", "c", 9, rules[3].matchers, enabled=False)), (down,))
    monkeypatch.setitem(packs.PROFILES, "own", pack)
    rows = spark.createDataFrame([("n", "hiv"), ("n", "hiv stock"), ("stock", "hiv"), ("stock", "gene"), ("stock", "名"), ("stock", "x")], "field string, value string")
    assert [tuple(r) for r in classify.coverage(rows, ["own"]).collect()] == [("own", 3, 6, 3)]
    monkeypatch.setitem(packs.PROFILES, "own", Profile("own", (), ()))
    assert [tuple(r) for r in classify.coverage(rows, ["own"]).collect()] == [("own", 0, 6, 0)]


def test_customers_of_one_row_group_are_judged_by_many_tasks(spark):
    read = queries.long_people(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p"), "field")
    held = [r["n"] for r in read.groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert len(held) >= 4 and max(held) <= 2 * min(held)
