import http.server
import json
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.client import PrivacyClient
from veilframe.functions.noise import HashNoise
from veilframe.operators import dp
from veilframe.plans import classify, endpoint, packs, params
from veilframe.plans.budget import BudgetAccountant, BudgetExhausted
from veilframe.plans.model import Policy
from veilframe.sources import samples


@pytest.fixture
def client():
    BudgetAccountant.reset("client")
    return PrivacyClient("client", 20.0, 1e-3, HashNoise("c"))


def test_every_release_is_charged(spark, client):
    df = spark.createDataFrame([("a", float(i), [float(i), 1.0], ["x"]) for i in range(20)], "g string, v double, e array<double>, c array<string>")
    one = df.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    calls = [
        lambda: client.dp_count(df, "v"), lambda: client.dp_sum(df, "v", lower=0, upper=20), lambda: client.dp_mean(df, "v", lower=0, upper=20), lambda: client.dp_histogram(df, "g", ["a", "b"]),
        lambda: client.dp_noisy_count(one, F.col("n"), F.col("g")), lambda: client.dp_noisy_sum(one, F.col("s"), 20.0, F.col("g")), lambda: client.dp_noisy_mean(one, F.col("s"), F.col("n"), 20.0),
        lambda: client.dp_noisy_histogram(one.select(F.col("g").alias("bucket"), F.col("n").alias("value"))), lambda: client.dp_chunked_count(df, "e"), lambda: client.dp_chunked_sum(df, "e", lower=0, upper=20),
        lambda: client.dp_chunked_mean(df, "e", lower=0, upper=20), lambda: client.dp_chunked_histogram(df, "c", ["x"]), lambda: client.dp_vector_sum(df, "e"), lambda: client.dp_vector_mean(df, "e"),
        lambda: client.dp_group_by(df, "g", "v", lower=0, upper=20), lambda: client.dp_aggregate(df, {"v": ("count", {})}),
    ]
    for i, call in enumerate(calls, 1):
        assert call().count() >= 1
        assert client.remaining_budget()["epsilon"] == pytest.approx(20 - i)
    assert client.metrics.snapshot()["counters"]["epsilon"] == len(calls)
    assert client.dp_chunked_mean(df.limit(1), "e").first()["value"] == 0
    assert client.dp_adaptive_clip(df, "v")[0] == 0.0
    assert client.health()["epsilon"] == pytest.approx(4)
    with pytest.raises(BudgetExhausted):
        client.dp_count(df, "v", 5.0)


def test_what_draws_nothing_costs_nothing(spark, client):
    """Empty tables are free; a vector mean whose count is too small is charged for the count alone."""
    df = spark.createDataFrame([([3.0, 4.0],), ([1.0],), (None,)], "e array<double>")
    none = df.filter("e IS NULL")
    assert client.dp_mean(spark.createDataFrame([], "v double"), "v", lower=0, upper=1).first()["value"] == 0
    assert client.dp_vector_sum(none, "e").count() == client.dp_vector_mean(none, "e").count() == 0
    assert client.remaining_budget() == {"epsilon": 20.0, "delta": 1e-3}
    assert [(r["pos"], r["value"]) for r in client.dp_vector_mean(df, "e", 10.0, 2.0, min_count=1000).collect()] == [(0, 0.0), (1, 0.0)]
    assert client.remaining_budget()["epsilon"] == 19.0 and client.remaining_budget()["delta"] == pytest.approx(1e-3 - 5e-6)
    assert client.dp_vector_mean(df, "e", 10.0, 2.0, min_count=0).count() in (0, 2) and client.remaining_budget()["epsilon"] in (17.0, 18.0)
    with pytest.raises(BudgetExhausted):
        client.dp_vector_sum(df, "e", epsilon=30.0)
    assert client.metrics.counters["budget_exhausted"] == client.ledger.refused == 1 and client.metrics.seconds["dp_vector_mean"]
    exact = dp.vector_sum(df, "e", 10.0, 1e9).orderBy("pos").collect()
    assert [round(r["value"], 3) for r in exact] == [4.0, 4.0]  # a shorter vector ends in zeros


def test_every_sample_runs(spark):
    BudgetAccountant.reset("samples")
    c = PrivacyClient("samples", 1000.0, 1.0, HashNoise("c"))
    offered = {n for n in dir(c) if not n.startswith("_") and callable(getattr(c, n))}
    for name in samples.CATALOGUE:
        assert samples.run(c, spark, name).count() >= 0 and (name in offered or name.startswith("ldp_") or name.startswith("classify_"))
    got = samples.run(c, spark, "mask").first()
    assert got["masked"] == "a***@example.com"
    assert samples.run(c, spark, "ldp_binary").first()[0] == pytest.approx(0.716395, abs=1e-5)


def test_layers(spark):
    df = spark.createDataFrame([(1, "zz"), (2, "13800138000")], "id long, q string")
    ner = lambda rows: rows.select("record_id", "field", F.array(F.struct(F.col("value").alias("text"), F.lit("DISEASE").alias("label"), F.lit(0.9).alias("score"))).alias("entities"))
    c = classify.build("general-pii", policy=Policy(enable_ner=True))
    got = {r["record_id"]: (r["final_level"], r["engine_layer"]) for r in c.classify_fields(df, "id", ner=ner, ner_mapping={"DISEASE": "L4:MEDICAL"}).collect()}
    assert got == {1: ("L4", "ner"), 2: ("L3", "rule")}
    assert {r["engine_layer"] for r in classify.build("general-pii").classify_fields(df, "id", ner=ner).collect()} == {"rule"}
    assert classify.arbitrate(c.taxonomy, "L3", "L5") == "L5" and classify.arbitrate(c.taxonomy, "L3", "X") == "L3" and classify.arbitrate(c.taxonomy, "L4", "L2") == "L4"


def test_profiles(tmp_path):
    assert params.load_profile(str(tmp_path / "none.json")) == {}
    (tmp_path / "p.json").write_text('{"namespace": "n", "budget": {"epsilon": 3}}')
    assert params.profile_namespace(params.load_profile(str(tmp_path / "p.json"))) == ("n", 3.0, 1e-4)


def test_personalised_parameters(tmp_path, monkeypatch):
    """Kept by namespace, in the file that the environment names."""
    monkeypatch.setenv(params.PERSONALISED, str(tmp_path / "own.json"))
    r = params.ParameterResolver.load()
    r.save("dp", {"epsilon": 0.3}, "team")
    r.save("dp", {"mechanism": "gaussian"}, "team")
    again = params.ParameterResolver.load()
    assert again.resolve("dp", context=params.Context("team"))["epsilon"] == 0.3 and again.resolve("dp", context=params.Context("team"))["mechanism"] == "gaussian"
    assert again.resolve("dp")["epsilon"] == 1.0 and again.resolve("dp", {"epsilon": 2.0}, params.Context("team"))["epsilon"] == 2.0
    yaml = pytest.importorskip("yaml")
    y = params.ParameterResolver(path=str(tmp_path / "own.yaml"))
    y.save("qol", {"num_dummies": 5})
    assert yaml.safe_load((tmp_path / "own.yaml").read_text()) == {"default": {"qol": {"num_dummies": 5}}}
    assert params.ParameterResolver.load(str(tmp_path / "own.yaml")).resolve("qol") == {"num_dummies": 5}


class Answers(http.server.BaseHTTPRequestHandler):
    asked: list[str] = []
    failures: dict[str, int] = {}

    def do_POST(self):  # noqa: N802
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
        self.asked.append(asked)
        if "moved" in asked:
            self.send_response(302)
            self.send_header("Location", f"http://{self.headers['Host']}/secret")
            self.end_headers()
            return
        left = next((k for k, n in self.failures.items() if k in asked and n), None)
        if left:
            self.failures[left] -= 1
        self.send_response(503 if left else 500 if "broken" in asked else 200)
        self.end_headers()
        level = "l4" if "secret" in asked else "L9"
        self.wfile.write(json.dumps({"choices": [{"message": {"content": "Here: " + json.dumps({"level": level, "why": {}}) + " done"}}]}).encode())

    def log_message(self, *a):
        pass


@pytest.fixture
def answers(monkeypatch):
    monkeypatch.setattr(endpoint, "PAUSE", 0.01)
    Answers.asked.clear()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_http_model(spark, answers):
    """Asked for open rows only; unknown levels, failures and redirects change nothing."""
    c = classify.build("general-pii", semantics="intended", policy=Policy(enable_llm=True))
    model = endpoint.HttpModel(answers, c.taxonomy, attempts=2, tasks=2)
    df = spark.createDataFrame([(1, "secret"), (2, "13800138000"), (3, "plain"), (4, "broken secret"), (5, None), (6, "moved secret")], "id long, zz string")
    got = {r["record_id"]: (r["final_level"], r["engine_layer"]) for r in c.classify_fields(df, "id", llm=model).collect()}
    assert got[1] == ("L4", "llm") and got[2] == ("L3", "rule") and {got[i][1] for i in (3, 4, 5, 6)} == {"rule"}
    assert sum("broken" in a for a in Answers.asked) == 2 and sum("moved" in a for a in Answers.asked) == 1
    assert model.ask("zz", "secret") == "L4" and endpoint.HttpModel("http://127.0.0.1:9/", c.taxonomy, attempts=1).ask("zz", "secret") is None
    for bad in ("ftp://x", "http://169.254.169.254/", "", None, "http://", "http://x:99999/"):
        assert not endpoint.allowed(bad)


def test_a_question_is_asked_once(spark, answers, tmp_path):
    """However many rows share it, tasks run again or later runs ask it; failures are repeated and asked anew."""
    taxonomy = packs.TAXONOMIES["default"]
    Answers.failures.update(late=2, never=10**6)
    model = endpoint.HttpModel(answers, taxonomy, attempts=3, tasks=3, answers=str(tmp_path / "kept"))
    values = ["secret one"] * 400 + ["secret late", "plain", "never secret", "x" * 99 + "yz", "x" * 99 + "yw", None, ""]
    rows = spark.createDataFrame([(i, "f", v) for i, v in enumerate(values)], "record_id long, field string, value string").repartition(5)
    level = lambda df: {values[r["record_id"]]: r["level"] for r in df.collect()}
    got = level(model(rows))
    assert got["secret one"] == got["secret late"] == "L4" and got["plain"] is None and "never secret" not in got
    count = lambda text: sum(f'holds "{text}"' in a for a in Answers.asked)
    assert (count("secret one"), count("secret late"), count("never secret"), count("x" * 99 + "y..."), count("")) == (1, 3, 3, 1, 1)
    assert "L3 (敏感数据)" in Answers.asked[0] and got["x" * 99 + "yz"] is None
    Answers.failures.clear()
    assert level(model(rows))["never secret"] == "L4" and len(Answers.asked) == 11 and count("never secret") == 4
    # A task that fails after its answers came finds them when it runs again.
    folder = str(tmp_path / "lost")
    plain = endpoint.HttpModel(answers, taxonomy, tasks=1, answers=folder)
    batch = pa.record_batch([pa.array(["k1", "k2"]), pa.array(["f", "f"]), pa.array(["secret a", "secret b"])], ["key", "field", "value"])
    Answers.asked.clear()
    questions = spark.createDataFrame([("k1", "f", "secret a"), ("k2", "f", "secret b")], "key string, field string, value string").coalesce(1)

    def dies(batches):
        yield from plain._asked(folder)(batches)
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        questions.mapInArrow(dies, "key string, level string").collect()
    assert len(Answers.asked) == 2 == batch.num_rows
    assert sorted(map(tuple, questions.mapInArrow(plain._asked(folder), "key string, level string").collect())) == [("k1", "L4"), ("k2", "L4")] and len(Answers.asked) == 2


def test_levels_are_read_from_answers():
    m = endpoint.HttpModel("http://x/", packs.TAXONOMIES["gd_health"])
    say = lambda content: json.dumps({"choices": [{"message": {"content": content}}]})
    assert m.level_of(say('{"level": "g2"}')) == m.level_of('{"level": " G2 "}') == m.level_of(say('so {"level":"G2"} it is')) == "G2"
    for bad in ("", "x", "[]", "{}", say("G2"), say('{"level": "L2"}'), say('{"lev'), say('{"level": null}'), '{"choices": []}', '{"choices": 5}'):
        assert m.level_of(bad) is None
