"""Parameter resolution, recommendation and driver-side metrics."""

from __future__ import annotations

import json
import math
import os
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veilframe.operators.stats import ranked_values
from veilframe.plans.budget import PrivacyError

# Defaults of each primitive.
DEFAULTS: dict[str, dict] = {
    "dp": {"epsilon": 1.0, "delta": 1e-5, "mechanism": "laplace"},
    "k_anonymity": {"k": 5, "l": 2, "t": 0.2, "max_depth": 10},
    "sanitization": {"engine": "mask"},
    "qol": {"num_dummies": 3},
    "classification": {
        "version": "1.0.0", "default_level": "L3", "enable_rule_engine": True, "enable_small_ner": False, "enable_llm": False,
        "icd10_l4_intervals": [{"start": "B20", "end": "B24"}, {"start": "F20", "end": "F29"}, {"start": "C00", "end": "C97"}],
        "genomic_keywords": ["brca1", "brca2", "tp53", "rs", "snp", "cnv", "genome", "genomic", "gene", "mutation", "variant"],
        "public_field_whitelist": ["public_report", "annual_summary", "科普"],
        "operational_field_patterns": ["turnover_rate", "device_usage", "inventory"], "manual_override": {},
    },
}


@dataclass
class Context:
    namespace: str = "default"
    project_id: str | None = None
    user_role: str | None = None
    purpose: str | None = None
    sensitivity_tags: tuple[str, ...] = ()


#: Names the file of personalised parameters where no path is given.
PERSONALISED = "PRIVACY_PERSONALIZED_PROFILE"


@dataclass
class ParameterResolver:
    """Later layers win: defaults, template, profile, personalised, request. Personalised parameters are
    those of the context's namespace: {namespace: {primitive: {name: value}}}."""

    profile: dict = field(default_factory=dict)
    personalised: dict[str, dict[str, dict]] = field(default_factory=dict)
    path: str | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def resolve(self, primitive: str, request: dict | None = None, context: Context | None = None, template: dict | None = None) -> dict:
        out = dict(DEFAULTS.get(primitive, {}))
        own = self.personalised.get((context and context.namespace) or "default", {}).get(primitive)
        for layer in (template, self.profile.get("primitives", {}).get(primitive), own, request):
            out |= layer or {}
        validate(primitive, out)
        return out

    def resolve_rows(self, requests: DataFrame, primitive: str, asked: dict[str, Column], namespace: Column | None = None, template: dict | None = None) -> DataFrame:
        """``requests`` with ``params``, a struct of the parameters that ``resolve`` would give each row, and ``valid``,
        whether it would accept them. ``asked``: the row's own parameters, null where it has none; ``namespace``: whose
        personalised parameters apply. Parameters that are no scalars are left out."""
        layers = [DEFAULTS.get(primitive, {}), template or {}, self.profile.get("primitives", {}).get(primitive, {})]
        own = {ns: found[primitive] for ns, found in self.personalised.items() if primitive in found}
        names = [n for n in dict.fromkeys(k for layer in (*layers, *own.values(), asked) for k in layer)]
        out = []
        for n in names:
            fixed = next((layer[n] for layer in reversed(layers) if n in layer), None)
            if isinstance(fixed, list | dict):
                continue
            value = F.lit(fixed)
            for ns, found in own.items():
                if n in found:
                    value = F.when(F.coalesce(namespace if namespace is not None else F.lit("default"), F.lit("default")) == ns, F.lit(found[n])).otherwise(value)
            out.append((F.coalesce(asked[n], value) if n in asked else value).alias(n))
        checks = {"dp": ("epsilon", lambda c: c > 0), "k_anonymity": ("k", lambda c: c >= 2), "classification": ("default_level", lambda c: c.rlike("^L[0-9]+$"))}
        field, holds = checks.get(primitive, (None, None))
        told = requests.withColumn("params", F.struct(*out))
        return told.withColumn("valid", F.coalesce(holds(F.col(f"params.{field}")), F.lit(False)) if field else F.lit(True))

    def save(self, primitive: str, params: dict, namespace: str = "default") -> None:
        """Add personalised parameters to those of a namespace, and to the file if there is one, which is
        replaced as a whole."""
        with self._lock:
            self.personalised.setdefault(namespace, {}).setdefault(primitive, {}).update(params)
            if self.path:
                p = Path(self.path)
                fresh = p.with_name(f"{p.name}.{uuid.uuid4().hex}")
                fresh.write_text(_written(p, self.personalised), encoding="utf-8")
                fresh.replace(p)

    @classmethod
    def load(cls, path: str | None = None, profile: dict | None = None) -> ParameterResolver:
        """From a JSON or YAML file, by default the one that ``PERSONALISED`` names. A missing file is an empty
        set of parameters."""
        path = path or os.environ.get(PERSONALISED)
        return cls(profile or {}, load_profile(path) if path else {}, path)


def _written(path: Path, found: dict) -> str:
    if path.suffix == ".json":
        return json.dumps(found, indent=2, sort_keys=True)
    return _yaml().safe_dump(found, allow_unicode=True)


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise PrivacyError("YAML files need PyYAML; use JSON") from e
    return yaml


def load_profile(path: str) -> dict:
    """A profile file, JSON or YAML where PyYAML is installed; a missing file is an empty profile."""
    p = Path(path)
    if not p.exists():
        return {}
    text = p.read_text(encoding="utf-8")
    return (json.loads(text) if p.suffix == ".json" else _yaml().safe_load(text)) or {}


def profile_namespace(profile: dict) -> tuple[str, float, float]:
    """Namespace and totals that a profile asks for."""
    b = profile.get("budget", {})
    return profile.get("namespace", "default"), float(b.get("epsilon", 10.0)), float(b.get("delta", 1e-4))


def validate(primitive: str, params: dict) -> None:
    if primitive == "dp" and not params.get("epsilon", 0) > 0:
        raise PrivacyError("epsilon must be positive")
    if primitive == "k_anonymity" and params.get("k", 0) < 2:
        raise PrivacyError("k must be at least 2")
    if primitive == "classification":
        level = str(params.get("default_level", "L3"))
        if not (level[:1] == "L" and level[1:].isascii() and level[1:].isdigit()):
            raise PrivacyError("default_level must be L and a number")


def recommend(df: DataFrame, column: str, records: int | None = None) -> DataFrame:
    """(clip_lower, clip_upper, delta, epsilon, k, max_depth) in one row.

    The clip bounds are the values at ranks floor(0.05 n) and ceil(0.95 n) - 1: exact order statistics,
    not interpolated percentiles. Equal or missing bounds are widened by 1. k is a tenth of ``records``
    within 2..10, delta 1/(10 n^2) within 1e-5.
    """
    n = df.filter(F.col(column).isNotNull()).count()
    if not n:
        lo = hi = 0.0
    else:
        low, high = math.floor(0.05 * n), max(0, math.ceil(0.95 * n) - 1)
        got = {r["rank"]: float(r["value"]) for r in ranked_values(df, column, F.array_distinct(F.array(F.lit(low), F.lit(high)))).collect()}
        lo, hi = got[low], got[high]
    if math.isnan(lo) or math.isnan(hi) or lo == hi:
        lo, hi = (0.0 if math.isnan(lo) else lo) - 1, (0.0 if math.isnan(hi) else hi) + 1
    k = max(2, min(10, (n if records is None else records) // 10))
    row = (lo, hi, min(1e-5, 1 / (10 * n * n)) if n else 1e-5, 1.0, k, 10)
    return df.sparkSession.createDataFrame([row], "clip_lower double, clip_upper double, delta double, epsilon double, k int, max_depth int")


@dataclass
class Metrics:
    """Counters of the driver: operations, budget spent and refused, classifications and rule hits. What jobs
    count is added when they end (``watch``, or ``listeners.listen`` for all jobs and streams)."""

    counters: Counter = field(default_factory=Counter)
    seconds: dict[str, list[float]] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def count(self, name: str, by: float = 1) -> None:
        with self._lock:
            self.counters[name] += by

    def timed(self, name: str, value: float) -> None:
        with self._lock:
            self.seconds.setdefault(name, []).append(value)

    @contextmanager
    def timer(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timed(name, time.perf_counter() - began)

    def watch(self, classified: DataFrame, rules: list[str]) -> tuple[DataFrame, Callable[[], None]]:
        """Classified fields that count themselves as some job reads them, without a pass of their own: fields,
        levels of review and hits of ``rules``. Call the second result after that job to add its counts."""
        seen = Observation()

        def of(rule: str) -> Callable[[Column], Column]:
            return lambda t: t["rule_id"] == rule

        hits = [F.sum(F.size(F.filter("tags", of(r)))).alias(f"rule:{r}") for r in rules]
        out = classified.observe(seen, F.count(F.lit(1)).alias("fields"), F.count_if(F.col("needs_review")).alias("needs_review"), *hits)

        def add() -> None:
            for name, n in seen.get.items():
                self.count(name, n or 0)

        return out, add

    def snapshot(self) -> dict:
        return {"counters": dict(self.counters), "seconds": {k: {"n": len(v), "total": sum(v), "max": max(v)} for k, v in self.seconds.items()}}


def rule_hit_counts(classified: DataFrame) -> DataFrame:
    """(rule_id, hits) of classified fields."""
    return classified.select(F.explode("tags").alias("t")).groupBy(F.col("t.rule_id").alias("rule_id")).agg(F.count("*").alias("hits"))
