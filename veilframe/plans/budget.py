"""The privacy ledger: driver-side, one accountant for each namespace, spent before anything runs.

Accountants here live as long as their process; ``veilframe.plans.ledger`` keeps one on the shared file system.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

DEFAULT_NAMESPACE, DEFAULT_EPSILON, DEFAULT_DELTA = "default", 10.0, 1e-4


class PrivacyError(ValueError):
    """An invalid argument."""

    status = "INVALID_ARGUMENT"


class BudgetExhausted(RuntimeError):
    """A spend would exceed the namespace's total."""

    status = "RESOURCE_EXHAUSTED"


def checked_charge(epsilon: float, delta: float) -> None:
    """A charge adds to what is spent: a negative one would give budget back."""
    if not epsilon >= 0 or not delta >= 0:
        raise PrivacyError(f"a charge can't be negative, got {epsilon} and {delta}")


class BudgetAccountant:
    """Basic composition: totals of epsilon and delta add up."""

    _all: dict[str, BudgetAccountant] = {}
    _lock = threading.Lock()

    def __init__(self, namespace: str, epsilon: float, delta: float):
        self.namespace, self.epsilon, self.delta = namespace, epsilon, delta
        self.spent_epsilon = self.spent_delta = 0.0
        self.history: list[tuple[float, float]] = []
        self.refused = 0
        self._own = threading.Lock()

    @classmethod
    def instance(cls, namespace: str = DEFAULT_NAMESPACE, epsilon: float = DEFAULT_EPSILON, delta: float = DEFAULT_DELTA) -> BudgetAccountant:
        """The namespace's only accountant; asking again with other totals is an error."""
        if not namespace or not namespace.strip():
            raise PrivacyError("the namespace is empty")
        with cls._lock:
            found = cls._all.setdefault(namespace, cls(namespace, epsilon, delta))
        if (found.epsilon, found.delta) != (epsilon, delta):
            raise PrivacyError(f"namespace {namespace!r} has other totals")
        return found

    @classmethod
    def reset(cls, namespace: str | None = None) -> None:
        with cls._lock:
            cls._all = {k: v for k, v in cls._all.items() if namespace is not None and k != namespace}

    def spend(self, epsilon: float, delta: float = 0.0) -> None:
        """Charge the ledger; on exhaustion nothing is charged."""
        checked_charge(epsilon, delta)
        with self._own:
            if self.spent_epsilon + epsilon > self.epsilon or self.spent_delta + delta > self.delta:
                self.refused += 1
                raise BudgetExhausted(f"namespace {self.namespace!r} has {self.epsilon - self.spent_epsilon} epsilon and {self.delta - self.spent_delta} delta left")
            self.spent_epsilon += epsilon
            self.spent_delta += delta
            self.history.append((epsilon, delta))

    def remaining(self) -> dict[str, float]:
        with self._own:
            return {"epsilon": self.epsilon - self.spent_epsilon, "delta": self.delta - self.spent_delta}

    def as_dataframe(self, spark: SparkSession) -> DataFrame:
        r = self.remaining()
        return spark.createDataFrame([(self.namespace, r["epsilon"], r["delta"])], "namespace string, epsilon double, delta double")
