"""One object for one namespace: every operation by its service name, releases charged to its ledger.

Defaults are those of the service's entry layer: epsilon 1, Laplace for scalars and Gaussian for vectors,
k 5 and depth 10, three dummies in the medical domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import masks
from veilframe.functions.noise import SecureNoise
from veilframe.operators import dp, kanon, ldp, obfuscate
from veilframe.plans import classify, params, pipeline
from veilframe.plans.budget import DEFAULT_DELTA, DEFAULT_EPSILON, DEFAULT_NAMESPACE, BudgetAccountant, BudgetExhausted


class PrivacyClient:
    def __init__(self, namespace: str = DEFAULT_NAMESPACE, epsilon: float = DEFAULT_EPSILON, delta: float = DEFAULT_DELTA, noise: SecureNoise | None = None, semantics: str = "reference", ledger: BudgetAccountant | None = None):
        """``ledger``: another accountant than the process's own, such as a ``DurableAccountant``."""
        self.ledger, self.noise, self.semantics = ledger or BudgetAccountant.instance(namespace, epsilon, delta), noise or dp.SECURE, semantics
        self.metrics = params.Metrics()

    def _release(self, name: str, plan, epsilon: float, delta: float) -> DataFrame:
        try:
            with self.metrics.timer(name):
                out = dp.release(plan, self.ledger, epsilon, delta)
        except BudgetExhausted:
            self.metrics.count("budget_exhausted")
            raise
        self.metrics.count(name)
        self.metrics.count("epsilon", epsilon)
        return out

    @staticmethod
    def _none(df: DataFrame, schema: str, *rows: tuple) -> DataFrame:
        return df.sparkSession.createDataFrame(list(rows), schema)

    # Masking: columns and frames; nothing is charged.
    mask = staticmethod(masks.mask_value)
    mask_batch = staticmethod(masks.mask_batch)
    mask_record = staticmethod(masks.mask_record)
    hash = staticmethod(masks.hmac_token)
    truncate = staticmethod(masks.truncate)
    redact = staticmethod(masks.redact)

    def mask_dataframe(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        return masks.mask_dataframe(df, columns, self.semantics)

    # Central differential privacy: each call is one charge and one draw.
    def dp_count(self, df: DataFrame, column: str, epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace") -> DataFrame:
        return self._release("dp_count", lambda: dp.count(df, column, epsilon, delta, mechanism, self.noise), epsilon, delta)

    def dp_sum(self, df: DataFrame, column: str, epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace", lower: float | None = None, upper: float | None = None) -> DataFrame:
        return self._release("dp_sum", lambda: dp.sum(df, column, epsilon, delta, mechanism, lower, upper, self.noise), epsilon, delta)

    def dp_mean(self, df: DataFrame, column: str, epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace", lower: float | None = None, upper: float | None = None) -> DataFrame:
        """An empty table gives 0 without a charge."""
        if df.isEmpty():
            return self._none(df, "value double", (0.0,))
        return self._release("dp_mean", lambda: dp.mean(df, column, epsilon, delta, mechanism, lower, upper, self.noise), epsilon, delta)

    def dp_histogram(self, df: DataFrame, column: str, categories: list[str], epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace") -> DataFrame:
        return self._release("dp_histogram", lambda: dp.histogram(df, column, categories, epsilon, delta, mechanism, self.noise), epsilon, delta)

    def dp_noisy_count(self, df: DataFrame, true_count: Column, key: Column, epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace") -> DataFrame:
        return self._release("dp_noisy_count", lambda: df.select("*", dp.noisy_count(true_count, epsilon, delta, mechanism, self.noise, key).alias("value")), epsilon, delta)

    def dp_noisy_sum(self, df: DataFrame, true_sum: Column, sensitivity: float, key: Column, epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace") -> DataFrame:
        return self._release("dp_noisy_sum", lambda: df.select("*", dp.noisy_sum(true_sum, sensitivity, epsilon, delta, mechanism, self.noise, key).alias("value")), epsilon, delta)

    def dp_noisy_mean(self, df: DataFrame, true_sum: Column, true_count: Column, sensitivity: float, epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace", min_count: int = 5) -> DataFrame:
        return self._release("dp_noisy_mean", lambda: df.select("*", dp.noisy_mean(true_sum, true_count, sensitivity, epsilon, delta, mechanism, min_count, self.noise).alias("value")), epsilon, delta)

    def dp_noisy_histogram(self, df: DataFrame, epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace") -> DataFrame:
        return self._release("dp_noisy_histogram", lambda: dp.noisy_histogram(df, epsilon, delta, mechanism, self.noise), epsilon, delta)

    def dp_chunked_count(self, df: DataFrame, chunks: str, epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace") -> DataFrame:
        return self._release("dp_chunked_count", lambda: dp.chunked_count(df, chunks, epsilon, delta, mechanism, self.noise), epsilon, delta)

    def dp_chunked_sum(self, df: DataFrame, chunks: str, epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace", lower: float | None = None, upper: float | None = None) -> DataFrame:
        return self._release("dp_chunked_sum", lambda: dp.chunked_sum(df, chunks, epsilon, delta, mechanism, lower, upper, self.noise), epsilon, delta)

    def dp_chunked_mean(self, df: DataFrame, chunks: str, epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace", lower: float | None = None, upper: float | None = None, min_count: int = 5) -> DataFrame:
        """Fewer true values than ``min_count`` give 0 without a charge."""
        if (df.agg(F.sum(F.greatest(F.size(chunks), F.lit(0)))).first()[0] or 0) < min_count:
            return self._none(df, "value double", (0.0,))
        return self._release("dp_chunked_mean", lambda: dp.chunked_mean(df, chunks, epsilon, delta, mechanism, lower, upper, min_count, self.noise), epsilon, delta)

    def dp_chunked_histogram(self, df: DataFrame, chunks: str, categories: list[str], epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace") -> DataFrame:
        return self._release("dp_chunked_histogram", lambda: dp.chunked_histogram(df, chunks, categories, epsilon, delta, mechanism, self.noise), epsilon, delta)

    def dp_vector_sum(self, df: DataFrame, column: str, max_norm: float = 1.0, epsilon: float = 1.0, delta: float = 1e-5, mechanism: str = "gaussian") -> DataFrame:
        """No vectors give no rows and cost nothing."""
        if dp.vector_dimension(df, column) is None:
            return self._none(df, "pos int, value double")
        return self._release("dp_vector_sum", lambda: dp.vector_sum(df, column, max_norm, epsilon, delta, mechanism, self.noise), epsilon, delta)

    def dp_vector_mean(self, df: DataFrame, column: str, max_norm: float = 1.0, epsilon: float = 1.0, delta: float = 1e-5, mechanism: str = "gaussian", min_count: int = 5) -> DataFrame:
        """The count is charged half; only if it reaches ``min_count`` is the sum drawn and charged the other
        half, else all is zero. No vectors give no rows and cost nothing."""
        dim = dp.vector_dimension(df, column)
        if dim is None:
            return self._none(df, "pos int, value double")
        total = df.agg(F.count(column).alias("n"))
        n = self._release("dp_vector_mean", lambda: total.select(dp.noisy_count(F.col("n"), epsilon / 2, delta / 2, mechanism, self.noise, "vector.count").alias("value")), epsilon / 2, delta / 2).first()["value"]
        if n < min_count or n <= 0:
            return self._none(df, "pos int, value double", *((i, 0.0) for i in range(dim)))
        summed = self._release("dp_vector_mean_sum", lambda: dp.vector_sum(df, column, max_norm, epsilon / 2, delta / 2, mechanism, self.noise), epsilon / 2, delta / 2)
        return summed.select("pos", (F.col("value") / n).alias("value"))

    def dp_adaptive_clip(self, df: DataFrame, column: str, epsilon: float = 1.0, quantile: float = 0.95, iterations: int = 15, initial: float = 10.0) -> tuple[float, float]:
        """Reference semantics charge nothing; intended semantics charge epsilon."""
        if self.semantics == "intended":
            self.ledger.spend(epsilon)
        return dp.adaptive_clip(df, column, epsilon, quantile, iterations, initial, self.noise)

    def dp_group_by(self, df: DataFrame, group: str, target: str, agg: str = "sum", epsilon: float = 1.0, delta: float = 1e-5, lower: float | None = None, upper: float | None = None, mechanism: str = "laplace") -> DataFrame:
        return self._release("dp_group_by", lambda: dp.group_by(df, group, target, agg, epsilon, delta, lower, upper, mechanism, self.noise, self.semantics), epsilon, delta)

    def dp_aggregate(self, df: DataFrame, specs: dict[str, tuple[str, dict]], epsilon: float = 1.0, delta: float = 0.0, mechanism: str = "laplace") -> DataFrame:
        return self._release("dp_aggregate", lambda: dp.aggregate(df, specs, epsilon, delta, mechanism, self.noise), epsilon, delta)

    # Local differential privacy.
    def perturb_binary(self, value: Column, epsilon: float, key: Column) -> Column:
        return ldp.perturb_binary(value, epsilon, key, self.noise)

    def perturb_categorical(self, value: Column, categories: list[str], epsilon: float, key: Column) -> Column:
        return ldp.perturb_categorical(value, categories, epsilon, key, self.noise)

    estimate_binary_frequency = staticmethod(ldp.estimate_binary)
    estimate_categorical_histogram = staticmethod(ldp.estimate_histogram)

    # k-anonymity, obfuscation, parameters.
    k_anonymize_record = staticmethod(kanon.anonymize_record)
    k_anonymize_table = staticmethod(kanon.k_anonymize_table)
    k_anonymize_dataframe = staticmethod(kanon.k_anonymize_strings)
    obfuscate_query = staticmethod(obfuscate.obfuscate)
    obfuscate_query_batch = staticmethod(obfuscate.obfuscate_batch)
    recommend_params = staticmethod(params.recommend)

    # Classification and pipelines.
    def classifier(self, domain: str | None = None, standard: str | None = None) -> classify.Classifier:
        return classify.build(domain, standard, self.semantics)

    def medical_process(self, df: DataFrame) -> DataFrame:
        return pipeline.medical_process(df, semantics=self.semantics)

    def process_records(self, df: DataFrame, mask_l4: bool = True, mask_l5: bool = True) -> DataFrame:
        return pipeline.process_records(df, mask_l4, mask_l5, semantics=self.semantics)

    # State.
    def remaining_budget(self) -> dict[str, float]:
        return self.ledger.remaining()

    def health(self) -> dict[str, object]:
        return {"status": "UP", "namespace": self.ledger.namespace, "operators": len(classify.list_operators()), **self.remaining_budget()}
