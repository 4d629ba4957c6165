import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Names that operators use inside, as extra columns of their input.
CLASHES = ("kept", "component_id", "node", "c", "key", "n", "a", "b", "label", "score", "spans", "ids", "task", "length", "r", "p", "w", "f1")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and blank texts, null and repeated ids, repeated rows, ties, a very long text, clashing columns."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(500)]
    base = " ".join(rng.choice(words) for _ in range(120))
    near = base.replace("word1", "word2", 1)
    long = " ".join(rng.choice(words) for _ in range(150_000))
    texts = [None, "", " \t\n ", "one", "One", base, base, near, base.upper(), long, "password = hunter2hunter2", "日本語 テキスト", "x" * 200_000]
    rows = [(i, t, "en" if t else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, None, None, None), (None, None, None, None, None)]
    rows = [(*r, *("clash" for _ in CLASHES)) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
