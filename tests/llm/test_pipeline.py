import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.test_tokens import check_packed
from veilframe.llm import quality, secrets


def test_against_brute_force(spark):
    """Each stage on what the one before kept, by plain code; the classifier's scores are its own."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in quality.score(docs, quality.train(docs, quality.learnable(labels, "quality", 5, 0))).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if scores[r["doc_id"]]]
    groups = brute.near_duplicates(rows, 5)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    items = [s for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if (s := brute.shingles(r["text"], 5))]
    rows = [(i, t) for i, t in rows if not any(100 * len(s & d) >= 80 * len(s) for d in [brute.shingles(t, 5)] for s in items)]
    rows = [(i, secrets.redact_text(t)) for i, t in rows]
    check_packed(corpus_pipeline.run(spark, SMALL).collect(), rows, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_stages_keep_the_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    assert corpus_pipeline.packing_stage(spark, odd_docs, SMALL).select(F.countDistinct("doc_id")).first()[0] == 13
