"""The thin queries against their SQL, and the pipeline against its stages' own promises."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from graphspark.llm import kneser_ney, queries
from tests.helpers import same
from tests.llm.test_operators import brute_classes, hits, jump, plain_kneser_ney, plain_targets


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(name, spark, small_dir, duck):
    same(queries.queries()[name](spark, small_dir), duck, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_gives_a_row_for_each_document(name, spark, small_dir):
    table = "pages" if name.startswith("op10") else "documents"
    assert queries.queries()[name](spark, small_dir).count() == spark.read.parquet(f"{small_dir}/{table}.parquet").count()


def test_pipeline(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    inputs, taken = {r.doc_id for r in docs.collect()}, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, taken, small_dir)
        assert out.columns == docs.columns
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        assert ids and set(ids) <= inputs and max(ids.values()) <= (2 if k == 3 else 1)
        inputs, taken = set(ids), corpus_pipeline.materialise(out, f"test-{k}")
    last = corpus_pipeline.run(spark, small_dir).collect()
    assert Counter(r.doc_id for r in last) == ids
    assert set(corpus_pipeline.queries()) == {"pipeline"} and corpus_pipeline.oracle_sql() == {}


def plain_quality(spark, texts, small_dir):
    """Ids that the quality stage keeps, from plain counts and quantiles by numpy."""
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    learnt = {r.id for r in kneser_ney.training_ids(labels, "doc_id", "quality", 20_000).collect()}
    bits = plain_kneser_ney([texts[k][0] for k in learnt if k in texts])
    found = {k: bits(t) for k, (t, *_) in texts.items()}
    unseen = [r.doc_id for r in labels.where("quality = 1").collect() if r.doc_id not in learnt and r.doc_id in texts]
    of = {lang: [k for k in unseen if texts[k][1] == lang] for _, lang, _ in texts.values()}
    own = {lang: ks if len(ks) >= 50 else unseen for lang, ks in of.items()}
    centre = {lang: sum(found[k][0] for k in ks) / sum(found[k][1] for k in ks) for lang, ks in own.items()}
    prior = kneser_ney.PRIOR_CHARACTERS
    shrunk = lambda k: (found[k][0] + prior * centre[texts[k][1]]) / (found[k][1] + prior)
    limit = {lang: np.quantile([shrunk(k) for k in ks], 0.995) for lang, ks in own.items()}
    return {k for k, (t, lang, _) in texts.items() if t and shrunk(k) <= limit[lang] * (1 + 1e-9)}


def test_pipeline_agrees_with_brute_force(spark, small_dir):
    """Every stage on what its predecessor kept: decisions by plain Python; of the mix, whose draws are random, its totals."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    stages, frame = [f for _, f in corpus_pipeline.STAGES], docs
    texts = {r.doc_id: (r.text, r.lang, r.source) for r in docs.collect()}

    def step(k):
        nonlocal frame
        frame = corpus_pipeline.materialise(stages[k](spark, frame, small_dir), f"brute-{k}")
        return Counter(r[0] for r in frame.select("doc_id").collect())

    expected = plain_quality(spark, texts, small_dir)
    assert step(0) == Counter(expected) and len(expected) > 100
    classes = brute_classes([(k, texts[k][0]) for k in sorted(expected)])
    expected = {min(map(int, members)) for members in classes}
    assert step(1) == Counter(expected)
    expected = {k for k in expected if not hits(texts[k][0], items)[-1]}
    assert step(2) == Counter(expected)
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", texts[k][0])) for k in expected}
    totals, taken, mixed = Counter(), Counter(), step(3)
    for k in expected:
        totals[texts[k][2]] += size[k]
        taken[texts[k][2]] += size[k] * mixed[k]
    assert set(mixed) <= expected and max(mixed.values()) <= 2
    assert all(abs(taken[s] - t) <= 0.05 * max(t, 200) for s, t in plain_targets(dict(totals)).items())
    rows, slots = stages[4](spark, frame, small_dir).collect(), defaultdict(list)
    for r in rows:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 24), jump(r.doc_id, 25))
        slots[r.shard].append(r.slot)
    assert Counter(r.doc_id for r in rows) == mixed and all(sorted(x) == list(range(len(x))) for x in slots.values())
