"""The pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from scriptorium.llm import simhash, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels: toxic texts, exact and near copies, personal data, nulls and repeated rows."""
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(300):
        words = [f"term{k}" for k in rng.integers(0, 4000, 120)]
        if i % 6 == 0:
            for k in rng.integers(0, 120, 5):
                words[k] = "wretch"
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    clean = rows[1][1]
    rows += [(1000 + k, clean, "en", "s", 0) for k in range(40)] + [(1000, clean, "en", "s", 0)]
    rows += [(2000, clean.replace(clean.split()[60], "other"), "en", "s", 0), (3000, "mail me at x.y@z.org now " + rows[2][1][:200], "en", "s", 0), (4000, None, None, None, None), (None, "", "en", "s", 0)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "personal_data", "packing"]
    mild = stages["toxicity"](spark, docs, folder).cache()
    assert mild.columns == columns
    scored = toxicity.score_documents(docs, toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    assert Counter(r.doc_id for r in mild.collect()) == Counter(r.doc_id for r in scored if not r.predicted)
    assert {r.doc_id for r in mild.filter("doc_id = 3000").collect()} == {3000}
    assert {r.doc_id for r in mild.filter("doc_id < 300").collect()} == {i for i in range(300) if i % 6}
    single = stages["near_duplicates"](spark, mild, folder).cache()
    kept = [r.doc_id for r in single.collect()]
    assert single.columns == columns and len(kept) == len(set(kept))
    assert 1 in kept and not {*range(1000, 1040), 2000} & set(kept) and {i for i in range(300) if i % 6} <= set(kept)
    assert len({4000, None} & set(kept)) == 1  # both texts are empty
    masked = stages["personal_data"](spark, single, folder).cache()
    by = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == columns and masked.count() == len(kept)
    assert by[3000].text.startswith("mail me at [EMAIL] now ") and by[3000].n_chars == len(by[3000].text)
    packed = stages["packing"](spark, masked, folder).collect()
    assert {r.doc_id for r in packed} == set(kept)


CLASHES = ["pii", "pii_email", "has_digit", "whole", "dedup_id", "dedup_row", "id", "row", "turn", "toxic_score", "fp", "label", "way", "kept"]


def test_stages_keep_columns_of_any_name(spark, folder):
    """Extra columns whose names operators use themselves stay as they are through every stage but the last."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        assert docs.count() and docs.filter(" or ".join(f"`{c}` != concat('{c}-', coalesce(cast(doc_id as string), ''))" for c in CLASHES)).isEmpty()
    assert "row" not in corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns


def test_stages_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.isEmpty()


def test_shares_of_a_group_lose_no_link(spark):
    """A group of candidates that is dealt over cells gives the same classes as in one task."""
    rng = np.random.default_rng(4)
    base = [f"t{k}" for k in rng.integers(0, 10_000, 200)]
    rows = []
    for i in range(120):  # a chain: each text differs from the one before by one more word
        base = [*base]
        base[(7 * i) % 200] = f"new{i}"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = [{r.doc_id: r.least_id for r in simhash.similar_groups(docs, 5, (4, 5), n).collect()} for n in (10**6, 2_000)]
    assert classes[0] == classes[1] and len(classes[0]) == 120
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for _, t in rows]
    parent = list(range(120))
    for a in range(120):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = [new if x == old else x for x in parent]
    assert classes[0] == dict(enumerate(parent))


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 200
