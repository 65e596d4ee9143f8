from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm.quality import FEATURES, features, fit, quality_scores, text_statistics

SCHEMA = "doc_id long, text string, score string"


def corpus(n=400):
    random.seed(4)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 8))) for _ in range(60)]
        good = i % 4 != 0
        docs.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), None))
        if i % 2:
            labels.append((i, int(good)))
        elif i % 16 == 0:
            labels.append((i, 0))
    return docs, labels


def test_separates_held_out_documents(spark):
    docs, labels = corpus()
    df, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality_scores(df, marks, F.col("doc_id") % 5 != 0).filter("not trusted").collect()
    assert len(rows) == 80 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good, bad = ([r.score for r in rows if (r.doc_id % 4 != 0) == g] for g in (True, False))
    assert min(good) > max(bad)


def test_labels_outside_the_trusted_rows_change_nothing(spark):
    docs, labels = corpus(120)
    df, trusted = spark.createDataFrame(docs, SCHEMA), F.col("doc_id") % 5 != 0
    one, two = (
        {r.doc_id: round(r.score, 9) for r in quality_scores(df, spark.createDataFrame([(i, q if i % 5 else flip(q)) for i, q in labels], "doc_id long, quality int"), trusted).collect()}
        for flip in (lambda q: q, lambda q: 1 - q))
    assert one == two


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "x"), (2, "", "x"), (3, "word " * 50_000, None), (None, "a", None)], SCHEMA)
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id long, quality int")
    rows = quality_scores(docs, labels, F.lit(True)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(docs.limit(0), labels, F.lit(True)).count() == 0
    assert quality_scores(docs, labels.limit(0), F.lit(True)).count() == 5


def test_without_positives_every_score_is_the_prior(spark):
    x = features(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")).withColumn("positive", F.lit(None).cast("boolean"))
    model = fit(x.select("x", "positive"), prior=0.4)
    assert model.score([text_statistics(b"any thing").tobytes()])[0] == pytest.approx(0.4)


def test_risk_is_lower_than_at_the_start(spark):
    docs, labels = corpus(200)
    good = {i for i, q in labels if q}
    x = features(spark.createDataFrame(docs, SCHEMA))
    rows = [(bytes(r.x), True if r.doc_id in good else None) for r in x.collect()]
    model = fit(spark.createDataFrame(rows, "x binary, positive boolean"), prior=0.75)

    def risk(weights):
        g = model.inputs([r[0] for r in rows]) @ weights
        p = np.array([r[1] is True for r in rows])
        negative = np.logaddexp(0, g).mean() - 0.75 * np.logaddexp(0, g[p]).mean()
        return 0.75 * np.logaddexp(0, -g[p]).mean() + max(0, negative)

    assert risk(model.weights) < risk(np.append(np.zeros(FEATURES), np.log(3)))
