"""The trees and thresholds rest on all labelled candidates, not on some of them."""

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from trackmill.llm import pii as P


def test_every_labelled_candidate_is_fitted_or_calibrates(spark, monkeypatch):
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.format_string("call +49 170 %07d now or id=%011d", F.col("id"), F.col("id")).alias("text"))
    fitted = []

    class Counted(GBTClassifier):
        def fit(self, df, *a):
            fitted.append(df.count())
            return GBTClassifier(labelCol="label", maxIter=1, maxDepth=1, seed=7).fit(df)

    monkeypatch.setattr(P, "GBTClassifier", Counted)
    P.find_pii(docs).count()
    assert fitted and fitted[0] > 0.7 * 48_000
