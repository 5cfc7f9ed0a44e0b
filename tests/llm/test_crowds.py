"""Large buckets of near copies: judged without joins, one crowd at any depth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ratebook.llm import jaccard as J


def test_bytes_of_the_sketch_by_key():
    own = J.shingles(" ".join(f"word{i}" for i in range(60)))
    keys = np.array([5, -3, 64, 2**62 + 17, -(2**63)], np.int64)
    whole = J.sketch(own)
    assert J.bytes_at(own, keys) == [whole[k % 64 : k % 64 + 1] for k in keys.tolist()]


def test_copies_left_after_the_last_split_are_one_crowd(spark, monkeypatch):
    monkeypatch.setattr(J, "BUCKET", 4)
    monkeypatch.setattr(J, "DEPTH", 0)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    made = []
    first = J.buckets
    monkeypatch.setattr(J, "buckets", lambda *a: made.append(first(*a)) or made[-1])
    out = J.near_duplicates(docs).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, 11)}
    assert made[0].where(F.col("size") > 4).select("key").distinct().count() == 1
    assert made[0].where((F.col("size") > 4) & (F.col("key") >= 0)).isEmpty()
