"""op12 on inputs so large that blocks draw no window for the bounds of the ranges."""

from __future__ import annotations

import pytest

from ratebook.llm import phrases as P


@pytest.mark.parametrize("sample", [0, 2])
def test_blocks_without_drawn_windows(spark, monkeypatch, sample):
    rows = [(f"alpha beta gamma delta w{i % 7}. " * 4, "en" if i % 5 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = sorted(map(repr, P.collocations(docs).collect()))
    monkeypatch.setattr(P, "SAMPLE", sample)
    monkeypatch.setattr(P, "RANGE", 500)
    assert len(want) > 5 and sorted(map(repr, P.collocations(docs).collect())) == want
