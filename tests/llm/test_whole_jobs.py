"""Registered queries do the whole job of their operators."""

import math
from collections import Counter

import corpus_pipeline as pipeline
from ratebook.llm import queries
from tests.llm.test_operators import table, words
from tests.llm.test_pipeline import documents
from tests.llm.test_pipeline import words as english


def test_op10_scores_by_two_words_of_history(spark, tmp_path):
    rows = [(i, words(i % 40, 25, 12), None, None) for i in range(120)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_score(spark, str(tmp_path)).collect()
    learned = {r["doc_id"] for r in got if not r["held_out"]}
    grams = [Counter() for _ in range(3)]
    for i, t, *_ in rows:
        if i in learned:
            w = ["<s>", *t.split(), "</s>"]
            for n, c in enumerate(grams):
                c.update(zip(*[w[k:] for k in range(n + 1)]))
    one, two, three = grams
    n, v, k = sum(one.values()) - one["<s>",], len(one) - 1, got[0]["smoothing"]
    want = {}
    for i, t, *_ in rows:
        w, total = ["<s>", *t.split(), "</s>"], 0.0
        for j in range(1, len(w)):
            p = (one[w[j],] + 1) / (n + v + 1)
            p = (two[tuple(w[j - 1 : j + 1])] + k * p) / (one[w[j - 1],] + k)
            if j > 1:
                p = (three[tuple(w[j - 2 : j + 1])] + k * p) / (two[tuple(w[j - 2 : j])] + k)
            total += math.log10(p)
        want[i] = round(total, 6)
    assert {r["doc_id"]: round(r["score"], 6) for r in got} == want


def prose(seed, n=40):
    return words(seed, n, 9999)


def test_pipeline_judges_rows_that_share_an_id_by_their_text(spark):
    def kept(rows):
        out = pipeline.near_duplicates(spark, table(spark, [(i, t, "en", "s") for i, t in rows]), "")
        return sorted((r["doc_id"], r["text"]) for r in out.collect())

    a, b, c = prose(1), prose(2), prose(3)
    # one row of id 5 is a near copy, the other nobody's; both of id 6 are nobody's; id 7 repeats a row
    rows = [(3, a), (5, a + " more"), (5, b), (6, c), (6, prose(4)), (7, prose(5)), (7, prose(5))]
    assert kept(rows) == sorted([(3, a), (5, b), (6, c), (6, prose(4)), (7, prose(5))])
    # id 5 names two groups: each keeps one row
    assert kept([(5, a), (9, a + " more"), (5, b), (7, b + " more")]) == sorted([(5, a), (5, b)])


def test_pipeline_judges_rows_without_id_like_the_others(spark, tmp_path):
    rows = documents(spark)
    more = [(None, english(100 + i, 60), "en", f"s{i % 3}", 1) for i in range(20)]
    more += [(None, "1234 !!", "en", "s0", 1), (None, english(9000, 12) + " " + english(9002, 30), "en", "s1", 1)]
    more += [(None, english(3, 60) + " more", "en", "s1", 1)]
    docs = rows.union(spark.createDataFrame(more, rows.schema))
    spark.createDataFrame([(1, english(9000, 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, nameless = str(tmp_path), lambda df: {r["text"] for r in df.where("doc_id IS NULL").collect()}
    spoken = pipeline.language(spark, docs, d)
    clear = {english(100 + i, 60) for i in range(20)}
    assert nameless(spoken) == clear | {english(5, 50), more[-2][1], more[-1][1]}
    alone = pipeline.near_duplicates(spark, spoken, d)
    assert nameless(alone) == clear | {more[-2][1]}  # the others are near copies of documents with an id
    cleaned = pipeline.clean(spark, alone, d)
    assert nameless(cleaned) == clear
    assert sorted(r["doc_id"] for r in cleaned.where("doc_id IS NOT NULL").collect()) == [*range(60)]
    mixed = pipeline.mix(spark, cleaned, d)
    assert mixed.where("doc_id IS NULL").count() > 0 and nameless(mixed) <= clear
    assert max(r["count"] for r in mixed.groupBy("text").count().collect()) <= 3
