"""Benchmark decontamination over a positional inverted index, in DataFrame operations.

``index`` stores where each term occurs: one posting (row_id, term_id, pos) per
occurrence, and an end posting per document that holds its id and length. A phrase
is looked up from its rarest terms: the postings of the rarest, shifted by the
term's offset in the phrase, give starting points; those of the second rarest,
shifted likewise, are intersected with them; what is left is intersected with the
lists of all other terms.

Defined results: a NULL text has no words; every row of the documents is a document
of its own, also with a repeated or NULL id; a NULL item id is written as the empty
string; repeated items count once; an item without words occurs nowhere; no
documents give no rows, no items give no hits; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratebook.llm.common import BREAKS, fold, small
from ratebook.operators.staging import stage

END = " "  # never a word
WINDOW = 10


def _split(text: Column) -> Column:
    # may start and end with an empty string: that shifts the positions of the whole text alike
    return F.split(fold(F.coalesce(text, F.lit(""))), BREAKS)


def _items(benchmark: DataFrame) -> DataFrame:
    """One row per word of each different item: it, item_id, n, p, term."""
    words = F.filter(_split(F.col("text")), lambda w: w != "")
    named = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("words")
    ).where(F.size("words") > 0)
    return stage(named.distinct().withColumn("it", F.monotonically_increasing_id())).select(
        "it", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("p", "term")
    )


def vocabulary(items: DataFrame) -> DataFrame:
    """The items' terms with an id; the end of a document is a term too."""
    terms = items.select("term").union(items.sparkSession.createDataFrame([(END,)], "term string"))
    return stage(terms.distinct().withColumn("term_id", F.monotonically_increasing_id()))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of ``terms`` in all documents, written once."""
    split = F.col("_words")
    empty = (F.get(split, F.lit(0)) == "").cast("int") + (
        (F.size(split) > 1) & (F.element_at(split, -1) == "")
    ).cast("int")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", _split(F.col("text")).alias("_words")
    ).select(
        "row_id", "doc_id", (F.size(split) - empty).alias("n_words"),
        F.posexplode(F.concat(split, F.array(F.lit(END)))).alias("pos", "term"),
    )
    last = F.col("term") == END
    return stage(
        rows.join(small(terms), "term").select(
            "row_id", "term_id", "pos", F.when(last, F.col("doc_id")).alias("doc_id"),
            F.when(last, F.col("n_words")).alias("n_words"),
        )
    )


def _rarest(items: DataFrame, postings: DataFrame, window: int) -> DataFrame:
    """For each window of an item that can occur: its rarest two terms and their places."""
    counts = postings.groupBy("term_id").agg(F.count("*").alias("seen"))
    ahead = Window.partitionBy("it").orderBy("p").rowsBetween(0, window - 1)
    term = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "p", "term_id")
    rated = items.join(F.broadcast(counts) if counts.count() < 100_000 else counts, "term_id", "left")
    return (
        rated.withColumn("_terms", F.sort_array(F.collect_list(term).over(ahead)))
        .where((F.col("p") <= F.greatest(F.col("n") - window, F.lit(0))) & (F.col("_terms")[0]["seen"] > 0))
        .select(
            "it",
            F.col("_terms")[0]["p"].alias("p1"),
            F.col("_terms")[0]["term_id"].alias("term1"),
            F.get("_terms", F.lit(1))["p"].alias("p2"),
            F.get("_terms", F.lit(1))["term_id"].alias("term2"),
        )
        .distinct()
    )


def phrase_matches(items: DataFrame, postings: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches: row_id, it, shift, and the sorted item places ``starts`` of windows.

    A window starting at place s of the item occurs at s + shift of the document.
    """
    pairs = stage(_rarest(items, postings, window))
    first = (
        postings.withColumnRenamed("term_id", "term1")
        .join(small(pairs), "term1")
        .select("row_id", "it", (F.col("pos") - F.col("p1")).alias("shift"), "p2", "term2")
    )
    second = postings.join(small(stage(pairs.select(F.col("term2").alias("term_id")).distinct())), "term_id")
    met = (
        first.where("p2 IS NOT NULL")
        .withColumns({"pos": F.col("shift") + F.col("p2"), "term_id": F.col("term2")})
        .join(second.select("row_id", "pos", "term_id"), ["row_id", "pos", "term_id"], "left_semi")
        .select("row_id", "it", "shift")
    )
    likely = stage(met.union(first.where("p2 IS NULL").select("row_id", "it", "shift")).distinct())
    near = postings.join(small(stage(likely.select("row_id").distinct())), "row_id").select(
        "row_id", "term_id", "pos"
    )
    wanted = likely.join(small(items.select("it", "n", "p", "term_id")), "it").withColumn(
        "pos", F.col("p") + F.col("shift")
    )
    width = F.least(F.lit(window), F.col("n"))
    place = F.col("_p")
    runs = (
        wanted.join(near, ["row_id", "pos", "term_id"], "left_semi")
        .groupBy("row_id", "it", "shift", "n")
        .agg(F.sort_array(F.collect_list("p")).alias("_p"))
    )
    starts = F.filter(place, lambda x, i: F.get(place, i + width - 1) == x + width - 1)
    return (
        runs.select("row_id", "it", "shift", width.alias("width"), starts.alias("starts"))
        .where(F.size("starts") > 0)
    )


def proximity_matches(items: DataFrame, postings: DataFrame, within: int) -> DataFrame:
    """Places (row_id, it, pos) of an item's rarest term with all its other terms near.

    Near is at most ``within`` words away, in any order.
    """
    counts = postings.groupBy("term_id").agg(F.count("*").alias("seen"))
    wanted = stage(
        items.select("it", "term_id").distinct().join(counts, "term_id", "left")
        .groupBy("it").agg(
            F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "term_id")).alias("rarest"),
            F.collect_set("term_id").alias("terms"),
        )
        .select("it", F.col("rarest.term_id").alias("rarest"), "terms", F.size("terms").alias("n_terms"))
    )
    cell = lambda c: F.floor(F.col(c) / (within + 1))
    centre = postings.join(wanted.select("it", F.col("rarest").alias("term_id"), "n_terms"), "term_id").select(
        "row_id", "it", "n_terms", F.col("pos").alias("at"),
        F.explode(F.sequence(cell("pos") - 1, cell("pos") + 1)).alias("cell"),
    )
    around = postings.join(
        wanted.select("it", F.explode("terms").alias("term_id")), "term_id"
    ).select("row_id", "it", "term_id", "pos", cell("pos").alias("cell"))
    return (
        centre.join(around, ["row_id", "it", "cell"])
        .where(F.abs(F.col("pos") - F.col("at")) <= within)
        .groupBy("row_id", "it", "at", "n_terms")
        .agg(F.count_distinct("term_id").alias("met"))
        .where("met = n_terms")
        .select("row_id", "it", F.col("at").alias("pos"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: its words, those inside any window of an item, and the items."""
    words = _items(benchmark)
    terms = vocabulary(words)
    items = stage(words.join(small(terms), "term").drop("term"))
    postings = index(docs, terms)
    end = terms.where(F.col("term") == END).select("term_id")
    matches = phrase_matches(items, postings, window)
    names = items.select("it", "item_id").distinct()
    spans = matches.join(small(stage(names)), "it").groupBy("row_id").agg(
        F.collect_set("item_id").alias("items"),
        F.sort_array(
            F.flatten(
                F.collect_list(
                    F.transform(
                        "starts",
                        lambda s: F.struct(
                            (s + F.col("shift")).alias("a"), (s + F.col("shift") + F.col("width")).alias("b")
                        ),
                    )
                )
            )
        ).alias("spans"),
    )
    zero = F.struct(F.lit(-1).alias("reach"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["reach"], s["b"]).alias("reach"),
            (acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["reach"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    hit = spans.select("row_id", covered.alias("n_hit"), F.sort_array("items").alias("items"))
    names_of = F.coalesce("items", F.array().cast("array<string>"))
    return (
        postings.join(F.broadcast(end), "term_id")
        .select("row_id", "doc_id", F.col("n_words").cast("long").alias("n_words"))
        .join(hit, "row_id", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(names_of).cast("long").alias("n_items"),
            F.sha2(F.array_join(names_of, ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )
