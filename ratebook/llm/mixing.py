"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt in blocks of equal length. A source gets a whole number of blocks
by highest quotients v / (2k + 1); its blocks are dealt to its shards, groups of
documents small enough for one task, by the same law; and a shard takes each of
its blocks ``quota // blocks`` times and, once more, ``quota % blocks`` of them,
chosen by systematic sampling from a seeded start.

Defined results: a NULL text has no words; a NULL source is one more source, the
last; documents with equal ids are documents of their own; sources without words
get nothing; an empty table gives no rows; further columns are ignored. The
table of sources (one row each) is read by the driver: sources are labels given
by people or crawls, not something that each row has of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratebook.operators.staging import stage

WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Whole seats by highest quotients v / (2k + 1), at most ``caps`` each.

    The divisor at which the seats fit is found by halving; the few seats left at
    that divisor go one by one to the highest quotient, ties to the first.
    """
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[votes > 0].sum())) if len(votes) else 0
    if seats <= 0:
        return [0] * len(votes)

    def at(divisor: float) -> np.ndarray:  # seats whose quotient is at least 1 / divisor's half
        return np.minimum(np.floor(votes / divisor + 0.5).astype(np.int64), caps)

    low, high = 0.0, 2.0 * float(votes.max()) + 1.0  # at(high) has no seats
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if at(mid).sum() > seats:
            low = mid
        else:
            high = mid
    given = at(high)
    for _ in range(seats - int(given.sum())):
        quotient = np.where(given < caps, votes / (2 * given + 1), -1.0)
        given[int(np.argmax(quotient))] += 1
    return given.tolist()


def share_out(sizes: Sequence[int], weights: Sequence[float], most: int) -> list[float]:
    """The sum of all sizes shared by weight, each share at most ``most`` times its size."""
    total, target = float(sum(sizes)), [0.0] * len(sizes)
    free, rest = list(range(len(sizes))), total
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > most * sizes[i]]
        for i in full or free:
            target[i] = float(most * sizes[i]) if full else weights[i] * unit
        rest -= sum(most * sizes[i] for i in full)
        free = [i for i in free if i not in set(full)] if full else []
    return target


def seeded(seed: int, key: Column) -> Column:
    """60 bits of a seeded digest of the key, the same on every engine."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    block: int = 32,
    most: int = 3,
    docs_per_shard: int = 5_000,
    seed: int = 6,
) -> DataFrame:
    """How many words the mix takes of each document.

    The i-th source by code point has weight ``weights[i % len(weights)]``.
    """
    spark = docs.sparkSession
    sized = stage(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            seeded(seed, F.col("doc_id")).alias("_rand"),
        )
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    given = [weights[i % len(weights)] for i in range(len(found))]
    targets = share_out([r["n"] for r in found], given, most)
    seats = sainte_lague(targets, round(sum(targets) / block), [most * -(-r["n"] // block) for r in found])
    kind = "source string, source_size long, target double, _seats long, _shards long"
    plan = spark.createDataFrame(
        [
            (r["source"], r["n"], t, q, max(1, -(-r["docs"] // docs_per_shard)))
            for r, t, q in zip(found, targets, seats)
        ],
        kind,
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    placed = sized.join(plan, same(sized, plan)).select(
        "doc_id", sized["source"], "size", "_rand", "source_size", "target", "_seats",
        (F.col("_rand") % F.col("_shards")).alias("_shard"),
    )

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_shard")
        n = -(-part["_n"].to_numpy() // block)
        part["_quota"] = sainte_lague(part["_n"], int(part["_seats"].iloc[0]), most * n)
        return part[["source", "_shard", "_n", "_quota"]]

    quotas = (
        placed.groupBy("source", "_shard").agg(F.sum("size").alias("_n"), F.max("_seats").alias("_seats"))
        .groupBy("source").applyInPandas(deal, "source string, _shard long, _n long, _quota long")
        .withColumns({
            "_blocks": F.expr(f"greatest(1L, (_n + {block - 1}) div {block})"),
            "_start": seeded(seed, F.concat_ws("|", F.coalesce("source", F.lit("")), "_shard")),
        })
        .withColumns({
            "_all": F.expr("_quota div _blocks"),
            "_some": F.expr("_quota % _blocks"),
            "_start": F.expr("_start % _blocks"),
        })
        .withColumnRenamed("source", "_source").withColumnRenamed("_shard", "_s")
    )
    line = Window.partitionBy("source", "_shard").orderBy("_rand", "doc_id", "size")
    laid = placed.withColumn(
        "_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    both = laid.join(
        quotas, laid["source"].eqNullSafe(quotas["_source"]) & (laid["_shard"] == quotas["_s"])
    )
    # chosen blocks before block i: (i * _some + _start) div _blocks
    upto = lambda i: f"(({i}) * _some + _start) div _blocks"
    chosen = lambda i: f"({upto(f'({i}) + 1')} - {upto(i)})"
    return (
        both.withColumn("_from", F.expr("_end - size"))
        .withColumns({"_b0": F.expr(f"_from div {block}"), "_b1": F.expr(f"(_end - 1) div {block}")})
        .withColumn(
            "_extra",
            F.expr(
                f"CASE WHEN size = 0 THEN 0 WHEN _b0 = _b1 THEN {chosen('_b0')} * size"
                f" ELSE {chosen('_b0')} * ((_b0 + 1) * {block} - _from) + {chosen('_b1')} * (_end - _b1 * {block})"
                f" + ({upto('_b1')} - {upto('_b0 + 1')}) * {block} END"
            ),
        )
        .select(
            "doc_id", "size", "source_size", "target",
            F.expr("_all * size + _extra").cast("long").alias("taken"),
            laid["source"].alias("source"), F.col("_shard").alias("mix_shard"),
        )
    )
