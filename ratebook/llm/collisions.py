"""Near-duplicate vectors by counting collisions on sorted projections.

Two unit vectors at distance d differ by N(0, d^2) along a random direction, so vectors
of nearly the same direction stay close on almost every one-dimensional projection.
Equal vectors are one class first. Classes are dealt into cells by the grid places of
some projections, several times over with other directions; a cell's classes are sorted
along one more projection, and around each of them a window moves over the sorted line.
Pairs inside the window are counted on ``counted`` further projections: a pair that
collides (differs by at most ``window``) on ``needed`` of them is measured exactly.

:func:`calibrate` derives all figures from the binomial and normal laws, so that a pair
at exactly the wanted cosine is lost with a chance of ``lost`` at most, and from the
largest label's count, so that the expected crowd of a cell stays the same at every
size: the projections of a cell grow with log n, the tables with a small power of n.

A cell of more than ``CELL`` classes (a group of near copies) is cut into chunks by
hash; each pair of chunks is a block of its own. A pair is measured in the first table
whose cell it shares; links are summed, and a block hands on one edge per class to the
connected components, never its pairs.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite
components, and those without a label, link with nothing: no links, a component of
their own, kept. Vectors of different length have no cosine and do not link. Rows that
repeat an id are vectors each; a NULL id is smaller than none, so a component has the
smallest id that is not NULL, and a row without an id is never kept. No rows give no
rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.llm.blocks import mix
from ratebook.llm.common import small
from ratebook.llm.components import components
from ratebook.operators.staging import stage

COSINE = 0.98
LOST = 1e-6  # chance to lose a pair at exactly that cosine
CROWD = 4  # strangers expected in a cell
COUNTED = 24  # projections on which collisions are counted
CELL = 2048  # classes compared at once; chunks have half as many
BATCH = 16384  # classes a task holds at once
GROUP = ["label", "dim", "turn", "cell", "block"]
COPY = "label string, dim int, turn int, cell long, cid long, times long, vec binary, cells binary"


def _normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def _same_cell(distance: float, width: float) -> float:
    """The chance that two points so far apart share a place of a randomly shifted grid."""
    x = width / distance
    return 2 * _normal(x) - 1 - 2 / (x * math.sqrt(2 * math.pi)) * (1 - math.exp(-x * x / 2))


@dataclass(frozen=True)
class Scan:
    tables: int
    places: int  # projections that make a cell
    width: float  # of a place
    reach: float  # of the window on the sorted line
    window: float
    needed: int
    seed: int = 13

    def directions(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions of the cells, of the sorted line and of the counts; the grid's shifts."""
        draw = np.random.default_rng([self.seed, dim])
        n = self.tables * self.places
        shifts = draw.uniform(0.0, self.width, n)
        return draw.standard_normal((dim, n + 1 + COUNTED)), shifts


def calibrate(largest: int, cosine: float = COSINE, lost: float = LOST) -> Scan:
    """The scan that loses a pair at ``cosine`` with a chance of ``lost`` at most.

    A third of it goes to the cells, the window on the line and the count each.
    """
    near, part = math.sqrt(2 - 2 * cosine), lost / 3
    width, window = 10 * near, 3 * near
    places = max(1, math.ceil(math.log(max(1.0, largest / CROWD)) / -math.log(_same_cell(math.sqrt(2), width))))
    found = _same_cell(near, width) ** places
    tables = max(1, math.ceil(math.log(part) / math.log1p(-found)))
    reach = near
    while 2 * (1 - _normal(reach / near)) > part:
        reach += near / 16
    p, missed, needed = 2 * _normal(window / near) - 1, 0.0, 0
    while needed < COUNTED:
        missed += math.comb(COUNTED, needed) * p**needed * (1 - p) ** (COUNTED - needed)
        if missed > part:
            break
        needed += 1
    return Scan(tables, places, width, reach, window, needed)


def _units(vecs: np.ndarray) -> np.ndarray:
    x = vecs.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(vector: str, label: str) -> F.Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(
        F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False)
    )


def _dealt(classes: DataFrame, scan: Scan) -> DataFrame:
    """A row per class and table, with its cell and the cells of all tables."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                vecs = np.stack(part["vec"].to_list())
                directions, shifts = scan.directions(int(dim))
                n = len(shifts)
                places = np.floor((_units(vecs) @ directions[:, :n] + shifts) / scan.width).astype(np.int64)
                cells = np.zeros((len(part), scan.tables), np.uint64)
                for k in range(scan.places):
                    cells = mix(cells * np.uint64(0x9E3779B97F4A7C15) + places[:, k :: scan.places].astype(np.uint64))
                raw = [v.tobytes() for v in vecs]
                told = [c.tobytes() for c in cells]
                for turn in range(scan.tables):
                    yield pd.DataFrame({
                        "label": part["label"], "dim": part["dim"], "turn": turn, "cell": cells[:, turn].view(np.int64),
                        "cid": part["cid"], "times": part["times"], "vec": raw, "cells": told,
                    })

    return classes.select("label", "dim", "cid", "times", "vec").mapInPandas(deal, COPY)


def _blocks(copies: DataFrame) -> DataFrame:
    """``copies`` with block and chunk: cells of up to CELL classes are one block."""
    cell = ["label", "dim", "turn", "cell"]
    crowded = copies.groupBy(*cell).agg(F.count("*").alias("held")).where(F.col("held") > CELL)
    crowded = stage(crowded.withColumn("chunks", F.ceil(F.col("held") * 2 / F.lit(CELL)).cast("int")).drop("held"))
    met = copies.join(small(crowded), cell, "left")
    own = F.pmod(F.xxhash64("cid"), F.coalesce(F.col("chunks"), F.lit(1))).cast("int")
    others = F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)
    return met.withColumn("chunk", own).withColumn("other", F.explode(others)).select(
        *cell,
        F.concat_ws("-", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("block"),
        "chunk", "cid", "times", "vec", "cells",
    )


def _roots(n: int) -> tuple[np.ndarray, callable]:
    """Labels of a growing forest, and what joins pairs in it."""
    top = np.arange(n)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        x, y = top[a], top[b]
        while len(x := (pair := np.unique(np.stack([x, y])[:, x != y], axis=1))[0]):
            y = pair[1]
            high, low = np.maximum(x, y), np.minimum(x, y)
            np.minimum.at(top, high, low)
            while (shorter := top[top] < top).any():
                top[shorter] = top[top][shorter]
            x, y = top[high], top[low]

    return top, join


def _linked(batch: pd.DataFrame, scan: Scan, cosine: float, kind: str) -> Iterator[pd.DataFrame]:
    """Links of each class in whole blocks of one length, and its root there."""
    units = _units(np.frombuffer(b"".join(batch["vec"]), kind).reshape(len(batch), -1))
    directions, shifts = scan.directions(units.shape[1])
    line = units @ directions[:, len(shifts)]
    group = batch.groupby(GROUP, sort=False).ngroup().to_numpy()
    order = np.lexsort((line, group))
    units, line, group = units[order], line[order], group[order]
    seen = (units @ directions[:, len(shifts) + 1 :]).astype(np.float32)
    cells = np.frombuffer(b"".join(batch["cells"]), np.uint64).reshape(len(batch), -1)[order]
    cid, times, turn, chunk = (batch[c].to_numpy()[order] for c in ("cid", "times", "turn", "chunk"))
    across = batch["block"].map(lambda b: len(set(b.split("-"))) > 1).to_numpy()[order]
    links = np.zeros(len(batch), np.int64)
    top, join = _roots(len(batch))
    before = np.arange(cells.shape[1])[None, :]
    live, step = np.arange(len(batch)), 0
    while len(live):
        step += 1
        live = live[live + step < len(batch)]
        live = live[(group[live] == group[live + step]) & (line[live + step] - line[live] <= scan.reach)]
        a = live[~across[live] | (chunk[live] != chunk[live + step])]
        b = a + step
        hit = (np.abs(seen[a] - seen[b]) <= scan.window).sum(axis=1) >= scan.needed
        a, b = a[hit], b[hit]
        earlier = ((cells[a] == cells[b]) & (before < turn[a][:, None])).any(axis=1)
        a, b = a[~earlier], b[~earlier]
        near = np.einsum("ij,ij->i", units[a], units[b]) >= cosine
        a, b = a[near], b[near]
        if len(a):
            links[a] += times[b]
            links[b] += times[a]
            join(a, b)
    has = links > 0
    yield pd.DataFrame({"cid": cid[has], "links": links[has], "root": cid[top[has]]})


def _measured(blocks: DataFrame, scan: Scan, cosine: float, kind: str) -> DataFrame:
    """(cid, links, root): a row per class and block in which it has links."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def ready(rest: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for _, part in rest.groupby("dim"):
                yield from _linked(part, scan, cosine, kind)

        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) < BATCH:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = (whole[GROUP] == whole[GROUP].iloc[-1]).all(axis=1).to_numpy()
            yield from ready(whole[~last])
            held = [whole[last]]
        if held:
            yield from ready(pd.concat(held, ignore_index=True))

    dealt = blocks.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInPandas(measure, "cid long, links long, root long")


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    cosine: float = COSINE, lost: float = LOST,
) -> DataFrame:
    """(key, n_links, component_id, kept): one row per row of ``df``."""
    kind = dict(df.dtypes)[vector]
    wide = "array<float>" if kind == "array<float>" else "array<double>"
    rows = stage(df.select(
        F.col(key).cast("long").alias("id"),
        F.when(usable(vector, label), F.col(label).cast("string")).alias("label"),
        F.when(usable(vector, label), F.col(vector).cast(wide)).alias("vec"),
    ))
    classes = stage(
        rows.where("vec IS NOT NULL").groupBy("label", "vec")
        .agg(F.count("*").alias("times"), F.min("id").alias("least"))
        .withColumns({"dim": F.size("vec"), "cid": F.monotonically_increasing_id()})
    )
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    scan = calibrate(largest, cosine, lost)
    blocks = _blocks(_dealt(classes, scan))
    found = stage(_measured(blocks, scan, cosine, "f4" if wide == "array<float>" else "f8"))
    joined = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    told = stage(
        classes.join(linked, "cid", "left")
        .join(joined.select(F.col("u").alias("cid"), F.col("v").alias("root")), "cid", "left")
        .select(
            "label", "vec", "least", F.coalesce("root", "cid").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        )
    )
    least = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(least, "root").select("label", "vec", "n_links", "component_id")
    return rows.join(told, ["label", "vec"], "left").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n_links").isNull(), F.col("id").isNotNull())
        .otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).alias("kept"),
    )
