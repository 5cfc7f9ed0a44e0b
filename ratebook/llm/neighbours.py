"""Nearest neighbours by adaptive dimension scan inside probed lists.

Vectors are rotated by a seeded random orthogonal matrix, so that the first few
columns estimate a whole distance. They are kept in lists around centroids, cut
into blocks of bounded size, each block in groups of columns. A query probes its
nearest lists; a candidate is dropped as soon as the columns read so far reject, at
``slack`` standard deviations, that it is nearer than the tenth best; survivors are
measured exactly, in double precision, on the original vectors.

Centroids and the number of probed lists are fitted on a bounded sample of
``sample`` vectors: the fewest lists that hold the share ``recall`` of the sample's
own nearest neighbours. Every vector is indexed; a list of any size is split into
blocks, none is cut.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite
components, or have a NULL id, take no part. Vectors of different lengths have no
distance: each length is an index of its own, and a query is held against the
vectors of its length. Rows with the query's id are its own and no candidates; an id
that several queries have asks once, with its shortest vector, the least of these.
Equal vectors are candidates each, ties go to the smaller id; with fewer candidates
than asked all are returned; no vectors give no rows; further columns are ignored.
Distances are measured on the components as given: only the rotated columns, which
propose candidates, are of single precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratebook.operators.staging import stage

COLUMNS = 16  # of a group
BLOCK = 1024  # vectors of a block, queries of a batch
KNOWN = 50_000  # queries whose best a task keeps
PIECE = 128  # vectors scanned before radii are renewed


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): the vectors that take part, single components kept as they are, others as double."""
    v = F.col(vector)
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), v.cast(kind).alias("vec")).where(
        F.col(key).isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)
    )


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def fit(rows: DataFrame, k: int, sample: int, recall: float, seed: int = 5) -> tuple[np.ndarray, int]:
    """Centroids and the number of lists to probe."""
    total = rows.count()
    rate = F.lit(min(1.0, sample / max(1, total)))
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) / float(1 << 40)
    picked = rows.where(draw < rate).select("vec").toPandas()["vec"]
    x = np.stack(picked).astype(np.float64) if len(picked) else np.zeros((0, 1))
    if not len(x):
        return x, 0
    rng = np.random.default_rng(seed)
    x = x[np.lexsort(x.T)]  # the sample's order must not matter
    lists = max(1, min(1024, math.isqrt(total), len(x)))
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(8):
        at = _distances(x, c).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=lists)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    at = _distances(x, c).argmin(axis=1)
    asked = rng.choice(len(x), min(len(x), 200), replace=False)
    near = _distances(x[asked], x)
    near[np.arange(len(asked)), asked] = np.inf
    best = np.argsort(near, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(_distances(x[asked], c), axis=1), axis=1)
    needed = np.take_along_axis(place, at[best], axis=1).ravel()
    probes = 1 + int(np.quantile(needed, recall, method="higher")) if needed.size else 1
    return c, probes


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _exact(rows: DataFrame) -> str:
    """The numpy type that holds the components as given."""
    return "float32" if dict(rows.dtypes)["vec"] == "array<float>" else "float64"


def build(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The index: one row per block, (list, ids, vectors, columns), written."""
    turn, exact = rotation(centroids.shape[1]), _exact(rows)

    @F.pandas_udf("int")
    def nearest(vec: pd.Series) -> pd.Series:
        return pd.Series(_distances(np.stack(vec).astype(np.float64), centroids).argmin(axis=1))

    placed = stage(rows.withColumn("list", nearest("vec")))
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cells"))
    cut = placed.join(F.broadcast(sizes), "list").withColumn(
        "cell", F.pmod(F.xxhash64("id", "vec"), F.col("cells"))
    )
    grouped = cut.groupBy("list", "cell").agg(F.collect_list(F.struct("id", "vec")).alias("rows"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for where, rows in zip(frame["list"], frame["rows"]):
                ids = np.array([r["id"] for r in rows], np.int64)
                x = np.stack([r["vec"] for r in rows]).astype(exact)
                turned = (x.astype(np.float64) @ turn).astype(np.float32)
                groups = [turned[:, i : i + COLUMNS].tobytes() for i in range(0, x.shape[1], COLUMNS)]
                out.append((where, ids.tobytes(), x.tobytes(), groups))
            yield pd.DataFrame(out, columns=["list", "ids", "vectors", "columns"])

    return stage(grouped.mapInPandas(pack, "list int, ids binary, vectors binary, columns array<binary>"))


class Best:
    """The k nearest so far of a batch of queries, by (distance, id)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turned: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.turned, self.k = ids, vectors, turned, k
        self.near = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def scan(self, ids: np.ndarray, vectors: np.ndarray, groups: list[np.ndarray], slack: float) -> None:
        dims = vectors.shape[1]
        for lo in range(0, len(ids), PIECE):
            part = slice(lo, lo + PIECE)
            radius = self.near[:, -1] ** 2
            seen, i, j, so_far = 0, None, None, None
            for g, columns in enumerate(groups):
                x = columns[part].astype(np.float64)
                q = self.turned[:, g * COLUMNS : g * COLUMNS + x.shape[1]]
                if g == 0:
                    d = np.maximum(_distances(x, q), 0.0)
                    own = ids[part][:, None] == self.ids[None, :]
                else:
                    so_far = so_far + ((x[i] - q[j]) ** 2).sum(axis=1)
                seen += x.shape[1]
                allow = (1.0 + slack / math.sqrt(seen)) ** 2 * seen / dims if seen < dims else 1.0 + 1e-5
                if g == 0:
                    i, j = np.nonzero((d <= allow * radius[None, :] + 1e-9) & ~own)
                    so_far = d[i, j]
                else:
                    keep = so_far <= allow * radius[j] + 1e-9
                    i, j, so_far = i[keep], j[keep], so_far[keep]
                if not len(i):
                    break
            if len(i):
                gap = vectors[part][i].astype(np.float64) - self.vectors[j]
                self._add(j, np.sqrt((gap * gap).sum(axis=1)), ids[part][i])

    def _add(self, j: np.ndarray, near: np.ndarray, who: np.ndarray) -> None:
        for q in np.unique(j):
            new = j == q
            d = np.concatenate([self.near[q], near[new]])
            w = np.concatenate([self.who[q], who[new]])
            order = np.lexsort((w, d))[: self.k]
            self.near[q], self.who[q] = d[order], w[order]

    def load(self, known: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Go on from what other blocks gave."""
        for q, key in enumerate(self.ids.tolist()):
            if key in known:
                self.near[q], self.who[q] = known[key]

    def save(self, known: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        known.update(zip(self.ids.tolist(), zip(self.near, self.who)))


def search(
    index: DataFrame, queries: DataFrame, centroids: np.ndarray, probes: int, k: int, slack: float = 2.1
) -> DataFrame:
    """The k nearest of each query (id, vec), ranked from 1."""
    lists, dims = centroids.shape
    turn, exact = rotation(dims), _exact(queries)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                order = np.argsort(_distances(np.stack(frame["vec"]).astype(np.float64), centroids), axis=1)
                for i in range(0, len(frame), BLOCK):
                    part, top = frame.iloc[i : i + BLOCK], order[i : i + BLOCK, :probes]
                    yield pd.DataFrame({
                        "list": top.ravel().astype(np.int32),
                        "id": np.repeat(part["id"].to_numpy(), top.shape[1]),
                        "vec": [v for v in part["vec"] for _ in range(top.shape[1])],
                    })

    asked = queries.mapInPandas(probe, f"list int, id long, vec {dict(queries.dtypes)['vec']}")
    sizes = stage(asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("batches")))
    batches = (
        asked.join(F.broadcast(sizes), "list")
        .withColumn("batch", F.pmod(F.xxhash64("id"), F.col("batches")))
        .groupBy("list", "batch").agg(F.collect_list(F.struct("id", "vec")).alias("asked"))
    )

    def told(known: dict[int, tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        near, who = (np.stack([v[i] for v in known.values()]) for i in (0, 1))
        found = np.isfinite(near)
        ids = np.repeat(np.fromiter(known, np.int64, len(known)), found.sum(axis=1))
        return pd.DataFrame({"query_id": ids, "vec_id": who[found], "score": near[found]})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # a query's best so far narrows later blocks
        for frame in frames:
            for asked, ids, vectors, groups in zip(frame["asked"], frame["ids"], frame["vectors"], frame["columns"]):
                q = np.stack([r["vec"] for r in asked]).astype(np.float64)
                best = Best(np.array([r["id"] for r in asked], np.int64), q, q @ turn, k)
                best.load(known)
                own = np.frombuffer(ids, np.int64)
                x = np.frombuffer(vectors, exact).reshape(len(own), dims)
                best.scan(own, x, [np.frombuffer(c, np.float32).reshape(len(own), -1) for c in groups], slack)
                best.save(known)
                if len(known) > KNOWN:
                    yield told(known)
                    known.clear()
        if known:
            yield told(known)

    found = batches.join(index, "list").select("asked", "ids", "vectors", "columns").mapInPandas(
        scan, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(
    df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10,
    sample: int = 20_000, recall: float = 0.97,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows of ``df``."""
    rows, asked = usable(df, key, vector), usable(queries, key, vector)
    if _exact(rows) != _exact(asked):
        rows, asked = (t.withColumn("vec", F.col("vec").cast("array<double>")) for t in (rows, asked))
    rows = stage(rows)
    least = F.min(F.struct(F.size("vec").alias("n"), "vec")).alias("least")
    asked = stage(asked.groupBy("id").agg(least).select("id", "least.vec"))
    found = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in sorted(r["n"] for r in asked.select(F.size("vec").alias("n")).distinct().collect()):
        mine = rows.where(F.size("vec") == length)
        centroids, probes = fit(mine, k, sample, recall)
        if probes:
            told = asked.where(F.size("vec") == length)
            best = search(build(mine, centroids), told, centroids, probes, k)
            found = found.unionByName(best.select("query_id", "rank", "vec_id", "score"))
    return found
