"""N-gram Jaccard join by chosen paths.

A text is its set of shingles, five consecutive words each (all words of a shorter
text). In each run a set chooses the shingles whose seeded hash is below
1 / (similarity * size), 1 / similarity of them on average; sets that choose one
shingle share a bucket. Two sets at the similarity share a bucket of a run with
probability of at least 1 - 1/e, and runs are repeated until the target recall. A
large bucket is split again by further chosen shingles of its members; what stays large is
compared in blocks. Large buckets of sets that are alike on average cannot be parted: near
copies meet in most of their buckets. Those that share sets become one crowd, whose sets
are compared once, in blocks, instead of once in each bucket. Small buckets are brute-forced:
minwise sketches first, then the shingle sets themselves.

A pair is counted in the first bucket that its two sets share, a crowd before all others,
so counts add up and no pair is ever written out; a bucket gives each set its number of links and the
least set of its connected part.

Equal texts are one set with a weight. Defined results: a NULL text or one without
words links to nothing; every row of an equal text, also with a repeated id, counts
as a link of the others; a NULL id never names a class unless all its rows have
none; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratebook.llm.blocks import mix, spans
from ratebook.llm.common import small, stage_texts
from ratebook.llm.components import components
from ratebook.operators.staging import stage

SHINGLE = 5
NEAR = (4, 5)  # similarity as a fraction, so that the comparison is exact
SKETCH, LEAST_EQUAL = 64, 30  # equal sketch places of a pair at 0.8: 51 on average, deviation 3.2
BUCKET = 1024
FANOUT = 4.0  # chosen shingles of a set when a large bucket is split
DEPTH = 2
_U = np.uint64
_LOW = bytes.maketrans(
    bytes(range(128)),
    bytes(b if chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)),
)


def shingles(text: str) -> np.ndarray:
    """The distinct named shingles of the folded words, sorted."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOW), np.uint8)
    edge = np.diff(np.concatenate([[0], (raw != 32).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64)
    at = spans(raw.astype(np.uint64) + _U(1), begin, end)
    n = max(1, len(at) - SHINGLE + 1)
    key = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(at))):
        key = mix(key + at[k : k + n] * _U(2 * k + 3))
    return np.unique(key)


def chosen(sets: np.ndarray, salts: np.ndarray, expect: float) -> np.ndarray:
    """Bucket keys of the shingles that a set chooses under each salt, ``expect`` on average."""
    seed = mix(salts)[:, None]
    drawn = (sets[None, :] ^ seed) * (mix(seed) | _U(1))  # names are random already
    limit = expect / max(1, len(sets))
    met = np.ones(drawn.shape, bool) if limit >= 1 else drawn < _U(int(limit * 2**64))
    return mix((drawn + seed)[met]).view(np.int64)


_A = mix(np.arange(1, SKETCH + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def sketch(sets: np.ndarray) -> bytes:
    """One byte of each of 64 minwise values."""
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(sets), 4096):
        part = (sets[i : i + 4096] >> _U(32)).astype(np.uint32)
        low = np.minimum(low, (part[None, :] * _A[:, None]).min(axis=1))
    return (mix(low.astype(np.uint64)) >> _U(56)).astype(np.uint8).tobytes()


def bytes_at(sets: np.ndarray, keys: np.ndarray) -> list[bytes]:
    """For each bucket key one byte of the sketch, at the place that the key names."""
    part, low = (sets >> _U(32)).astype(np.uint32), np.zeros(len(keys), np.uint32)
    for i, at in enumerate(keys & (SKETCH - 1)):
        low[i] = (part * _A[at]).min()
    return [bytes([b]) for b in (mix(low.astype(np.uint64)) >> _U(56)).astype(np.uint8)]


def runs_for(recall: float) -> int:
    """Runs after which a pair at the similarity has met with this probability."""
    return math.ceil(math.log(1 - recall) / -1.0)


def _prepare(text: Column, runs: int) -> Column:
    expect = NEAR[1] / NEAR[0]

    @F.pandas_udf("n int, keys array<long>, sketch binary")
    def prepare(texts: pd.Series) -> pd.DataFrame:
        rows, salts = [], np.arange(1, runs + 1, dtype=np.uint64)
        for t in texts:
            s = shingles(t) if t is not None else ()
            if len(s):
                # long texts a few runs at a time
                keys = [chosen(s, part, expect) for part in np.array_split(salts, 1 + len(s) // 100_000)]
                rows.append((len(s), np.unique(np.concatenate(keys)), sketch(s)))
            else:
                rows.append((0, np.zeros(0, np.int64), b""))
        return pd.DataFrame(rows, columns=["n", "keys", "sketch"])

    return prepare(text)


def _sets(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).view(np.int64) for t in texts])

    return sets(text)


CELL = ["key", "a", "b"]


def in_groups(
    frames: Iterator[pd.DataFrame], work: Callable[[tuple, pd.DataFrame], pd.DataFrame | None]
) -> Iterator[pd.DataFrame]:
    """Apply ``work`` to each run of rows of one cell in frames sorted by cell."""
    rest: pd.DataFrame | None = None

    def each(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cells = frame[CELL].to_numpy()
        edges = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1
        found = []
        for i, j in zip(np.append(0, edges), np.append(edges, len(frame))):
            if j - i > 1:
                out = work(tuple(cells[i]), frame.iloc[i:j])
                if out is not None and len(out):
                    found.append(out)
        if found:
            yield pd.concat(found)

    for frame in frames:
        if not len(frame):
            continue
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        last = (frame[CELL] == frame[CELL].iloc[-1]).all(axis=1).to_numpy()
        cut = len(frame) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield from each(frame.iloc[:cut])
        rest = frame.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield from each(rest)


def _earlier(key: int, keys: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Of pairs (i, j): whether they share a smaller bucket key, where they were met before."""
    own = [np.asarray(k)[np.asarray(k) < key] for k in keys]
    if len(pairs) < 2000:
        sets = [set(k.tolist()) for k in own]
        return np.array([not sets[i].isdisjoint(sets[j]) for i, j in pairs], bool)
    met = _common(own)
    return met[pairs[:, 0], pairs[:, 1]] > 0


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share, by products of 0-1 matrices in slices."""
    ids, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(times > 1) - 1
    shared = times[at] > 1
    row, at = row[shared], column[at[shared]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((times > 1).sum()), 4096):
        part = (at >= low) & (at < low + 4096)
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[part], at[part] - low] = 1.0
        out += m @ m.T
    return out


def _pairs(cell: tuple, block: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Index pairs i < j whose sizes allow the similarity and which belong to this cell."""
    i, j = np.triu_indices(len(n), 1)
    fits = np.minimum(n[i], n[j]) * NEAR[1] >= np.maximum(n[i], n[j]) * NEAR[0]
    if cell[1] != cell[2]:
        fits &= block[i] != block[j]
    return np.stack([i[fits], j[fits]], axis=1)


def _likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each cell, the sets with a partner by size and sketch that were not met before."""

    def work(cell: tuple, part: pd.DataFrame) -> pd.DataFrame | None:
        pairs = _pairs(cell, part["block"].to_numpy(), part["n"].to_numpy())
        s = np.frombuffer(b"".join(part["sketch"]), np.uint8).reshape(len(part), SKETCH)
        equal = np.concatenate(
            [(s[p[:, 0]] == s[p[:, 1]]).sum(axis=1) for p in np.array_split(pairs, 1 + len(pairs) // 65536)]
        )
        pairs = pairs[equal >= LEAST_EQUAL]
        if len(pairs):
            pairs = pairs[~_earlier(cell[0], part["keys"].tolist(), pairs)]
        keep = np.unique(pairs)
        return part.iloc[keep][[*CELL, "block", "vid"]] if len(keep) else None

    yield from in_groups(frames, work)


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each cell, each set's weighted links and the least set of its connected part."""

    def work(cell: tuple, part: pd.DataFrame) -> pd.DataFrame | None:
        n, vid = part["n"].to_numpy(np.int64), part["vid"].to_numpy(np.int64)
        pairs = _pairs(cell, part["block"].to_numpy(), n)
        sets = part["shingles"].tolist()
        if len(sets) == 2 and len(pairs):
            both = np.array([len(np.intersect1d(sets[0], sets[1], assume_unique=True))])
        elif len(pairs):
            both = np.rint(_common([np.asarray(s) for s in sets])[pairs[:, 0], pairs[:, 1]]).astype(np.int64)
        else:
            return None
        near = both * NEAR[1] >= (n[pairs[:, 0]] + n[pairs[:, 1]] - both) * NEAR[0]
        pairs = pairs[near]
        if not len(pairs):
            return None
        low = vid.copy()
        while True:  # least id of the connected part
            least = np.minimum(low[pairs[:, 0]], low[pairs[:, 1]])
            after = low.copy()
            np.minimum.at(after, pairs[:, 0], least)
            np.minimum.at(after, pairs[:, 1], least)
            if (after == low).all():
                break
            low = after
        new = pairs[~_earlier(cell[0], part["keys"].tolist(), pairs)]
        weight, links = part["weight"].to_numpy(np.int64), np.zeros(len(part), np.int64)
        np.add.at(links, new[:, 0], weight[new[:, 1]])
        np.add.at(links, new[:, 1], weight[new[:, 0]])
        out = pd.DataFrame({"vid": vid, "links": links, "low": low})
        return out[(links > 0) | (low != vid)]

    yield from in_groups(frames, work)


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def _texts_of(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(vid, shingles) of the wanted sets, read again from one row of each text."""
    wanted = small(stage(sets.select("vid", "tk").distinct()))
    one = (
        docs.select(F.md5("text").alias("tk"), "text").join(wanted, "tk").groupBy("vid").agg(F.first("text").alias("text"))
    )
    return one.select("vid", _sets(F.col("text")).alias("shingles"))


def _alike(rows: DataFrame) -> DataFrame:
    """Keys of buckets whose sets are alike on average, judged by one place of their sketches.

    Their sets share most shingles, so further paths would not part them; their pairs
    are links for the most part, and are compared at once.
    """
    equal = rows.groupBy("key", "byte").agg(F.count("*").cast("double").alias("n"))
    mean = F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))
    return equal.groupBy("key").agg(mean.alias("mean")).where("mean >= 0.5").select("key")


def _crowds(rows: DataFrame) -> DataFrame:
    """(vid, key, size): one bucket for all sets that buckets of alike sets connect.

    Its key is negative, below the keys of all other buckets. Each set has one row,
    however many of the buckets it was in.
    """
    first = rows.groupBy("key").agg(F.min("vid").alias("first"))
    edges = rows.join(first, "key").select(F.col("vid").alias("u"), F.col("first").alias("v"))
    roots = components(edges).select(F.col("u").alias("vid"), F.col("v").alias("root"))
    named = rows.select("vid").distinct().join(roots, "vid", "left")
    told = named.select("vid", (-1 - F.coalesce("root", "vid")).alias("key"))
    return told.join(told.groupBy("key").agg(F.count("*").alias("size")), "key").select("vid", "key", "size")


def buckets(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(vid, key, size): the buckets of at least two sets, large ones split by further paths."""

    def sized(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        return stage(rows.join(counts, "key").select("vid", "key", "byte", "size"))

    def named(leaves: DataFrame, alike: list[DataFrame]) -> DataFrame:
        # one bit less leaves the negative keys to crowds
        leaves = leaves.select("vid", F.shiftrightunsigned("key", 1).alias("key"), "size")
        return leaves.unionByName(_crowds(stage(reduce(DataFrame.unionByName, alike)))) if alike else leaves

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for vid, keys, own in zip(frame["vid"], frame["keys"], frame["shingles"]):
                own, salts = np.asarray(own).view(np.uint64), np.asarray(keys).view(np.uint64)
                # long texts a few buckets at a time
                parts = np.array_split(salts, 1 + len(own) * len(salts) // 2_000_000)
                new = np.unique(np.concatenate([chosen(own, part, FANOUT) for part in parts]))
                found.append(pd.DataFrame({"vid": np.full(len(new), vid), "key": new, "byte": bytes_at(own, new)}))
            if found:
                yield pd.concat(found)

    # Each row carries the byte of its set's sketch that the key names, so that judging
    # buckets joins nothing.
    place = F.pmod(F.col("key"), F.lit(SKETCH)).cast("int") + 1
    paths = sets.select("vid", "sketch", F.explode("keys").alias("key"))
    rows = sized(paths.select("vid", "key", F.substring("sketch", place, F.lit(1)).alias("byte")))
    leaves, crowded = rows.where(F.col("size") <= BUCKET), []
    for depth in range(DEPTH + 1):
        large = rows.where(F.col("size") > BUCKET)
        if large.isEmpty():
            break
        alike = small(stage(_alike(large)))
        crowded.append(large.join(alike, "key", "left_semi"))
        large = large.join(alike, "key", "left_anti")
        if depth == DEPTH:
            leaves = leaves.unionByName(large)
            break
        # A set meets its shingles once, with all its large buckets.
        own = stage(large.groupBy("vid").agg(F.collect_list("key").alias("keys")))
        texts = stage_texts(_texts_of(docs, own.select("vid").join(sets.select("vid", "tk"), "vid")))
        parted = own.join(texts, "vid").mapInPandas(split, "vid long, key long, byte binary")
        rows = sized(stage_texts(parted))
        leaves = leaves.unionByName(rows.where(F.col("size") <= BUCKET))
    return named(leaves, crowded)


def tied_texts(docs: DataFrame, recall: float = 0.999999) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, tk, n) and their different texts with words, both written.

    A text is known by its md5 ``tk`` and has the least id ``rep`` of its rows, their
    number ``weight``, its ``links`` to other texts, and the ``root`` that all texts
    connected by links share.
    """
    prepared = stage_texts(
        docs.select("doc_id", F.md5("text").alias("tk"), _prepare(F.col("text"), runs_for(recall)).alias("p"))
        .select("doc_id", "tk", "p.n", "p.keys", "p.sketch")
    )
    with_words = prepared.where("n > 0")
    sets = stage(
        with_words.groupBy("tk")
        .agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"),
            F.first("keys").alias("keys"), F.first("sketch").alias("sketch"),
        )
        .withColumn("vid", F.monotonically_increasing_id())
    )
    leaves = stage(buckets(docs, sets))
    # keys are compared to find the first bucket that two sets share: all leaves of a set
    paths = leaves.groupBy("vid").agg(F.collect_list("key").alias("keys"))
    parts = F.ceil(F.col("size") / BUCKET).cast("int")
    block = F.when(F.col("size") > BUCKET, F.pmod(F.xxhash64("vid"), parts).cast("int")).otherwise(F.lit(0))
    others = F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))
    cells = leaves.select("vid", "key", block.alias("block"), F.explode(others).alias("o")).select(
        "vid", "key", "block", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b")
    )
    known = stage(sets.select("vid", "n", "weight", "tk", "sketch").join(paths, "vid"))
    compact = cells.join(known.select("vid", "n", "sketch", "keys"), "vid")
    likely = stage_texts(
        _by_cell(compact).mapInPandas(_likely, "key long, a int, b int, block int, vid long")
    )
    texts = _texts_of(docs, likely.select("vid").distinct().join(sets.select("vid", "tk"), "vid"))
    full = likely.join(texts.join(known.select("vid", "n", "weight", "keys"), "vid"), "vid")
    found = stage_texts(_by_cell(full).mapInPandas(_links, "vid long, links long, low long"))
    links = found.groupBy("vid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("vid").alias("u"), F.col("low").alias("v")))
    tied = (
        sets.select("vid", "tk", "rep", "weight")
        .join(links, "vid", "left")
        .join(joined.select(F.col("u").alias("vid"), F.col("v").alias("root")), "vid", "left")
        .withColumn("root", F.coalesce("root", "vid"))
    )
    return prepared, stage(tied)


def near_duplicates(docs: DataFrame, recall: float = 0.999999) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id, text_class, n_links.

    ``class_id`` is the least id of all texts connected by links, ``text_class`` that of
    the equal texts, ``n_links`` the number of other rows at the similarity or above.
    """
    prepared, tied = tied_texts(docs, recall)
    names = tied.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = tied.join(names, "root").select(
        "tk", "class_id", F.col("rep").alias("text_class"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    return prepared.select("doc_id", F.when(F.col("n") > 0, F.col("tk")).alias("tk")).join(
        classes, "tk", "left"
    ).select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("text_class", "doc_id").alias("text_class"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
