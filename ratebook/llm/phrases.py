"""Collocations from weighted acyclic automata of n-gram counts.

Texts are packed into blocks. A block's windows (language and up to ``ORDER`` words of
one piece, one window starting at each word) are sorted, and an acyclic automaton is
built over them bottom up: a finished state is looked up in a register, so equal tails
are one state; the last arcs carry counts, the weight of a path. The sorted windows are
cut at the bounds of prefix ranges first, so that each range of a block is an automaton
of its own, over its own list of words.

Words in hashed places of fewer than ``least`` words in the whole corpus are in no
candidate: windows end before them. That table has a fixed size; where it is crowded it
only spares less work.

A task per range unites the automata of all blocks: their paths are merged in order and
the weights of equal paths summed. The weight of a state's prefix is the sum below it,
which gives the counts of all shorter phrases too. A range hands on the phrases that
reach the threshold, and whatever the count those on its first and last path, whose
windows other ranges may share; these are added up. Then every candidate is composed
with the count table: its parts and the phrases inside it are looked up by joins.

Bounds of ranges come from at most about ``SAMPLE`` windows; they only balance the work.
A hot first word or pair is cut by the words behind it; one window, however frequent, is
one path per block. Words are kept as they are, not hashed, and all counts are exact.

Defined results: a NULL text is empty, a NULL language ``und``; texts without words add
nothing, rows that repeat count again; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratebook.llm.blocks import Block, pack, planes, unplanes
from ratebook.operators.staging import stage

ORDER = 4
LEAST = 30  # occurrences of a candidate
INSIDE = 80  # percent of its occurrences in a longer candidate that drop a phrase
BEST = 2000
RANGE = 2_000_000  # windows of a prefix range
SAMPLE = 16_384
PLACES = 22  # bits of the hashed table of words: half a megabyte of bits is broadcast
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]

Bound = tuple[bytes, ...]


class Windows:
    """The sorted different windows of a block: columns of ranks, and counts."""

    def __init__(self, block: Block, common: np.ndarray) -> None:
        words = block.words.split(b" ") if block.words else []
        order = sorted(np.flatnonzero(common[_place(block)]).tolist(), key=words.__getitem__)
        self.words = [words[i] for i in order]
        rank = np.zeros(len(words) + 1, np.int32)
        rank[order] = np.arange(1, len(order) + 1)
        langs = [("und" if v is None else v).encode() for v in block.rows["lang"]]
        self.langs = sorted(set(langs))
        of = {v: i for i, v in enumerate(self.langs)}
        sizes = np.diff(block.ends, prepend=0)
        lang = np.repeat(np.array([of[v] for v in langs], np.int32), sizes)
        stop = words.index(b".") if b"." in words else -1
        breaks = block.codes == stop
        starts = np.zeros(len(breaks) + 1, bool)
        starts[block.ends[:-1]] = True
        piece = np.cumsum(breaks | starts[:-1], dtype=np.int32)
        kept = ~breaks
        self.lang, self.piece, self.word = lang[kept], piece[kept], rank[block.codes[kept]]

    def __len__(self) -> int:
        return len(self.word)

    def columns(self) -> list[np.ndarray]:
        """Language and ORDER words from each word on; 0 from the piece's end or a rare word on."""
        out = [self.lang, self.word]
        for k in range(1, ORDER):
            follow = np.zeros(len(self), np.int32)
            same = (self.piece[k:] == self.piece[:-k]) & (out[-1][: max(0, len(self) - k)] > 0)
            follow[: len(same)] = np.where(same, self.word[k:], 0)
            out.append(follow)
        return out


def _place(block: Block) -> np.ndarray:
    """The place of each different word in the table of :func:`common_words`."""
    return (block.names() >> np.uint64(64 - PLACES)).astype(np.int64)


def common_words(blocks: DataFrame, least: int) -> np.ndarray:
    """Which of 2^PLACES hashed places hold ``least`` words or more: no other word can be in a candidate.

    A place holds at least as many words as each word in it occurs, so no common word
    is ever left out; rare words that share a crowded place are only kept needlessly.
    """
    slices, top = 32, 255

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for payload in frame["payload"]:
                block = Block.load(payload)
                place = _place(block)
                total = np.bincount(place, np.bincount(block.codes, minlength=len(place)), 1 << PLACES)
                parts = np.minimum(total, top).astype(np.uint8).reshape(slices, -1)
                yield pd.DataFrame({"part": range(slices), "payload": [zlib.compress(p.tobytes(), 1) for p in parts]})

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << PLACES) // slices, np.int64)
        for raw in frame["payload"]:
            total += np.frombuffer(zlib.decompress(raw), np.uint8)
        return pd.DataFrame({"part": frame["part"][:1], "payload": [np.packbits(total >= min(least, top)).tobytes()]})

    schema = "part int, payload binary"
    told = blocks.mapInPandas(held, schema).groupBy("part").applyInPandas(summed, schema)
    common = np.zeros((slices, (1 << PLACES) // slices), bool)
    for row in told.collect():  # 2^PLACES bits in all
        common[row["part"]] = np.unpackbits(np.frombuffer(row["payload"], np.uint8)).astype(bool)
    return common.ravel()


def _drawn(block: Block, share: float, seed: int) -> list[Bound]:
    """About ``share`` of a block's windows, at random."""
    draw = np.random.default_rng(seed)
    total = len(block.codes)
    words = block.words.split(b" ") if block.words else []
    out = []
    for at in draw.integers(0, max(1, total), draw.binomial(total, share)).tolist():
        doc = int(np.searchsorted(block.ends, at, "right"))
        own = [words[c] for c in block.codes[at : min(at + ORDER, int(block.ends[doc]))]]
        own = own[: own.index(b".")] if b"." in own else own
        if own:
            lang = block.rows["lang"][doc]
            out.append((("und" if lang is None else lang).encode(), *own, *[b""] * (ORDER - len(own))))
    return out


def _sorted(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in order, one a row of the result, and their summed counts."""
    top = [int(c.max(initial=0)) + 1 for c in columns]
    keys, size, key = [], 1, np.zeros(len(columns[0]), np.uint64)
    for c, t in zip(columns, top):  # few sort keys: columns are packed while they fit 64 bits
        if size * t >= 1 << 63:
            keys.append(key)
            key, size = np.zeros(len(c), np.uint64), 1
        key, size = key * np.uint64(t) + c.astype(np.uint64), size * t
    keys.append(key)
    order = np.lexsort(keys[::-1])
    first = np.zeros(len(order), bool)
    first[:1] = True
    for k in keys:
        k = k[order]
        first[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(first)
    rows = np.stack([c[order[at]] for c in columns], axis=1)
    if counts is None:
        return rows, np.diff(np.append(at, len(order)))
    return rows, np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _position(rows: np.ndarray, langs: list[bytes], words: list[bytes], bound: Bound) -> int:
    """The number of sorted rows below a bound."""
    low, high = 0, len(rows)
    for k, part in enumerate(bound):
        names, shift = (langs, 0) if k == 0 else (words, 1)
        at = bisect_left(names, part) if part or k == 0 else -1
        known = at < 0 or (at < len(names) and names[at] == part)
        at += shift
        column = rows[low:high, k]
        if not known:
            return low + int(np.searchsorted(column, at))
        low, high = low + int(np.searchsorted(column, at)), low + int(np.searchsorted(column, at, "right"))
    return low


def _freeze(first: np.ndarray, labels: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The state of each group of arcs, equal ones registered once, and the arcs of all states."""
    sizes = np.diff(np.append(first, len(labels)))
    single = sizes == 1
    arcs = (labels.astype(np.uint64) << np.uint64(32)) | values.astype(np.uint64)
    alone, place = np.unique(arcs[first[single]], return_inverse=True)
    states = np.empty(len(first), np.int64)
    states[single] = place
    register: dict[bytes, int] = {}
    kept = [alone]
    for i in np.flatnonzero(~single):
        own = arcs[first[i] : first[i] + sizes[i]]
        raw = own.tobytes()
        if raw not in register:
            register[raw] = len(alone) + len(register)
            kept.append(own)
        states[i] = register[raw]
    lengths = np.append(np.ones(len(alone), np.int64), [len(k) for k in kept[1:]])
    flat = np.concatenate(kept)
    return states, (lengths.astype(np.int32), (flat >> np.uint64(32)).astype(np.int32), flat.astype(np.uint32))


def automaton(rows: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Levels of arcs from the start state down, of sorted different rows; the last arcs' values are counts."""
    levels, values = [], counts
    for depth in range(rows.shape[1] - 1, -1, -1):
        change = np.ones(len(rows), bool)
        if depth:
            change[1:] = (rows[1:, :depth] != rows[:-1, :depth]).any(axis=1)
        else:
            change[1:] = False
        states, level = _freeze(np.flatnonzero(change), rows[:, depth], values)
        levels.append(level)
        rows, values = rows[change], states
    return levels[::-1]


def paths(levels: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
    """The label columns of all paths, in order, and their weights."""
    state, columns = np.zeros(1, np.int64), []
    for sizes, labels, values in levels:
        begin = np.cumsum(sizes) - sizes
        many = sizes[state]
        ends = np.cumsum(many)
        arc = np.arange(ends[-1]) - np.repeat(ends - many, many) + np.repeat(begin[state], many)
        columns = [np.repeat(c, many) for c in columns] + [labels[arc]]
        state = values[arc].astype(np.int64)
    return columns, state


def _dump(rows: np.ndarray, counts: np.ndarray, langs: list[bytes], words: list[bytes]) -> bytes:
    """An automaton with the languages and words it uses. A block holds less than 2^32 words."""
    used = np.unique(rows[:, 1:])
    used = used[used > 0]
    rows = rows.copy()
    rows[:, 1:] = np.where(rows[:, 1:] > 0, np.searchsorted(used, rows[:, 1:]) + 1, 0)
    named = b" ".join(words[w - 1] for w in used)
    levels = [tuple(map(planes, level)) for level in automaton(rows, counts)]
    return zlib.compress(pickle.dumps((langs, named, levels)), 1)


def packed(docs: DataFrame) -> DataFrame:
    """Blocks of lower-cased words with ``.`` between pieces."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[.,;:!?\\n-\\r]", " . ")
    return pack(docs, text, [F.col("lang")], "lang string", lower=True)


def bounds(docs: DataFrame, blocks: DataFrame) -> list[Bound]:
    """First windows of all prefix ranges but the first."""
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    share = min(1 / 256, SAMPLE / max(1.0, words))

    def picked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, payload in zip(frame["block"], frame["payload"]):
                drawn = _drawn(Block.load(payload), share, int(number))
                # Of a large input many blocks draw none: without a type an empty column is of doubles.
                yield pd.DataFrame({"bound": pd.Series([list(b) for b in drawn], dtype=object)})

    some = sorted(tuple(map(bytes, r["bound"])) for r in blocks.mapInPandas(picked, "bound array<binary>").collect())
    ranges = int(np.ceil(words / RANGE))
    return sorted({some[i * len(some) // ranges] for i in range(1, ranges)}) if some else []


def shards(blocks: DataFrame, cuts: list[Bound], common: np.ndarray) -> DataFrame:
    """(range, payload): the automaton of each block and prefix range."""
    bits = np.packbits(common)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.unpackbits(bits).astype(bool)
        for frame in frames:
            for payload in frame["payload"]:
                found = Windows(Block.load(payload), known)
                if not len(found):
                    continue
                rows, counts = _sorted(found.columns())
                at = [0, *(_position(rows, found.langs, found.words, b) for b in cuts), len(rows)]
                for part, (a, b) in enumerate(zip(at, at[1:])):
                    if a < b:
                        payload = _dump(rows[a:b], counts[a:b], found.langs, found.words)
                        yield pd.DataFrame({"range": [part], "payload": [payload]})

    return blocks.mapInPandas(cut, "range int, payload binary")


def _union(payloads: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Sorted different windows of several automata, their weights, and the names of labels."""
    loaded = []
    for raw in payloads:
        langs, named, packed_levels = pickle.loads(zlib.decompress(raw))
        levels = [tuple(map(unplanes, level, (np.int32, np.int32, np.uint32))) for level in packed_levels]
        loaded.append((langs, named.split(b" ") if named else [], *paths(levels)))
    langs = sorted({x for part in loaded for x in part[0]})
    words = sorted({x for part in loaded for x in part[1]})
    lang_of, word_of = {x: i for i, x in enumerate(langs)}, {x: i + 1 for i, x in enumerate(words)}
    columns: list[list[np.ndarray]] = [[] for _ in range(ORDER + 1)]
    for own_langs, own_words, labels, _ in loaded:
        to = np.array([0, *map(word_of.__getitem__, own_words)], np.int32)
        columns[0].append(np.array([lang_of[x] for x in own_langs], np.int32)[labels[0]])
        for k in range(1, ORDER + 1):
            columns[k].append(to[labels[k]])
    weights = np.concatenate([part[3] for part in loaded])
    del loaded, word_of
    whole = [np.concatenate(columns.pop(0)) for _ in range(ORDER + 1)]
    return *_sorted(whole, weights), langs, words


def counted(automata: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, size, f): all phrases of up to ORDER words that occur ``least`` times.

    A phrase of no words has the number of all words of its language.
    """

    def unite(part: pd.DataFrame) -> pd.DataFrame:
        rows, counts, langs, words = _union(part["payload"])
        out = []
        for depth in range(ORDER + 1):
            change = np.ones(len(rows), bool)
            change[1:] = (rows[1:, : depth + 1] != rows[:-1, : depth + 1]).any(axis=1)
            first = np.flatnonzero(change)
            total = np.add.reduceat(counts, first)
            told = (total >= least) | (depth == 0)
            told[[0, -1]] = True
            told &= rows[first, depth] > 0 if depth else True
            for i, f in zip(first[told], total[told]):
                phrase = b" ".join(words[w - 1] for w in rows[i, 1 : depth + 1])
                out.append((langs[rows[i, 0]].decode(), phrase.decode(), depth, int(f)))
        return pd.DataFrame(out, columns=["lang", "phrase", "size", "f"])

    told = automata.groupBy("range").applyInPandas(unite, "lang string, phrase string, size int, f long")
    return told.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, best: int = BEST) -> DataFrame:
    """The ``best`` phrases of each language by their weakest cut."""
    blocks = packed(docs)
    counts = stage(counted(shards(blocks, bounds(docs, blocks), common_words(blocks, least)), least))
    words = F.split("phrase", " ")
    known = counts.where("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("f").alias("held"))
    candidates = counts.where("size >= 2")
    spans = F.expr(
        "flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), "
        "s -> array_join(slice(split(phrase, ' '), s, k), ' '))))"
    )
    longer = (
        candidates.where("size >= 3").select("lang", F.explode(spans).alias("phrase"), "f")
        .groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    )
    alone = stage(
        candidates.join(longer, ["lang", "phrase"], "left")
        .where(F.coalesce(100 * _wide("longest") < inside * _wide("f"), F.lit(True))).drop("longest")
    )
    cuts = alone.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    head = F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")
    tail = F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")
    parted = cuts.withColumns({"head": head, "tail": tail})
    for side, name in (("head", "l"), ("tail", "r")):
        parted = parted.join(known.withColumnsRenamed({"part": side, "held": name}), ["lang", side])
    scored = parted.withColumn("score", F.expr("2000000BD * CAST(f AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + r)"))
    weakest = scored.groupBy("lang", "phrase", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"), "phrase")
    top = weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return top.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"),
        "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"),
    )
