"""Language-model scores: those of a weighted backoff automaton, by interpolated lookups.

In the automaton, histories seen in training are states, seen n-grams arcs, and a state
without an arc for the next token falls back along its failure arc to the history less
its oldest token. It is not built; its weights give the probabilities here. With counts c and one smoothing weight k,

    arc      P(w | h) = (c(hw) + k P(w | h')) / (c(h) + k)
    failure  weight of h = k / (c(h) + k), then P(w | h')
    root     P(w) = (c(w) + 1) / (N + V + 1)

so every state's probabilities add up to one, with the rest for words never seen. k
is the one of a grid under which the training texts are likeliest, each token left
out of the counts it is scored with.

Counts come from all training texts. Each block of documents asks for the counts of
its own n-grams (:mod:`ratebook.llm.blocks`); probabilities are then interpolated length
by length, over all positions of the block at once.

Defined results: a NULL text has the end token only; with nothing to learn from the
root is uniform; documents with one id are documents of their own, a NULL id counts
as the empty text for its fold; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratebook.llm.blocks import (
    BLOCK_BYTES,
    Block,
    U,
    answer,
    ask,
    bits_for,
    mix,
    pack,
    planes,
    settle,
    split_keys,
    unplanes,
)
from ratebook.operators.staging import released, stage

GRID = (3.0, 30.0, 300.0, 3000.0, 30000.0)
_START, _END = U(0x53544152), U(0x454E44)


class Walk:
    """A block's n-grams: for each length of ``lengths``, distinct keys and which one each position has."""

    def __init__(self, block: Block, lengths: range) -> None:
        n = len(block)
        size = np.diff(np.append(0, block.ends))
        length = size + 2  # with start and end
        self.first = np.cumsum(length) - length
        names = mix(np.concatenate([block.names(), [_START, _END]]).astype(U)) | U(1)
        token = np.full(int(length.sum()), len(names) - 2, np.int32)
        token[self.first + length - 1] = len(names) - 1
        inside = np.ones(len(token), bool)
        inside[self.first] = False
        self.scored = inside.copy()
        inside[self.first + length - 1] = False
        token[inside] = block.codes
        self.doc = np.repeat(np.arange(n, dtype=np.int32), length)
        self.start_key = names[-2]
        self.keys, self.at, self.valid = [], [], []
        if 1 in lengths:
            self.keys.append(names), self.at.append(token), self.valid.append(np.ones(len(token), bool))
        gram = names[token]
        depth = (np.arange(len(token)) - np.repeat(self.first, length)).astype(np.int32)
        for k in range(2, lengths.stop):
            gram = mix(np.append(U(0), gram[:-1]) * U(0x9E3779B97F4A7C15) + names[token]) & ~U(1)
            if k not in lengths:
                continue
            valid = depth >= k - 1
            keys, at = np.unique(gram[valid], return_inverse=True)
            full = np.zeros(len(token), np.int32)
            full[valid] = at
            self.keys.append(keys), self.at.append(full), self.valid.append(valid)

    def all_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all lengths in order, and their order."""
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """How often each key occurs at positions of this weight, keys as they stand."""
        return np.concatenate([
            np.bincount(at[v], weights=weight[v], minlength=len(k)) for k, at, v in zip(self.keys, self.at, self.valid)
        ]).astype(np.int64)


def log_probabilities(walk: Walk, counts: list[np.ndarray], n: int, v: int, k: float, left_out: bool) -> np.ndarray:
    """log10 of each scored token's probability, walked with smoothing weight ``k``.

    With ``left_out`` the token itself is taken out of all counts.
    """
    less = 1 if left_out else 0
    p = np.maximum(counts[0] - less + 1.0, 1e-3)[walk.at[0]] / (n - less + v + 1.0)
    for c, valid, history, at in zip(counts[1:], walk.valid[1:], counts, range(1, len(counts))):
        own = np.flatnonzero(valid)
        state = history[walk.at[at - 1][own - 1]]  # the history ends one token before
        seen = np.maximum(state - less, 0)
        arc = np.maximum(c[walk.at[at][own]] - less, 0)
        p[own] = (arc + k * p[own]) / (seen + k)
    return np.log10(p)


def score(docs: DataFrame, train: Column, order: int = 2, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Scores of all documents by the model of those where ``train`` holds."""
    columns = [F.col("doc_id").cast("string"), F.coalesce(train, F.lit(False)).cast("int")]
    blocks = pack(docs, F.col("text"), columns, "doc_id string, train int", lower=True, size=BLOCK_BYTES // 2)
    bits = bits_for(docs)
    # words and pairs are asked about first, then each longer length by itself: the files
    # of one round's exchange are gone before the next
    rounds = [range(1, min(2, order) + 1), *[range(k, k + 1) for k in range(3, order + 1)]]

    def learned(walk: Walk, block: Block) -> np.ndarray:
        return np.array(block.rows["train"], float)[walk.doc]

    def ask_counts(lengths: range) -> Callable[[int, Block], pd.DataFrame]:
        def asked(number: int, block: Block) -> pd.DataFrame:
            walk = Walk(block, lengths)
            keys, place = walk.all_keys()
            return split_keys(number, keys, walk.counts(learned(walk, block))[place], bits)

        return asked

    def add_up(keys: np.ndarray, told: np.ndarray):
        _, at = np.unique(keys, return_inverse=True)
        sums = np.zeros(int(at.max()) + 1, np.int64)
        np.add.at(sums, at, told)
        return lambda part: planes(sums[at[part]])

    start = mix(np.array([_START], U))[0] | U(1)

    def words(keys: np.ndarray, told: np.ndarray) -> bytes:
        """Tokens and distinct tokens of the range: keys of single tokens are odd."""
        one = (keys & U(1) == U(1)) & (keys != start) & (told > 0)
        return np.array([told[one].sum(), len(np.unique(keys[one]))], np.int64).tobytes()

    told = []
    for i, lengths in enumerate(rounds):
        with released(docs.sparkSession):
            told.append(stage(answer(ask(blocks, ask_counts(lengths)), np.uint64, np.int64, add_up, None if i else words)))
    sums = [np.frombuffer(r[0], np.int64) for r in told[0].where("block = -1").select("answer").collect()]
    n, v = (int(x) for x in (np.sum(sums, axis=0) if sums else (0, 0)))
    # the ranges of a round come after those of the rounds before it
    numbered = [t.withColumn("bucket", F.col("bucket") + (i << bits)) for i, t in enumerate(told)]
    answers = reduce(DataFrame.union, numbered)

    def walk_texts(number: int, block: Block, replies: list[bytes]) -> pd.DataFrame:
        walk = Walk(block, range(1, order + 1))
        said = np.concatenate([unplanes(r, np.int64) for r in replies])
        counts = []
        for lengths in rounds:
            own = walk.keys[lengths.start - 1 : lengths.stop - 1]
            flat = np.empty(sum(map(len, own)), np.int64)
            flat[np.argsort(np.concatenate(own), kind="stable")], said = said[: len(flat)], said[len(flat) :]
            counts += np.split(flat, np.cumsum([len(k) for k in own])[:-1])
        single = counts[0][walk.at[0]]
        by_doc = lambda x: np.add.reduceat(np.where(walk.scored, x, 0), walk.first)
        base = np.log10((counts[0] + 1.0) / (n + v + 1.0))[walk.at[0]]
        scores = [by_doc(log_probabilities(walk, counts, n, v, k, False)) for k in grid]
        trained = learned(walk, block)
        out = [by_doc(np.where(trained > 0, log_probabilities(walk, counts, n, v, k, True), 0)) for k in grid]
        return pd.DataFrame({
            "doc_id": pd.array([None if i is None else int(i) for i in block.rows["doc_id"]], "Int64"),
            "held_out": [t == 0 for t in block.rows["train"]],
            "n_tokens": by_doc(np.ones(len(single), np.int64)),
            "n_known": by_doc((single > 0).astype(np.int64)),
            "base_score": by_doc(base),
            "scores": list(np.stack(scores, axis=1)),
            "left_out": list(np.stack(out, axis=1)),
        })

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double,"
        " scores array<double>, left_out array<double>"
    )
    with released(docs.sparkSession):
        walked = stage(settle(blocks, answers.where("block >= 0"), schema, walk_texts))
    likelihood = walked.agg(*[F.sum(F.get("left_out", F.lit(i))) for i in range(len(grid))]).first()
    best = max(range(len(grid)), key=lambda i: (likelihood[i] or 0.0, -i))
    return walked.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score",
        F.get("scores", F.lit(best)).alias("score"), F.lit(grid[best]).alias("smoothing"),
    )
