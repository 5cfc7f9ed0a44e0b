"""Asking the whole corpus about keys, block by block.

Some facts about a text depend on all others: how often its n-grams occur, where its
word sequences occur first. Documents are packed into blocks of bounded size; each
block asks about its distinct 64-bit keys, packed by key range; a task per range
gathers what all blocks say and answers each of them. A key is asked once per block,
so a key that every document has is no heavier than the number of blocks, and what
travels is a few bytes per key.

The packed blocks are written once, so that a lost executor cannot change what is in
a block; steps of one query that bring answers to them share one exchange.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from ratebook.llm.common import stage_texts

BLOCK_BYTES = 8 << 20
U = np.uint64
_BASE = U(0x2545F4914F6CDD1B)
ASK = "bucket int, block long, keys binary, told binary"
ANSWER = "block long, bucket int, answer binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = U(1)
    return np.multiply.accumulate(out, dtype=U)


_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each slice of ``values``: equal slices have equal names."""
    total = np.append(U(0), np.add.accumulate(values * _powers(len(values), _BASE), dtype=U))
    back = _powers(len(values) + 1, _INVERSE)
    return mix((total[ends] - total[starts]) * back[starts] + mix((ends - starts).astype(U)))


@dataclass
class Block:
    """Documents as codes into a block's own list of words."""

    rows: dict[str, list]
    ends: np.ndarray  # words up to and with each document
    codes: np.ndarray
    words: bytes  # all different words, joined by spaces

    @staticmethod
    def load(payload: bytes) -> Block:
        return Block(*pickle.loads(zlib.decompress(payload)))

    def dump(self) -> bytes:
        return zlib.compress(pickle.dumps((self.rows, self.ends, self.codes, self.words)), 1)

    def names(self) -> np.ndarray:
        """A 64-bit name of each different word."""
        raw = np.frombuffer(self.words, np.uint8)
        if not len(raw):
            return np.zeros(0, U)
        gaps = np.flatnonzero(raw == 32)
        return spans(raw.astype(U) + U(1), np.append(0, gaps + 1), np.append(gaps, len(raw)))

    def __len__(self) -> int:
        return len(self.ends)


def pack(docs: DataFrame, text: Column, columns: list[Column], schema: str, lower: bool = False, size: int = BLOCK_BYTES) -> DataFrame:
    """Blocks (block, payload) of all rows, written; words are split at ASCII white space.

    ``columns`` travel along, of the simple types that ``schema`` gives; with ``lower``
    A-Z are lowered. A block holds ``size`` bytes of text, or one longer text.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 24, count()
        rows, ends, codes, seen, held = {c: [] for c in names}, [], [], defaultdict(count().__next__), 0

        def flush() -> pd.DataFrame:
            block = Block(
                rows, np.cumsum(ends, dtype=np.int64),
                np.concatenate(codes) if codes else np.zeros(0, np.int32), b" ".join(seen),
            )
            return pd.DataFrame({"block": [first + next(made)], "payload": [block.dump()]})

        for frame in frames:
            kept = [[None if v is None or v is pd.NA or v != v else v for v in frame[c].tolist()] for c in names]
            for i, raw in enumerate(frame["_text"]):
                raw = raw.lower() if lower and raw else raw
                own = np.fromiter(map(seen.__getitem__, raw.split()), np.int32) if raw else np.zeros(0, np.int32)
                for c, values in zip(names, kept):
                    rows[c].append(values[i])
                ends.append(len(own))
                codes.append(own)
                held += len(raw or b"")
                if held >= size:
                    yield flush()
                    rows, ends, codes, seen, held = {c: [] for c in names}, [], [], defaultdict(count().__next__), 0
        if ends:
            yield flush()

    raw = docs.select(*[c.alias(n) for c, n in zip(columns, names)], text.cast("binary").alias("_text"))
    return stage_texts(raw.mapInPandas(packed, "block long, payload binary"))


def bits_for(docs: DataFrame) -> int:
    """Key ranges as a power of two: four for each shuffle partition or more."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, (4 * parts - 1).bit_length())


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones: high bytes compress to little."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: type | np.dtype) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def split_keys(block: int, keys: np.ndarray, told: np.ndarray, bits: int, width: type = np.uint64) -> pd.DataFrame:
    """Rows of :data:`ASK` for sorted keys; narrower keys keep the bits below the range's."""
    bucket = (keys >> U(64 - bits)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys))
    sent = keys if width is np.uint64 else ((keys << U(bits)) >> U(64 - 8 * np.dtype(width).itemsize)).astype(width)
    return pd.DataFrame({
        "bucket": bucket[edges[:-1]].astype(np.int32),
        "block": block,
        "keys": [planes(np.diff(sent[a:b], prepend=sent.dtype.type(0))) for a, b in zip(edges, edges[1:])],
        "told": [planes(told[a:b]) for a, b in zip(edges, edges[1:])],
    })


def ask(blocks: DataFrame, work: Callable[[int, Block], pd.DataFrame]) -> DataFrame:
    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, payload in zip(frame["block"], frame["payload"]):
                yield work(int(number), Block.load(payload))

    return blocks.mapInPandas(asked, ASK)


def answer(
    asks: DataFrame,
    width: type,
    told: type | np.dtype,
    work: Callable[[np.ndarray, np.ndarray], Callable[[slice], bytes]],
    total: Callable[[np.ndarray, np.ndarray], bytes] | None = None,
) -> DataFrame:
    """``work`` gets all keys of a range and what was told; it returns the answer to a slice.

    ``total`` sums up a range; its rows have block -1.
    """

    def answered(part: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unplanes(k, width), dtype=width) for k in part["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        everything = np.concatenate(keys), np.concatenate([unplanes(t, told) for t in part["told"]])
        reply = work(*everything)
        rows = [
            (block, reply(slice(a, b))) for block, a, b in zip(part["block"], np.append(0, ends[:-1]), ends)
        ]
        if total:
            rows.append((-1, total(*everything)))
        out = pd.DataFrame(rows, columns=["block", "answer"])
        return out.assign(bucket=part["bucket"].iloc[0])[["block", "bucket", "answer"]]

    return asks.groupBy("bucket").applyInPandas(answered, ANSWER)


def settle(
    blocks: DataFrame, answers: DataFrame, schema: str, work: Callable[[int, Block, list[bytes]], pd.DataFrame]
) -> DataFrame:
    """Each block together with its answers, in order of key."""

    def settled(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            raise RuntimeError("answers without their block")
        replies = told.sort_values("bucket")["answer"].tolist()
        return work(int(own["block"].iloc[0]), Block.load(own["payload"].iloc[0]), replies)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(settled, schema)
