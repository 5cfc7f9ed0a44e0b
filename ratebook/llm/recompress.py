"""Removing repeated passages, found by recompression.

All texts are recompressed together. A round names runs of equal tokens (once) or
adjacent pairs of a left and a right symbol (side by a bit of the symbol); a name is
a function of what it names, so equal substrings get equal names everywhere but at
their ends. For each window of 13 words the symbols that no neighbour outside the
window can change are tracked through the rounds; the first of them in the last
round that leaves any is the window's anchor. Windows with equal words have equal
anchors, and neighbouring windows mostly share one.

Anchors that only one document has are dropped; only windows whose anchor several
documents share are compared word by word (by name), which gives the first document
of each. Both questions go through :mod:`ratebook.llm.blocks`.

Defined results: a NULL text has no words; fewer than 13 words are never removed; a
NULL id neither removes nor is removed from; rows with one id do not remove each
other's words; repeats inside one document stay; an empty table gives no rows;
further columns are ignored. Names have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.llm.blocks import Block, U, ASK, answer, ask, bits_for, mix, pack, settle, spans, split_keys

WINDOW = 13
ROUNDS = 8
CHUNK = 300_000  # words worked on together


def anchors(symbols: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """The name of each window's anchor; ``windows`` are the starts."""
    low, high = windows.copy(), windows + width
    key, live = np.zeros(len(windows), U), np.arange(len(windows))
    s = symbols
    for turn in range(ROUNDS + 1):
        if not len(live):
            break
        a, b = low[live], high[live]
        key[live] = s[a] + U(turn)
        if turn == 0:  # runs: the first and the last may go on outside
            first = np.append(True, s[1:] != s[:-1])
            run = np.cumsum(first) - 1
            start = np.flatnonzero(first)
            length = np.diff(np.append(start, len(s)))
            s = np.where(length > 1, mix(s[start] + mix(length.astype(U))), s[start])
            a, b = run[a] + 1, run[b - 1]
        else:  # pairs: a right symbol in front, a left one at the end may pair with the outside
            right = ((mix(s + U(turn)) >> U(17)) & U(1)).astype(bool)
            paired = np.append(~right[:-1] & right[1:], False)
            first = np.append(True, ~paired[:-1])
            number = np.cumsum(first) - 1
            a, b = a + right[a], b - ~right[b - 1]
            kept = a < b
            live, a, b = live[kept], a[kept], b[kept]
            a, b = number[a], number[b - 1] + 1
            follower = np.append(s[1:], U(0))
            s = np.where(paired, mix(s * U(0x9E3779B97F4A7C15) + mix(follower + U(turn))), s)[first]
        kept = a < b
        live = live[kept]
        low[live], high[live] = a[kept], b[kept]
    return mix(key)


def _ids(block: Block) -> np.ndarray:
    """Ids as numbers; documents without one get a mark."""
    return np.array([np.iinfo(np.int64).min if i is None else int(i) for i in block.rows["doc_id"]], np.int64)


def _chunks(block: Block, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per group of documents: names with a mark between texts, window starts, their ids."""
    names, ids = mix(block.names()), _ids(block)
    begin = np.append(0, block.ends[:-1])
    i = 0
    while i < len(block):
        j = max(i + 1, int(np.searchsorted(block.ends, begin[i] + CHUNK, "right")))
        codes = block.codes[begin[i] : block.ends[j - 1]]
        cuts = block.ends[i : j - 1] - begin[i]
        marks = mix(np.arange(i, j, dtype=U) + U(1 << 40))
        s = np.append(np.insert(names[codes], cuts, marks[:-1]), marks[-1])
        n = block.ends[i:j] - begin[i:j]
        number = np.where(ids[i:j] == np.iinfo(np.int64).min, 0, np.maximum(0, n - width + 1))
        at = begin[i:j] - begin[i] + np.arange(j - i)
        starts = np.repeat(at - np.append(0, np.cumsum(number)[:-1]), number) + np.arange(number.sum())
        yield s, starts, np.repeat(ids[i:j], number)
        i = j


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, their least id, and whether they have several."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, ids, np.zeros(0, bool)
    low = np.minimum.reduceat(ids, first)
    return keys[first], low, low < np.maximum.reduceat(ids, first)


def repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and the digest of the words kept."""
    blocks = pack(docs, F.col("text"), [F.col("doc_id").cast("string")], "doc_id string")
    bits = bits_for(docs)

    def block_anchors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, whether several ids have them, and all windows' anchors."""
        parts = [(anchors(s, at, width), ids) for s, at, ids in _chunks(block, width)]
        keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, U)
        ids = np.concatenate([i for _, i in parts]) if parts else np.zeros(0, np.int64)
        found, _, several = _least(keys, ids)
        return found, several, keys

    def ask_anchors(number: int, block: Block) -> pd.DataFrame:
        found, several, _ = block_anchors(block)
        return split_keys(number, found, several, bits, np.uint32)

    def shared(keys: np.ndarray, several: np.ndarray):
        _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
        many = times > 1
        many[at[several]] = True
        return lambda part: np.packbits(many[at[part]]).tobytes() + int(part.stop - part.start).to_bytes(8, "little")

    def ask_windows(number: int, block: Block, replies: list[bytes]) -> pd.DataFrame:
        found, _, keys = block_anchors(block)
        flags = [np.unpackbits(np.frombuffer(r[:-8], np.uint8))[: int.from_bytes(r[-8:], "little")] for r in replies]
        wanted = np.concatenate(flags).astype(bool)[np.searchsorted(found, keys)] if len(keys) else keys.astype(bool)
        names, who, done = [], [], 0
        for s, at, ids in _chunks(block, width):
            here = wanted[done : done + len(at)]
            done += len(at)
            names.append(spans(s, at[here], at[here] + width))
            who.append(ids[here])
        if not names:
            return pd.DataFrame(columns=[c.split()[0] for c in ASK.split(", ")])
        keys, low, several = _least(np.concatenate(names), np.concatenate(who))
        return split_keys(number, keys, np.rec.fromarrays([low, several], _TOLD).view(np.ndarray), bits)

    def first_ids(keys: np.ndarray, told: np.ndarray):
        _, at = np.unique(keys, return_inverse=True)
        low = np.full(int(at.max()) + 1 if len(at) else 0, np.iinfo(np.int64).max)
        np.minimum.at(low, at, told["low"])

        def reply(part: slice) -> bytes:
            first = low[at[part]]
            hit = (first < told["low"][part]) | told["several"][part]
            return np.concatenate([keys[part][hit], first[hit].view(U)]).tobytes()

        return reply

    def cut(number: int, block: Block, replies: list[bytes]) -> pd.DataFrame:
        halves = [np.frombuffer(r, U).reshape(2, -1) for r in replies]
        known = np.concatenate([h[0] for h in halves]) if halves else np.zeros(0, U)
        first = np.concatenate([h[1] for h in halves]).view(np.int64) if halves else np.zeros(0, np.int64)
        gone = []
        for s, at, ids in _chunks(block, width):
            change = np.zeros(len(s) + 1, np.int64)
            if len(at) and len(known):
                name = spans(s, at, at + width)
                place = np.minimum(np.searchsorted(known, name), len(known) - 1)
                hit = at[(known[place] == name) & (first[place] < ids)]
                np.add.at(change, hit, 1)
                np.add.at(change, hit + width, -1)
            gone.append(np.cumsum(change)[:-1] > 0)
        removed = np.concatenate(gone) if gone else np.zeros(0, bool)
        # every text is followed by its mark
        begin = np.append(0, block.ends[:-1])
        words = np.array(block.words.split(b" ") if block.words else [], object)
        out, ids = [], [None if i is None else int(i) for i in block.rows["doc_id"]]
        for d, (a, b) in enumerate(zip(begin, block.ends)):
            kept = block.codes[a:b][~removed[a + d : b + d]]
            digest = hashlib.sha256(b" ".join(words[kept])).hexdigest()
            out.append((ids[d], b - a, b - a - len(kept), digest))
        result = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])
        result["doc_id"] = pd.array(ids, "Int64")
        return result

    anchored = answer(ask(blocks, ask_anchors), np.uint32, bool, shared)
    asked = settle(blocks, anchored, ASK, ask_windows)
    return settle(
        blocks, answer(asked, np.uint64, _TOLD, first_ids),
        "doc_id long, n_words long, n_removed long, kept_sha256 string", cut,
    )


_TOLD = np.dtype([("low", np.int64), ("several", bool)])
