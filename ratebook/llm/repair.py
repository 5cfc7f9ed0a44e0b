"""Mending the turn structure of conversations by square-root checkpointed dynamic programming.

A conversation is legal if its role initials read ``(s?(ua)+)?``. Its rows are walked by
edits: Keep costs 0, Rerole to user or assistant 2, Delete 3 (the only choice for blank
and duplicate rows), Insert of an empty user or assistant row 2, and every truncated row
that stays adds 1. Four states say what was written last: nothing, a system row, a user
row, an assistant row.

A conversation of n rows is cut into blocks of about sqrt(n) rows. Each block's backward
step is a 4 x 4 matrix of least costs; these are multiplied from the last block to the
first, and only the state-cost vectors between blocks, the checkpoints, are kept. Then
each block, in a task of its own, recomputes the vectors between its rows from its
checkpoint and walks forward through tight edits, the ASCII-least letter first, from each
of the four states; the walks are chained by their end states. So a task holds a block's
rows or a conversation's checkpoints, both about sqrt(n), however long the conversation.
From a state a letter leads to one state only, so the greedy walk is the least string.

Only the checksum of the mended text has to read a conversation in one piece: SHA-256 is
sequential. It is streamed, block by block, over sorted rows.

Defined results: NULL roles and texts are one space; a NULL conversation id is one
conversation; rows go by turn, NULL first, ties by role and text; a role counts by its
first letter; other letters are never kept, only reroled or deleted; equal rows after
the first are duplicates; blank comes before duplicate before truncated. No rows give no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratebook.llm.sharding import number
from ratebook.operators.staging import stage

LEAST_BLOCK = 16  # rows; longer conversations have blocks of sqrt(n) rows
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
NEVER = 1 << 40
WHITE = " \\t\\n\\u000B\\f\\r"
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
AFTER = np.array([2, 2, 3, 2])  # the state after the only role that may follow, a user's or an assistant's
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # by state and initial (s, u, a, other)
ENDING = np.array([0, 2 * INSERT, INSERT, 0])  # what it costs to end
CLEAN, TRUNCATED, GONE = 0, 1, 2
KINDS = {
    "_matrix": "binary",
    "_checkpoints": "cost long, ahead array<binary>",
    "_walk": "audits array<string>, ends array<int>",
    "_chain": "starts array<int>, audits array<string>",
    "_acts": "array<struct<before:string,act:string,behind:string>>",
}
HELD = 1 << 18  # rows, padded, that a task computes with at once


def _best(ahead: np.ndarray, initial: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, ...]:
    """Costs (rows, 4 states, ...) of the edits of one row each, given those of what follows."""
    shape = (-1, 1) + (1,) * (ahead.ndim - 2)
    stays = np.where(fault == GONE, NEVER, np.where(fault == TRUNCATED, CUT, 0)).reshape(shape)
    to = KEPT.T[initial]
    index = np.maximum(to, 0).reshape(to.shape + (1,) * (ahead.ndim - 2))
    keep = KEEP + stays + np.take_along_axis(ahead, np.broadcast_to(index, ahead.shape), 1)
    keep = np.where((to < 0).reshape(index.shape), NEVER, keep)
    rerole = REROLE + stays + ahead[:, AFTER]
    delete = DELETE + ahead
    base = np.minimum(np.minimum(keep, rerole), delete)
    once = np.minimum(base, INSERT + base[:, AFTER])
    return np.minimum(once, 2 * INSERT + base[:, AFTER[AFTER]]), delete, keep, rerole


def _alike(codes: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of similar lengths: their places, initials and faults (padded), and lengths."""
    every = codes.str.len().to_numpy(np.int64)
    order, start = np.argsort(every, kind="stable"), 0
    while start < len(order):
        sizes = every[order[start:]]
        take = max(1, int((np.maximum(sizes, 1) * np.arange(1, len(sizes) + 1) <= HELD).sum()))
        at, lengths = order[start : start + take], sizes[:take]
        flat = np.zeros((take, max(1, int(lengths[-1]))), np.int64)
        for row, text in zip(flat, codes.iloc[at]):
            row[: len(text)] = np.frombuffer(text.encode(), np.uint8) - 65
        yield at, flat // 3, flat % 3, lengths
        start += take


def _matrix(codes: pd.Series) -> pd.Series:
    """The least costs from each state before a block to each state after it."""
    out = [b""] * len(codes)
    for places, initial, fault, lengths in _alike(codes):
        cost = np.full((len(places), 4, 4), NEVER, np.int64)
        cost[:, range(4), range(4)] = 0
        for at in range(initial.shape[1] - 1, -1, -1):
            on = lengths > at
            cost[on] = np.minimum(_best(cost[on], initial[on, at], fault[on, at])[0], NEVER)
        for i, c in zip(places, cost):
            out[i] = c.tobytes()
    return pd.Series(out)


def _checkpoints(matrices: pd.Series) -> pd.DataFrame:
    """Least costs of whole conversations, and the state-cost vector behind each block."""
    rows = []
    for blocks in matrices:
        vector, kept = ENDING.astype(np.int64), []
        for raw in reversed(list(blocks)):
            kept.append(vector.tobytes())
            vector = (np.frombuffer(raw, np.int64).reshape(4, 4) + vector[None, :]).min(axis=1)
        rows.append((int(vector[0]), kept[::-1]))
    return pd.DataFrame(rows, columns=["cost", "ahead"])


def _walk(codes: pd.Series, ahead: pd.Series) -> pd.DataFrame:
    """The ASCII-least tight edits of each block from each state, and where they end."""
    audits, ends = [[]] * len(codes), [[]] * len(codes)
    for places, initial, fault, lengths in _alike(codes):
        n, most = initial.shape
        cost = np.stack([np.frombuffer(ahead.iloc[i], np.int64) for i in places])
        vectors, edits = [], []
        for at in range(most - 1, -1, -1):
            on = lengths > at
            got = _best(cost, initial[:, at], fault[:, at])
            cost = np.where(on[:, None], got[0], cost)
            vectors.append(cost)
            edits.append(got[1:])
        state = np.tile(np.arange(4), (n, 1))
        letters = np.zeros((n, 4, 3 * most), np.uint8)
        each = np.arange(n)[:, None]
        for at in range(most):
            vector, (delete, keep, _) = vectors.pop(), edits.pop()
            todo = np.broadcast_to((lengths > at)[:, None], state.shape)
            for turn in range(3):
                now = vector[each, state]
                gone = todo & (delete[each, state] == now)
                put = todo & ~gone & (INSERT + vector[each, AFTER[state]] == now) & (turn < 2)
                held = todo & ~gone & ~put & (keep[each, state] == now)
                other = todo & ~gone & ~put & ~held
                letters[:, :, 3 * at + turn] = 68 * gone + 73 * put + 75 * held + 82 * other
                kept = KEPT[state, initial[:, at][:, None]]
                state = np.where(put | other, AFTER[state], np.where(held, kept, state))
                todo = put
        for i, walks, to in zip(places, letters, state):
            audits[i] = [w.tobytes().replace(b"\0", b"").decode() for w in walks]
            ends[i] = to.astype(np.int32)
    return pd.DataFrame({"audits": audits, "ends": ends})


def _chain(ends: pd.Series, audits: pd.Series) -> pd.DataFrame:
    """The state before each block of a conversation and its edits; what is missing at the end is inserted."""
    rows = []
    for to, said in zip(ends, audits):
        state, starts, own = 0, [], []
        for after, walks in zip(to, said):
            starts.append(state)
            own.append(walks[state])
            state = int(after[state])
        if own:
            own[-1] += "I" * int(ENDING[state] // INSERT)
        rows.append((starts, own))
    return pd.DataFrame(rows, columns=["starts", "audits"])


def _acts(audit: pd.Series, start: pd.Series, codes: pd.Series) -> pd.Series:
    """What an audit does to each row: rows put before it; K, D or its new role; rows put behind the last."""
    out = []
    for edits, state, letters in zip(audit, start, codes):
        rows, before = [], []
        for letter in edits:
            role = "assistant" if state == 2 else "user"
            if letter == "I":
                before.append(f"{role}:")
                state = AFTER[state]
                continue
            if letter == "K":
                state = KEPT[state, (ord(letters[len(rows)]) - 65) // 3]
            elif letter == "R":
                state = AFTER[state]
            rows.append(["\n".join(before), role if letter == "R" else letter, ""])
            before = []
        if before and rows:
            rows[-1][2] = "\n".join(before)
        out.append([dict(zip(("before", "act", "behind"), r)) for r in rows])
    return pd.Series(out)


def _by(work: Callable) -> Callable[..., Column]:
    return F.pandas_udf(work, KINDS[work.__name__])


def _in_order(value: Column, by: str = "block") -> Column:
    """The values of a group, sorted."""
    return F.transform(F.array_sort(F.collect_list(F.struct(by, value.alias("v")))), lambda s: s["v"])


def _digests(pieces: DataFrame) -> DataFrame:
    """(conv, sha): the checksum of each conversation's pieces, sorted and joined by line feeds."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None
        for frame in frames:
            done = []
            for name, piece in zip(frame["conv"], frame["piece"]):
                if name == conv:
                    state.update(b"\n")
                else:
                    if state:
                        done.append((conv, state.hexdigest()))
                    conv, state = name, hashlib.sha256()
                state.update(piece.encode())
            yield pd.DataFrame(done, columns=["conv", "sha"])
        if state:
            yield pd.DataFrame([(conv, state.hexdigest())], columns=["conv", "sha"])

    dealt = pieces.repartition("conv").sortWithinPartitions("conv", "block")
    return dealt.select("conv", "piece").mapInPandas(digest, "conv string, sha string")


def damage(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by a checksum of each row's id and turn."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col(key).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    rows = df.select(
        F.col(key).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
        (F.crc32(F.encode(named, "UTF-8")) % 20).alias("_lot"),
    ).where("_lot <> 0")
    cut = F.regexp_replace("text", "[.!?]", "")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("_lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_lot") == 1, "").when(F.col("_lot") == 2, cut).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_lot") == 3, 2).otherwise(1))).alias("_again"),
    ).drop("_again")


def conv_key(key: str) -> Column:
    """A conversation's name as text; NULL has one of its own."""
    return F.concat(F.when(F.col(key).isNull(), "n").otherwise("c"), F.coalesce(F.col(key).cast("string"), F.lit("")))


def judged(df: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, pos, first fault), numbered in their conversation; written."""
    space = F.lit(" ")
    rows = number(
        df.select(conv_key("conv_id").alias("conv"), "turn", *[F.coalesce(c, space).alias(c) for c in ("role", "text")]),
        "conv", ["turn", "role", "text"], "pos",
    )
    named = rows.withColumn("_name", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = (
        named.groupBy("conv", "_name").agg(F.min("pos").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1").drop("_n")
    )
    end = F.expr(f"trim(TRAILING '{WHITE}' FROM text)")
    fault = (
        F.when(F.length(end) == 0, "blank").when(F.col("pos") > F.col("_first"), "duplicate")
        .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return stage(named.join(first, ["conv", "_name"], "left").withColumn("fault", fault).drop("_name", "_first"))


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of :func:`judged` with what is done to them, and (conv, cost, illegal, audit).

    The rows gain ``act`` (K, D or a new role), ``before`` and ``behind`` (lines put
    around them).
    """
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt("n"))).cast("long")
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.left("role", F.lit(1))), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.length("role") == 0, 3).otherwise(initial)
    gone = F.when(F.col("fault") == "truncated", TRUNCATED).when(F.col("fault").isNotNull(), GONE).otherwise(CLEAN)
    placed = stage(
        rows.join(sizes, "conv").withColumns({
            "block": F.floor(F.col("pos") / size), "place": (F.col("pos") % size).cast("int"),
            "code": F.chr(F.lit(65) + 3 * initial + gone),
        }).drop("n")
    )
    blocks = placed.groupBy("conv", "block").agg(F.array_join(_in_order(F.col("code"), "place"), "").alias("codes"))
    blocks = stage(blocks.withColumn("matrix", _by(_matrix)("codes")))
    roles = F.translate("codes", "ABCDEFGHIJKL", "sssuuuaaaooo")
    pairs = F.length("_roles") - 1 - sum(F.regexp_count("_roles", F.lit(f"{p[0]}(?={p[1]})")) for p in ("su", "ua", "au"))
    whole = stage(
        blocks.withColumn("_roles", roles).groupBy("conv").agg(
            _in_order(F.col("matrix")).alias("matrices"), F.sum(pairs).alias("inside"),
            _in_order(F.concat(F.left("_roles", F.lit(1)), F.right("_roles", F.lit(1)))).alias("edges"),
        ).withColumn("told", _by(_checkpoints)("matrices"))
    )
    seams = F.transform(
        F.sequence(F.lit(2), F.size("edges")),
        lambda i: F.concat(F.right(F.element_at("edges", i - 1), F.lit(1)), F.left(F.element_at("edges", i), F.lit(1))),
    )
    seams = F.when(F.size("edges") > 1, F.size(F.filter(seams, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    ahead = whole.select("conv", F.posexplode("told.ahead").alias("_at", "ahead"))
    walked = stage(
        blocks.drop("matrix").join(ahead, (blocks["conv"] == ahead["conv"]) & (blocks["block"] == ahead["_at"]))
        .select(blocks["conv"], "block", "codes", _by(_walk)("codes", "ahead").alias("walk"))
    )
    chained = stage(
        walked.groupBy("conv").agg(_in_order(F.col("walk.ends")).alias("ends"), _in_order(F.col("walk.audits")).alias("audits"))
        .select("conv", _by(_chain)("ends", "audits").alias("told"))
    )
    own = chained.select("conv", F.posexplode(F.arrays_zip("told.starts", "told.audits")).alias("block", "own"))
    acts = walked.join(own.withColumn("block", F.col("block").cast("long")), ["conv", "block"]).select(
        "conv", "block", F.posexplode(_by(_acts)("own.audits", "own.starts", "codes")).alias("place", "_act")
    )
    edited = placed.join(acts, ["conv", "block", "place"]).select(*placed.columns, "_act.*")
    totals = whole.select("conv", "told.cost", (F.col("inside") + seams).alias("illegal")).join(
        chained.select("conv", F.array_join("told.audits", "").alias("audit")), "conv"
    )
    return edited, totals


def repair(df: DataFrame) -> DataFrame:
    """The mended rows (conv, pos, lines): each row's lines ``role:text`` and those put around it; deleted rows have none."""
    edited, _ = repaired(judged(df))
    return edited.select("conv", "pos", _lines().alias("lines"))


def _lines() -> Column:
    role = F.when(F.col("act") == "K", F.col("role")).otherwise(F.col("act"))
    own = F.when(F.col("act") != "D", F.concat(role, F.lit(":"), F.col("text")))
    around = [F.when(F.col(c) != "", F.col(c)) for c in ("before", "behind")]
    return F.array_compact(F.array(around[0], own, around[1]))


def audit(df: DataFrame, everyone: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``everyone``: faults, cost, edits and checksum of the mended rows of ``df``."""
    rows = judged(df)
    edited, totals = repaired(rows)
    pieces = (
        edited.withColumn("lines", _lines()).where(F.size("lines") > 0)
        .groupBy("conv", "block").agg(F.array_join(F.flatten(_in_order(F.col("lines"), "pos")), "\n").alias("piece"))
    )
    faults = rows.groupBy("conv").agg(
        F.greatest(F.lit(0), F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0))).alias("span"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    turns = rows.where("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("seen"))
    told = faults.join(turns, "conv", "left").join(totals, "conv").join(_digests(pieces), "conv", "left")
    ids = everyone.select("conv_id").distinct().withColumn("conv", conv_key("conv_id"))
    zero = F.lit(0)
    return ids.join(told, "conv", "left").select(
        "conv_id", (F.coalesce("span", zero) - F.coalesce("seen", zero)).cast("long").alias("gaps"),
        *[F.coalesce(c, zero).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
