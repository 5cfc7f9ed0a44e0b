"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character 1- to 3-grams of the lowered text.
Document frequencies are counted over all training documents. Weights are fitted by
follow-the-regularised-leader with L1 and L2 penalties on a bounded sample, at most
``per_lang`` rows of each language: its shards are trained side by side from the
same state and averaged, for ``rounds`` rounds. One temperature, fitted on sampled
rows that training did not see, calibrates the probabilities.

Defined results: a text that is NULL or has no letter is ``und`` with score 0, and
so is every text if there is nothing to learn from; equal probabilities go to the
first language by code point; equal texts get equal results; rows with a NULL lang
are not learned from; further columns are ignored. Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.llm.common import text_batches
from ratebook.operators.staging import stage

BITS = 16
UND = "und"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def grams(text: str) -> np.ndarray:
    """Hashed ids of all character 1- to 3-grams, in order of length."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, key = [], np.zeros(len(codes), np.uint32)
    for n in range(min(3, len(codes))):
        key = key[: len(codes) - n] * _MIX[0] + codes[n:] + np.uint32(n + 1)
        mixed = (key ^ (key >> np.uint32(15))) * _MIX[1]
        out.append((mixed ^ (mixed >> np.uint32(13))) * _MIX[2] >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


def _counts(ids: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """The distinct ids, without sorting."""
    order = np.arange(len(ids))
    scratch[ids] = order
    return ids[scratch[ids] == order]


def document_frequencies(texts: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """The number of texts and, per hashed n-gram, of texts that have it."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, scratch, n = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), 0
        for part in parts:
            for t in part[text]:
                seen[_counts(grams(t), scratch)] += 1
            n += len(part)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"id": np.append(at, -1), "n": np.append(seen[at], n)})

    found = texts.where(F.col(text).isNotNull()).select(text).mapInPandas(count, "id long, n long")
    total, out = 0, np.zeros(1 << BITS, np.int64)
    with text_batches(texts.sparkSession):
        sums = found.groupBy("id").agg(F.sum("n").alias("n")).collect()
    for r in sums:
        if r["id"] < 0:
            total = r["n"]
        else:
            out[r["id"]] = r["n"]
    return total, out


@dataclass
class Model:
    """``weights`` has a row per n-gram and a column per language; IDF is multiplied in."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Ftrl:
    """Per-coordinate learning rates; weights are a function of (z, n)."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.001
    l2: float = 0.0001

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def step(self, z: np.ndarray, n: np.ndarray, ids: np.ndarray, x: np.ndarray, y: int) -> None:
        at_z, at_n = z[ids], n[ids]
        w = self.weights(at_z, at_n)
        p = _softmax(x @ w)
        p[y] -= 1.0
        g = x[:, None] * p[None, :]
        grown = at_n + g * g
        z[ids] = at_z + g - (np.sqrt(grown) - np.sqrt(at_n)) / self.alpha * w
        n[ids] = grown


SCALE = 30.0  # of TF-IDF weights, so that steps of the given learning rate suit them


def _features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams with TF-IDF weights, and the constant feature at the end."""
    ids, counts = np.unique(grams(text), return_counts=True)
    x = SCALE * counts / max(1, counts.sum()) * idf[ids]
    return np.append(ids, len(idf)), np.append(x, 1.0)


def sample(train: DataFrame, label: str, key: Column, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of each label, by hash of the key; written."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    rate = F.lit(0.0)
    for name, n in counts.items():
        rate = F.when(F.col(label) == name, F.lit(min(1.0, per_label / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) / float(1 << 40)
    return stage(train.where(draw < rate))


def _learner(ftrl: Ftrl, state, text: str, lang: str, key: str, code: dict[str, int], turn: int):
    """One pass over a shard from the shared state; what it changed."""

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        z, n, idf = state.value
        own_z, own_n = z.copy(), n.copy()
        for t, name in part.sort_values(key).sample(frac=1.0, random_state=turn)[[text, lang]].itertuples(index=False):
            ids, x = _features(t, idf)
            ftrl.step(own_z, own_n, ids, x, code[name])
        ids = np.flatnonzero((own_n != n).any(axis=1))
        out = (ids, own_z[ids] - z[ids], own_n[ids] - n[ids])
        return pd.DataFrame({c: [v.tobytes()] for c, v in zip(("ids", "z", "n"), out)})

    return learn


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    per_lang: int = 1500,
    shards: int = 6,
    rounds: int = 3,
    ftrl: Ftrl = Ftrl(),  # noqa: B008
) -> Model:
    """Learn from all rows of ``docs`` that have a text and a language.

    Fits on at most about ``per_lang`` rows per language, a fifth of which only
    calibrate; document frequencies come from all rows.
    """
    train = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    total, seen = document_frequencies(train, text)
    if not total:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    idf = np.log((1.0 + total) / (1.0 + seen)) + 1.0
    picked = sample(train.select(text, lang, key), lang, F.col(key), per_lang).withColumn(
        "_shard", F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards * 5)).cast("int")
    )
    langs = sorted(r[0] for r in picked.select(lang).distinct().collect())
    code = {name: i for i, name in enumerate(langs)}
    shape = (len(idf) + 1, len(langs))
    z, n = np.zeros(shape), np.zeros(shape)
    spark = docs.sparkSession

    for r in range(rounds):
        state = spark.sparkContext.broadcast((z, n, idf))
        moved = (
            picked.where(F.col("_shard") < shards * 4)
            .withColumn("_shard", F.col("_shard") % shards)
            .groupBy("_shard")
            .applyInPandas(_learner(ftrl, state, text, lang, key, code, r), "ids binary, z binary, n binary")
            .collect()
        )
        steps = [[np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("z", float), ("n", float))] for row in moved]
        for ids, dz, dn in steps:
            z[ids] += dz.reshape(-1, len(langs)) / shards
            n[ids] += dn.reshape(-1, len(langs)) / shards
        state.unpersist()

    w = ftrl.weights(z, n)
    model = Model(langs, (SCALE * idf[:, None] * w[:-1]).astype(np.float32), w[-1].copy())
    model.temperature = calibrate(picked.where(F.col("_shard") >= shards * 4), model, text, lang)
    return model


def calibrate(rows: DataFrame, model: Model, text: str, lang: str) -> float:
    """The temperature with the least log loss on a bounded sample."""
    held = rows.select(lang, scored(model, F.col(text))["logits"].alias("x")).collect()
    if not held:
        return 1.0
    x = np.array([r["x"] for r in held])
    y = np.array([model.langs.index(r[0]) for r in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    loss = [-np.log(np.maximum(_softmax(x / t)[np.arange(len(y)), y], 1e-300)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def scored(model: Model, text: Column) -> Column:
    """A struct (lang_pred, score, logits) from the text alone."""
    shared = SparkSession.active().sparkContext.broadcast(
        (model.langs, model.weights, model.bias, model.temperature)
    )

    @F.pandas_udf("lang_pred string, score double, logits array<double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, weights, bias, temperature = shared.value
        rows = []
        for t in texts:
            if t is None or not langs or not any(map(str.isalpha, t)):
                rows.append((UND, 0.0, None))
                continue
            x = bias + weights.take(grams(t), axis=0).mean(axis=0, dtype=np.float64)
            p = _softmax(x / temperature)
            best = int(np.argmax(p))
            rows.append((langs[best], float(p[best]), x))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "logits"])

    return predict(text)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    s = F.col("_scored")
    return (
        docs.withColumn("_scored", scored(model, F.col(text)))
        .withColumns({"lang_pred": s["lang_pred"], "score": s["score"]})
        .drop("_scored")
    )
