"""Structure repair, phrase mining and near vectors against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratebook.llm import collisions, phrases, repair

TURNS = "conv_id long, turn long, role string, text string, pos int, block string"
ROWS = "lang string, text string, doc_id long, rank int, phrase string"


# 11 structure of conversations


def mended(rows):
    """Faults, cost, edits and lines of one conversation, by trying all edits."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, r, x in rows:
        bare = x.rstrip(" \t\n\x0b\f\r")
        faults.append(1 if not bare else 2 if (r, x) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((r, x))

    @lru_cache(None)
    def best(i, state, put):
        found = []
        name = "assistant" if state == 2 else "user"
        to = 3 if state == 2 else 2
        if i == len(rows):
            if state in (0, 3):
                return 0, "", ()
        else:
            _, role, text = rows[i]
            rest = best(i + 1, state, 0)
            found.append((rest[0] + 3, "D" + rest[1], rest[2]))
            if faults[i] in (0, 3):
                cut = faults[i] == 3
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
                if kept is not None:
                    rest = best(i + 1, kept, 0)
                    found.append((rest[0] + cut, "K" + rest[1], (f"{role}:{text}", *rest[2])))
                rest = best(i + 1, to, 0)
                found.append((rest[0] + cut + 2, "R" + rest[1], (f"{name}:{text}", *rest[2])))
        if put < 3:
            rest = best(i, to, put + 1)
            if rest:
                found.append((rest[0] + 2, "I" + rest[1], (f"{name}:", *rest[2])))
        return min(found) if found else None

    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, edits, lines = best(0, 0, 0)
    counts = [faults.count(k) for k in (1, 2, 3)]
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, sha


def talk(seed, n):
    r = random.Random(seed)
    text = ["Yes.", "No!", "", " \n", "why", "long one\n", "ok?", None, "x.y", "é…"]
    roles = ["user", "assistant", "system", "tool", None, "", "agent"]
    return [(r.choice([None, *range(n)]), r.choices(roles, [9, 9, 3, 1, 1, 1, 1])[0], r.choice(text) if r.random() < 0.7 else f"t{r.random()}.") for _ in range(n)]


def turns(spark, convs):
    return spark.createDataFrame([(c, *row, 1, "x") for c, rows in convs.items() for row in rows], TURNS)


def test_repair_is_the_least_tight_edit_string(spark):
    convs = {i: talk(i, i % 9) for i in range(120)} | {None: talk(500, 6), -5: talk(501, 40)}
    df = turns(spark, convs)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.audit(df, df).collect()}
    assert got == {c: mended(rows) for c, rows in convs.items() if rows}


def test_repair_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "LEAST_BLOCK", 1)  # blocks of sqrt(n) rows for all
    monkeypatch.setattr(repair, "HELD", 50)
    convs = {i: talk(i, i) for i in (1, 2, 5, 17, 60, 150)}
    df = turns(spark, convs)
    assert {r["conv_id"]: tuple(r)[1:] for r in repair.audit(df, df).collect()} == {c: mended(r) for c, r in convs.items()}
    lines = repair.repair(df).where("conv = 'c60'").orderBy("pos").collect()
    whole = "\n".join(x for r in lines for x in r["lines"])
    assert len(lines) == 60 and hashlib.sha256(whole.encode()).hexdigest() == mended(convs[60])[-1]


def test_damage_and_conversations_without_rows(spark):
    convs = {i: [(t, "user" if t % 2 == 0 else "assistant", f"a{t}! b.") for t in range(7)] for i in range(60)}
    gone = next(i for i in range(1000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    convs[gone] = [(0, "user", "Hi.")]
    convs[None] = [(None, None, None), (1, "user", "Hi.")]

    def damaged(c, rows):
        for t, r, x in rows:
            lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            text = "" if lot == 1 else re.sub("[.!?]", "", x or " ") if lot == 2 else x
            yield from [(t, "user" if lot == 4 else r, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)

    df = turns(spark, convs)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.audit(repair.damage(df), df).collect()}
    assert got == {c: mended(list(damaged(c, rows))) for c, rows in convs.items()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    nothing = df.limit(0)
    assert repair.audit(repair.damage(nothing), nothing).count() == 0


# 12 phrases


def mined(rows, least, best=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for s in range(len(p) - k + 1):
                    inside[p[s : s + k]] = max(inside[p[s : s + k]], a)
        found = []
        for p, a in candidates.items():
            if 100 * inside[p] < 80 * a:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:best])}
    return out


def texts(seed, count):
    r = random.Random(seed)
    words = ["of", "the", "The", "New", "york", "é", "ß x", "a" * 40, "b.c", "d,e"]
    weights = [20, 20, 5, 5, 5, 3, 3, 1, 2, 2]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(w + r.choice([" ", "\t", "  ", "\n", ". "]) for w in r.choices(words, weights, k=r.randrange(30)))) for _ in range(count)]
    return [*rows, ("en", None), ("en", ""), ("fr", " .\n"), (None, "of the " * 3000), ("en", "new york " * 50), ("en", "new york " * 50)]


@pytest.mark.parametrize("ranges", [1, 9])
def test_phrases(spark, monkeypatch, ranges):
    rows = texts(3, 300)
    total = sum(len((t or "").encode()) for _, t in rows)
    monkeypatch.setattr(phrases, "RANGE", total / 6 / ranges)
    df = spark.createDataFrame([(la, t, 1, 2, "x") for la, t in rows], ROWS).repartition(5)
    assert {tuple(r) for r in phrases.collocations(df, least=4).collect()} == mined(rows, 4)
    few = phrases.collocations(df, least=4, best=3)
    assert {tuple(r) for r in few.collect()} == mined(rows, 4, 3) and few.columns == phrases.COLUMNS
    assert phrases.collocations(df.limit(0)).count() == 0


def test_automaton_shares_equal_tails_and_keeps_all_paths():
    draw = np.random.default_rng(1)
    rows, counts = phrases._sorted([draw.integers(0, 6, 5000) for _ in range(5)])
    levels = phrases.automaton(rows, counts)
    labels, weights = phrases.paths(levels)
    assert (np.stack(labels, axis=1) == rows).all() and (weights == counts).all()
    same = np.array([[0, a, b, 7, 8] for a in range(20) for b in range(20)])
    assert [len(level[1]) for level in phrases.automaton(same, np.ones(400, np.int64))] == [1, 20, 20, 1, 1]


# 13 near vectors


def compared(rows):
    """(links, component, kept) of each row, in order."""
    fine = [la is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, la in rows]
    near = [[j for j, b in enumerate(rows) if i != j and fine[i] and fine[j] and a[2] == b[2] and len(a[1]) == len(b[1])
             and np.dot(a[1], b[1]) / np.sqrt(np.dot(a[1], a[1]) * np.dot(b[1], b[1])) >= 0.98] for i, a in enumerate(rows)]
    out = []
    for i, row in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - reach
            reach |= new
            todo += new
        least = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        out.append((row[0], len(near[i]), least, row[0] is not None and row[0] == least))
    return out


def vectors(dim, seed):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((12, dim))
    rows = []
    for i in range(260):
        c = centres[i % 12]
        v = c + draw.standard_normal(dim) * 0.12 if i % 3 else draw.standard_normal(dim)
        rows.append((i, (v * draw.uniform(0.5, 2)).tolist(), i % 12 % 5 if i % 3 else i % 5))
    rows += [(300 + i, rows[1][1], rows[1][2]) for i in range(20)] + [(400, rows[1][1], 99), (7, rows[1][1], rows[1][2])]
    nan, inf = float("nan"), float("inf")
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * dim, 1), (503, [nan] * dim, 1), (504, [inf] * dim, 1), (505, [None] * dim, 1)]
    return rows + [(506, rows[1][1], None), (None, rows[1][1], rows[1][2]), (None, [1.0] * (dim - 1), 1), (507, [2.0] * (dim - 1), 1)]


@pytest.mark.parametrize(("dim", "kind", "cell"), [(16, "double", 2048), (40, "double", 8), (16, "float", 2048)])
def test_near_vectors(spark, monkeypatch, dim, kind, cell):
    monkeypatch.setattr(collisions, "CELL", cell)
    monkeypatch.setattr(collisions, "BATCH", 200)
    rows = vectors(dim, 5)
    if kind == "float":
        rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], la) for i, v, la in rows]
    schema = f"vec_id long, embedding array<{kind}>, label int, links long, root int, cid string"
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema).repartition(7)
    got = collisions.near_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == Counter(compared(rows))
    assert collisions.near_vectors(df.limit(0)).count() == 0
    assert collisions.near_vectors(df.where(F.col("label").isNull())).count() == 1


def test_scan_keeps_its_promise():
    """Pairs at exactly the wanted cosine share a cell and collide often enough."""
    for largest in (10, 3000):
        scan = collisions.calibrate(largest, lost=0.05)
        draw = np.random.default_rng(2)
        a = draw.standard_normal((2000, 32))
        a /= np.linalg.norm(a, axis=1)[:, None]
        side = draw.standard_normal((2000, 32))
        side -= (side * a).sum(axis=1)[:, None] * a
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1)[:, None]
        directions, shifts = scan.directions(32)
        n = len(shifts)
        place = [np.floor((x @ directions[:, :n] + shifts) / scan.width).reshape(2000, scan.tables, scan.places) for x in (a, b)]
        met = (place[0] == place[1]).all(axis=2).any(axis=1)
        apart = np.abs((a - b) @ directions[:, n:])
        found = met & (apart[:, 0] <= scan.reach) & ((apart[:, 1:] <= scan.window).sum(axis=1) >= scan.needed)
        assert found.mean() > 0.93
