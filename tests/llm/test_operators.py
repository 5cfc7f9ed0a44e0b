"""Every operator on small hand-made tables: nulls, empty and long texts, ties, repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratebook.llm import (
    automaton,
    chat,
    decontaminate,
    extract,
    jaccard,
    langid,
    mixing,
    neighbours,
    recompress,
    sharding,
)
from ratebook.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _turns int, shard string"


def table(spark, rows):
    """Documents with two columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 1, "x") for i, t, la, s in rows], DOCS)


def words(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 language


def lang_rows():
    en, de = "the cat and the dog of that house with ", "der hund und die katze von dem haus mit "
    rows = [(i, f"{en if i % 2 else de}{words(i, 12, 50)}", "en" if i % 2 else "de", None) for i in range(80)]
    return [*rows, (90, None, "en", None), (91, "", "de", None), (92, "123 !?", None, None), (None, en, None, "s"), (94, de * 3000, None, "s")]


def test_language(spark):
    docs = table(spark, lang_rows())
    model = langid.fit(docs, per_lang=30, shards=2, rounds=2)
    got = langid.identify(docs, model).collect()
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == 85 and set(got[0].asDict()) >= set(docs.columns)
    assert all(told[i][0] == ("en" if i % 2 else "de") for i in range(80))
    assert [told[i] for i in (90, 91, 92)] == [("und", 0.0)] * 3
    assert told[None][0] == "en" and told[94][0] == "de"
    assert all(0 <= s <= 1 for _, s in told.values())
    again = langid.identify(docs, langid.fit(docs, per_lang=30, shards=2, rounds=2)).collect()
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in again} == told


def test_language_with_nothing_to_learn(spark, empty):
    docs = table(spark, [(1, "some words", None, None)])
    assert langid.identify(docs, langid.fit(docs)).select("lang_pred", "score").collect() == [("und", 0.0)]
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_ftrl_is_sparse_and_separates():
    z, n, f = np.zeros((4, 2)), np.zeros((4, 2)), langid.Ftrl(l1=0.5)
    for _ in range(50):
        f.step(z, n, np.array([0, 2]), np.array([1.0, 0.01]), 0)
        f.step(z, n, np.array([1, 2]), np.array([1.0, 0.01]), 1)
    w = f.weights(z, n)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0] and not w[3].any() and not w[2].any()


# 2 decontamination


def brute_contamination(docs, items, window=10):
    breaks = set(range(0x30)) | set(range(0x3A, 0x61)) | set(range(0x7B, 0x80))

    def split(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return "".join(" " if ord(c) in breaks else c for c in low).split(" ")

    clean = lambda t: [w for w in split(t) if w]
    out = []
    for i, text in docs:
        w, hit, found = clean(text), set(), set()
        for item, t in items:
            q = clean(t)
            k = min(window, len(q))
            grams = {tuple(q[s : s + k]) for s in range(len(q) - k + 1)} if q else set()
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in grams:
                    hit.update(range(s, s + k))
                    found.add("" if item is None else str(item))
        names = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination(spark):
    items = [(1, words(1, 30)), (2, words(2, 10)), (2, words(2, 10)), (3, "Tiny Item"), (4, None), (5, " ... "), (None, words(7, 14)), (10, words(1, 30)[:120])]
    base = [
        (1, words(50, 40)), (2, words(51, 8) + " " + words(1, 30) + " " + words(52, 5)), (3, None), (4, ""),
        (5, "...A tiny, ITEM!"), (5, words(2, 10)), (5, words(2, 10)), (None, "x " + words(7, 14).upper().replace(" ", "--")),
        (6, words(2, 9)), (7, (words(1, 30) + " é ") * 40), (8, "…, " + words(3, 20000)),
    ]
    docs = table(spark, [(i, t, None, None) for i, t in base])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted(map(tuple, got), key=str) == brute_contamination(base, items)


def test_contamination_of_nothing(spark, empty):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(empty, bench).count() == 0
    got = decontaminate.contamination(table(spark, [(1, "a b c", None, None)]), bench.where("false")).collect()
    assert got[0]["n_words"] == 3 and got[0]["n_hit"] == 0 and not got[0]["contaminated"]


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "rare often"), (2, "rare missing")], "item_id long, text string")
    docs = table(spark, [(1, "often a b rare often", None, None), (2, "rare a b c d e often", None, None), (3, "often x rare", None, None)])
    items = decontaminate._items(bench)
    terms = decontaminate.vocabulary(items)
    items = items.join(terms, "term").drop("term")
    postings = decontaminate.index(docs, terms)
    ids = postings.where("doc_id IS NOT NULL").select("row_id", "doc_id")
    got = decontaminate.proximity_matches(items, postings, 3).join(ids, "row_id").select("doc_id", "pos").collect()
    assert sorted(map(tuple, got)) == [(1, 3), (3, 2)]


# 3 near duplicates


def brute_links(docs):
    sets = {}
    for k, (_, t) in enumerate(docs):
        s = jaccard.shingles(t) if t is not None else ()
        sets[k] = set(np.asarray(s).tolist())
    near = {k: [j for j in sets if j != k and sets[k] and 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j])] for k in sets}
    out = []
    for k, (i, _) in enumerate(docs):
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [docs[j][0] for j in seen if docs[j][0] is not None]
        out.append((i, min(ids) if ids else None, len(near[k])))
    return sorted(out, key=str)


def near_rows():
    rows = []
    for g in range(12):
        base = words(g, 60 + 20 * g).split()
        rows.append((100 * g, " ".join(base)))
        for c in range(1, 8):
            copy, r = list(base), random.Random(100 * g + c)
            for _ in range(c // 2 * (g % 3)):
                copy[r.randrange(len(copy))] = "changed"
            rows.append((100 * g + c, " ".join(copy)))
    return [*rows, (5000, None), (5001, ""), (5002, "..."), (5003, "..."), (5004, "a b"), (5005, "A, b!"), (5004, "a b"), (None, "a b c"), (5006, words(3, 120).upper()), (5007, words(99, 30000))]


def test_near_duplicates(spark, monkeypatch):
    rows = near_rows()
    docs = table(spark, [(i, t, None, None) for i, t in rows])
    want = brute_links(rows)
    cut = lambda df: sorted(map(tuple, df.select("doc_id", "class_id", "n_links").collect()), key=str)
    assert cut(jaccard.near_duplicates(docs)) == want
    # buckets that are split again, and compared in blocks
    monkeypatch.setattr(jaccard, "BUCKET", 3)
    assert cut(jaccard.near_duplicates(docs)) == want


def crowd_rows(copies):
    """Near copies of two texts, edited more and less, and texts of their own."""
    rows = []
    for g, size in ((0, copies), (1, copies // 2)):
        base = words(500 + g, 150).split()
        for c in range(size):
            copy, r = list(base), random.Random(1000 * g + c)
            for _ in range(c % 6):
                copy[r.randrange(len(copy))] = f"changed{r.randrange(40)}"
            rows.append((1000 * g + c, " ".join(copy)))
    return rows + [(5000 + k, words(900 + k, 80)) for k in range(20)]


def test_crowds_of_near_copies(spark, monkeypatch):
    rows = crowd_rows(90)
    monkeypatch.setattr(jaccard, "BUCKET", 16)
    got = jaccard.near_duplicates(table(spark, [(i, t, None, None) for i, t in rows]))
    cut = sorted(map(tuple, got.select("doc_id", "class_id", "n_links").collect()), key=str)
    assert cut == brute_links(rows)


def test_a_crowd_holds_a_set_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 16)
    in_crowds = []
    whole = jaccard._crowds

    def crowds(found):
        in_crowds.append(whole(found))
        return in_crowds[-1]

    monkeypatch.setattr(jaccard, "_crowds", crowds)
    rows = crowd_rows(90)
    jaccard.near_duplicates(table(spark, [(i, t, None, None) for i, t in rows])).count()
    held = [r["vid"] for r in in_crowds[0].collect()]
    assert 90 <= len(held) == len(set(held)) and in_crowds[0].select("key").distinct().count() == 2


def test_no_near_duplicates(spark, empty):
    assert jaccard.near_duplicates(empty).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    part = {v: v for e in edges for v in e}
    for _ in part:
        for u, v in edges:
            part[u] = part[v] = min(part[u], part[v])
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["u"]: r["v"] for r in got} == {k: v for k, v in part.items() if k != v}


# 4 sharding


def jump_one(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, empty):
    rows = [(i, words(i, 3), None, None) for i in range(500)] + [(7, "again é", None, None), (7, "again é", None, None), (None, None, None, None)]
    got = sharding.shard_documents(table(spark, rows), 10).collect()
    assert len(got) == len(rows)
    for r in got:
        key = int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:16], 16)
        assert r["shard"] == jump_one(key, 10) and r["grown_shard"] in (r["shard"], 10)
        assert r["grown_shard"] == jump_one(key, 11)
    for s in range(10):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    want = Counter((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in rows)
    assert sizes == want
    assert sharding.shard_documents(empty).count() == 0


def test_shards_are_files(spark, tmp_path):
    docs = table(spark, [(i, "t", None, None) for i in range(100)])
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 100 and back.select("_shard").distinct().count() == 4


# 5 neighbours

VEC = "vec_id long, embedding array<float>, label int"


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 24)).astype(np.float32)
    x[40:90] = x[100]  # equal vectors
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(600)]
    odd = [(700, None, 0), (800, [0.0] * 24, 0), (900, [1.0], 0), (901, [float("nan")] * 24, 1), (1000, [None] * 24, 1), (1100, [], 2), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows + odd, VEC)
    got = neighbours.neighbours(df, df.where("vec_id % 100 = 0")).collect()
    hit = 0
    for q in range(0, 600, 100):
        mine = sorted((g["rank"], g["vec_id"], g["score"]) for g in got if g["query_id"] == q)
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(d[m[1]] == m[2] for m in mine)
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hit += len({m[1] for m in mine} & set(np.lexsort((np.arange(600), d))[:10].tolist()))
    assert len(got) == 60 and hit >= 54
    assert [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == 100] == list(range(40, 50))


def test_neighbours_in_double_precision(spark):
    rows = [(0, [0.0, 3.0]), (1, [1.0000000002, 3.0]), (2, [1.0000000001, 3.0]), (3, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.neighbours(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [
        (1, 2, 1.0000000001), (2, 1, 1.0000000002), (3, 3, math.sqrt(29.0)),
    ]


def test_neighbours_of_each_length(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [4.0, 0.0]), (100, [1.0, 1.0, 1.0]), (101, [1.0, 1.0, 3.0])]
    rows += [(200, [9.0]), (0, [7.0, 7.0, 7.0, 7.0]), (3, [7.0, 7.0, 7.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.neighbours(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    want = [(0, 1, 1, 1.0), (0, 2, 2, 3.0), (100, 1, 101, 2.0)]
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == want
    # queries in double precision against vectors in single precision
    asked = spark.createDataFrame([(100, [1.0, 0.5])], "vec_id long, embedding array<double>")
    got = neighbours.neighbours(df, asked).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(0, 0.5), (1, math.sqrt(1.25)), (2, math.sqrt(9.25))]


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0, 3.0], 0), (2, [4.0, 2.0], 0)], VEC)
    got = neighbours.neighbours(df, df.where("vec_id = 0")).select("rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1.0), (2, 2, 3.0)]
    none = df.where("false")
    assert neighbours.neighbours(none, none).columns == ["query_id", "rank", "vec_id", "score"]
    assert neighbours.neighbours(none, none).count() == 0


# 6 mixing


def test_sainte_lague():
    assert mixing.sainte_lague([53, 24, 23], 7, [99] * 3) == [3, 2, 2]
    assert mixing.sainte_lague([10, 10, 10], 4, [99] * 3) == [2, 1, 1]
    assert mixing.sainte_lague([100, 1], 10, [3, 99]) == [3, 7]
    assert mixing.sainte_lague([], 5, []) == [] and mixing.sainte_lague([0, 4], 3, [9, 9]) == [0, 3]


def test_share_out():
    assert mixing.share_out([100, 100, 100], [1, 2, 3], 3) == [50.0, 100.0, 150.0]
    assert mixing.share_out([10, 1000, 10], [1, 1, 1], 3) == [30.0, 960.0, 30.0]
    assert mixing.share_out([0, 0], [1, 2], 3) == [0.0, 0.0] and mixing.share_out([], [], 3) == []


def test_mix(spark, empty):
    rows = [(i, words(i, 5 + i % 90), None, f"s{i % 7}" if i % 7 else None) for i in range(700)]
    rows += [(1000, None, None, "s1"), (1001, "", None, "s9"), (1002, words(8, 5000), None, "s2"), (5, "twice", None, "s3"), (5, "twice", None, "s3")]
    docs = table(spark, rows)
    got = mixing.mix(docs, docs_per_shard=40).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        t = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        t[0] += r["taken"]
        t[1] += r["size"]
    assert all(t[1] == t[3] for t in by.values())
    total = sum(t[1] for t in by.values())
    assert math.isclose(sum(t[2] for t in by.values()), total)
    for taken, size, target, _ in by.values():
        assert target <= 3 * size and abs(taken - target) <= 32 * (2 + size / 500)
    assert sorted(map(str, mixing.mix(docs, docs_per_shard=40).collect())) == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0


# 7 pages


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


LONG = "A sentence of the article that is long enough to look like one, with several words in it, and more of them. "


def pages():
    out = []
    for i in range(60):
        text = "".join(f"<p>{LONG}{i}</p>" for _ in range(2 + i % 3)) + "<p>Short.</p>"
        nav = "<nav><ul>" + "".join(f'<li><a href="/{k}">w{k}</a></li>' for k in range(6)) + "</ul></nav>"
        out.append((i, "u", page(f"{nav}<div class='ad'>Buy this</div><article><h1>Head {i}</h1>{text}</article><footer>&copy; us</footer>")))
    return out


def test_extraction(spark):
    special = [
        (100, "u", None), (101, "u", ""), (102, "u", "no markup"), (103, "u", page("")),
        (104, "u", page("<article><p>A&amp;B&nbsp;c<b>d</b>\n e<br>f<script>var t='</p>';</script><p>g <!-- x --> h<div class='comments'><p>" + LONG + "</p></div></article><aside>s</aside>")),
        (105, "u", page("<header>Site</header><div id='content'><h2>Title</h2><p>" + LONG + "</p></div><div class='sidebar'><p>" + LONG + "</p></div>")),
        (106, "u", page("<article>" + "<p>x y</p>" * 5000 + "</article>")),
        (107, "u", "<article><p>cut o"), (107, "u", "<article><p>cut o"),
        (108, "u", page("<article><select><option>A<option>B</select><p>one</p><div><button>go</div><p>two</p><svg><title>t</title><g><text>v</text></g></svg> three</article>")),
        (109, "u", "<html><head><title>T</title><article><p>" + LONG + "</p></article></html>"),
    ]
    df = spark.createDataFrame(pages() + special, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract.extract(df, extract.learn(df)).collect()}
    for i in range(60):
        assert got[i] == " ".join([f"Head {i}", *[f"{LONG}{i}"] * (2 + i % 3), "Short."])
    assert [got[i] for i in (100, 101, 103)] == [""] * 3
    assert got[104] == "A&B cd e f g h"
    assert got[105] == "Title " + LONG.strip()
    assert got[106] == " ".join(["x y"] * 5000) and got[107] == "cut o"
    assert got[108] == "one two three" and got[109] == LONG.strip()


def test_extraction_without_names(spark):
    """What named pages teach holds where nothing is named."""
    tree = extract.Tree(extract.learn(spark.createDataFrame(pages(), "page_id long, url string, html string")))
    plain = pages()[5][2]
    for tag in ("article", "nav", "footer"):
        plain = plain.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
    text = tree.text(plain.replace(" class='ad'", ""))
    assert LONG.strip() in text and "Short." in text and "w3" not in text


def test_marginals_are_exact():
    """Messages give the same marginals as adding up all labellings."""
    tree = extract.Tree({})
    p = extract.parse(page("<div><p>one two</p><p><a href=x>link</a></p></div><section><h2>head</h2></section>"))
    size = len(p.tags)
    weight = np.zeros((size, 2))
    for mask in range(2**size):
        y = [mask >> i & 1 for i in range(size)]
        w = (1.0, 1e-6)[y[0]]
        for i in range(size):
            w *= math.prod(tree.node[e][y[i]] for e in extract.evidence(p, i)) * (not (y[i] and p.against[i]))
            if i:
                w *= tree.edge[extract.kind_of_parent(p, p.parents[i])][y[p.parents[i]]][y[i]]
        for i in range(size):
            weight[i, y[i]] += w
    assert np.allclose(tree.marginals(p), weight[:, 1] / weight.sum(axis=1))


# 8 repeated passages


def brute_repeats(docs, width=13):
    split = lambda t: "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ")
    lists = [(i, [w for w in split(t) if w]) for i, t in docs]
    first = {}
    for i, w in lists:
        for s in range(len(w) - width + 1) if i is not None else ():
            g = tuple(w[s : s + width])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in lists:
        gone = set()
        for s in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[s : s + width])] < i:
                gone.update(range(s, s + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    r, rows = random.Random(8), []
    passages = [words(500 + k, 13 + k, 40).split() for k in range(30)]
    for i in range(120):
        text = []
        for _ in range(r.randrange(1, 6)):
            text += words(r.random(), r.randrange(0, 30), 40).split() + r.choice(passages)[r.randrange(3) :]
        rows.append((i if i % 11 else i // 2, " ".join(text)))
    same = " ".join(["ha"] * 50)
    return [*rows, (300, same), (301, same + " ha"), (302, "ho " + same), (303, " \t\n ".join(["a"] * 12)), (304, None), (305, ""),
            (None, rows[0][1]), (306, rows[0][1]), (306, rows[0][1]), (-5, passages[3][0] + " x " + " ".join(passages[3])),
            (307, "ab " * 40), (308, "ab " * 39 + "c"), (309, words(77, 30000, 300))]


def test_repeats(spark, monkeypatch):
    rows = repeat_rows()
    docs = table(spark, [(i, t, None, None) for i, t in rows]).repartition(3)
    want = brute_repeats(rows)
    cut = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert cut(recompress.repeats(docs)) == want


def test_repeats_in_small_chunks(spark, monkeypatch):
    rows = repeat_rows()[:60]
    monkeypatch.setattr(recompress, "CHUNK", 50)
    got = recompress.repeats(table(spark, [(i, t, None, None) for i, t in rows]).coalesce(1))
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows)


def test_no_repeats(spark, empty):
    assert recompress.repeats(empty).count() == 0


def test_anchors_depend_on_the_window_alone():
    r = np.random.default_rng(3)
    inside = r.integers(1, 6, 13).astype(np.uint64)
    keys = set()
    for _ in range(200):
        text = np.concatenate([r.integers(1, 6, 20), inside, r.integers(1, 6, 20)]).astype(np.uint64)
        keys.add(int(recompress.anchors(text, np.array([20]), 13)[0]))
    assert len(keys) == 1


# 9 chats


def test_chat(spark):
    rows = [
        (1, 0, "user", "a<|im_end|>\\"), (1, 1, "user", "<|im_turn|>\\n<\\|"), (1, 2, "assistant", "b"), (1, 3, "assistant", None),
        (1, None, "system", "first"), (2, 0, None, None), (2, 0, None, None), (3, 1, "assistant", "x" * 50000), (None, 0, "user", "n"),
        (4, 0, "as<|sis\ntant", "t\n"), (5, 0, "assistant", ""),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, _turns string")
    chats = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.chat_digest(chats).collect()}
    for conv in (1, 2, 3, 4, 5, None):
        turns = sorted(((t is not None, t or 0, ro or "", te or "") for c, t, ro, te in rows if c == conv))
        told = "".join(f"{ro}\n{te}\n" for *_, ro, te in turns)
        loss = "".join(te for *_, ro, te in turns if ro == "assistant")
        g = got[conv]
        assert g["n_turns"] == len(turns)
        assert g["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = chats.where("conv_id = 1").first()
    assert one["formatted"].startswith("<|im_start|>system<|im_sep|>first<|im_end|>\n<|im_start|>user<|im_sep|>a<\\|im_end|>")
    assert one["formatted"].count("<|im_start|>") == 3 and one["formatted"].count("<|im_turn|>") == 2
    assert chat.format_chats(df.where("false")).count() == 0


# 10 language model


def test_scores(spark, empty):
    rows = [(i, words(i % 40, i % 37, 30), None, None) for i in range(200)]
    rows += [(300, None, None, None), (301, "", None, None), (None, "W1 unseen", None, None), (5, "w1 w2", None, None), (302, words(3, 20000, 30), None, None)]
    got = automaton.score(table(spark, rows).repartition(3), F.col("doc_id") % 3 != 0).collect()
    split = lambda t: ["<s>", *(t or "").lower().split(), "</s>"]
    one, two = Counter(), Counter()
    for i, t, *_ in rows:
        if i is not None and i % 3:
            one.update(split(t))
            two.update(zip(split(t), split(t)[1:]))
    n, v, k = sum(one.values()) - one["<s>"], len(one) - 1, got[0]["smoothing"]
    root = lambda w: (one[w] + 1) / (n + v + 1)
    want = []
    for i, t, *_ in rows:
        w = split(t)
        base = sum(math.log10(root(x)) for x in w[1:])
        s = sum(math.log10((two[h, x] + k * root(x)) / (one[h] + k)) for h, x in zip(w, w[1:]))
        want.append((i, len(w) - 1, sum(one[x] > 0 for x in w[1:]), n, round(base, 6), round(s, 6)))
    have = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert automaton.score(empty, F.lit(True)).count() == 0
    none = automaton.score(table(spark, [(1, "a b", None, None)]), F.lit(False)).first()
    assert none["train_tokens"] == 0 and none["score"] == none["base_score"] == 0.0


def test_longer_histories(spark):
    """Trigram probabilities of all next tokens add up to one."""
    docs = table(spark, [(i, words(i, 30, 4), None, None) for i in range(30)])
    probe = [(1000 + i, f"w1 w2 w{i}", None, None) for i in range(4)] + [(1004, "w1 w2 new", None, None), (1005, "w1 w2", None, None)]
    got = {r["doc_id"]: r["score"] for r in automaton.score(docs.union(table(spark, probe)), F.col("doc_id") < 1000, order=3, grid=(5.0,)).collect()}
    short = automaton.score(docs.union(table(spark, [(2000, "w1 w2 w0", None, None)])), F.col("doc_id") < 1000, order=2, grid=(5.0,)).collect()
    assert len(short) == 31 and all(s < 0 for s in got.values())
