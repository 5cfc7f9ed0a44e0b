"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node with a hidden label, content or not. A
node's tag, class hints, text length and link density are its evidence; the
potential between a parent's and a child's label depends on the kind of parent.
Sum-product messages, first upward and then downward, give each node's marginal,
and the text of nodes whose marginal is at least one half is the main text.

Potentials are counted on labelled pages: those whose markup names its article
(``article``, ``main``), a bounded sample of them. Half of them are learned from
with these names hidden, so that text and place count as well, and there the
navigation, adverts and footers teach what other text looks like. Elements that only
serve navigation, adverts, notices, forms or comments by tag or class are observed
as not content, and nothing inside them is.

Defined results: NULL or empty html, and pages without content, give the empty
string; broken markup is read as far as it goes (unclosed elements end with their
parent); repeated pages are pages of their own; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by their role, and class words in common use.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "script style head title noscript template svg math iframe object canvas select option button textarea "
    "audio video map datalist".split()
)
NOT_CONTENT = frozenset("nav footer aside form menu dialog fieldset".split())
NAMED = frozenset("article main".split())
HINTS_AGAINST = frozenset(
    "nav navbar navigation menu menubar header masthead topbar banner footer foot sidebar aside rail widget widgets "
    "related recommended recommendations share sharing social promo promotion promoted ad ads advert adverts "
    "advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices notification alert "
    "newsletter subscribe subscription signup login popup modal overlay breadcrumb breadcrumbs comment comments "
    "commentlist reply replies respond disqus discussion form search toolbar copyright legal disclaimer pager "
    "pagination skip hidden".split()
)
HINTS_FOR = frozenset("article articlebody content main post entry story".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
WALLS = frozenset("article main section div table ul ol dl body html".split())
TEXT_TAGS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li td th dd dt figcaption".split())


class Page(HTMLParser):
    """The block elements of a page, in document order, and their runs of text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.against, self.hinted = ["#page"], [-1], [False], [False]
        self.chars, self.linked = [0], [0]
        self.runs: list[tuple[int, list[str]]] = []
        self.open, self.links = [0], 0
        self.unseen: list[str] = []  # an unseen element and what is open inside it

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in UNSEEN:
            if tag == "option" and tag in self.unseen:  # ends the one before
                self.handle_endtag(tag)
            self.unseen.append(tag)
            return
        if tag == "br":
            self._text(" ")
        if tag in VOID:
            if tag == "hr":
                self.runs.append((self.open[-1], []))
            return
        if tag == "body" or self.unseen == ["head"]:  # ends a head that is not closed
            self.unseen = []
        if self.unseen:
            if tag not in INLINE:
                self.unseen.append(tag)
            return
        if tag in INLINE:
            self.links += tag == "a"
            return
        # a block ends an open paragraph; list items and cells end their own kind
        ends = CLOSES.get(tag, frozenset()) | {"p"}
        for k in range(len(self.open) - 1, 0, -1):
            name = self.tags[self.open[k]]
            if name in ends:
                del self.open[k:]
            elif name in WALLS:
                break
        words, hidden = set(), False
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                words.update(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value or "").lower()))
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true"
            hidden |= name == "style" and "display:none" in (value or "").replace(" ", "")
        parent = self.open[-1]
        named = tag in NAMED
        inside = any(self.tags[k] in NAMED for k in self.open)
        against = hidden or tag in NOT_CONTENT or (tag == "header" and not inside)
        against |= not named and tag not in ("html", "body") and bool(words & HINTS_AGAINST)
        self.tags.append(tag)
        self.parents.append(parent)
        self.against.append(against or self.against[parent])
        self.hinted.append(bool(words & HINTS_FOR))
        self.chars.append(0)
        self.linked.append(0)
        self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.unseen:
            del self.unseen[len(self.unseen) - 1 - self.unseen[::-1].index(tag) :]
            return
        if tag in UNSEEN:
            return
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a" and not self.unseen))
        else:
            if self.unseen and (tag == "p" or not any(self.tags[k] == tag for k in self.open)):
                return
            self.unseen = []  # left open inside the element that ends here
            for k in range(len(self.open) - 1, 0, -1):
                name = self.tags[self.open[k]]
                if name == tag:
                    del self.open[k:]
                    break
                if tag not in WALLS and name in WALLS and tag not in NOT_CONTENT:
                    break

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self._text(data)

    def _text(self, data: str) -> None:
        at = self.open[-1]
        if not self.runs or self.runs[-1][0] != at or not self.runs[-1][1]:
            self.runs.append((at, []))
        self.runs[-1][1].append(data)
        n = len(data.strip())
        self.chars[at] += n
        self.linked[at] += n if self.links else 0


def parse(html: str) -> Page:
    page = Page()
    try:
        page.feed(html)
        page.close()
    except AssertionError:  # a marked section of an unknown kind
        page = Page()
        page.feed(html.replace("<![", "&lt;!["))
        page.close()
    return page


def _step(n: int) -> int:
    return 0 if n == 0 else 1 + (n >= 25) + (n >= 100) + (n >= 400)


def evidence(page: Page, i: int, hide: bool = False) -> tuple[str, ...]:
    """A node's observed values, one per feature."""
    tag = page.tags[i]
    named = tag in NAMED
    kind = "text" if tag in TEXT_TAGS else "page" if i == 0 or tag in ("html", "body") else "box"
    n = page.chars[i]
    dense = "none" if n == 0 else "low" if page.linked[i] * 3 < n else "high"
    look = f"look={kind},{_step(n)},{dense}"
    return look, f"named={int(named and not hide)}", f"hint={int(page.hinted[i] and not hide)}"


def kind_of_parent(page: Page, i: int, hide: bool = False) -> str:
    tag = page.tags[i]
    if tag in NAMED and not hide:
        return "named"
    return "page" if i == 0 or tag in ("html", "body") else "box"


def labels(page: Page) -> list[bool] | None:
    """Whether each node is content, if the markup names the article; else None."""
    if not any(t in NAMED for t in page.tags):
        return None
    out = [False]
    for i in range(1, len(page.tags)):
        inside = page.tags[i] in NAMED or out[page.parents[i]]
        out.append(inside and not page.against[i])
    return out


def learn(pages: DataFrame, html: str = "html", key: str = "page_id", most: int = 4000) -> dict[str, float]:
    """Counted events on at most about ``most`` labelled pages, drawn by hash of the key."""
    total = pages.count()
    rate = min(1.0, most / max(1, total))
    draw = F.pmod(F.xxhash64(F.lit("pages"), key), F.lit(1 << 40)) / float(1 << 40)

    def count(parts):
        seen: Counter[str] = Counter()
        for part in parts:
            for odd, text in zip(part["_odd"], part[html]):
                page = parse(text)
                named = labels(page)
                if named is None:
                    continue
                for i, y in enumerate(named):
                    if page.against[i] and not odd:  # observed, so nothing to learn
                        continue
                    for value in evidence(page, i, odd):
                        seen[f"{value}|{int(y)}"] += 1
                    if i:
                        p = page.parents[i]
                        seen[f"{kind_of_parent(page, p, odd)}|{int(named[p])}|{int(y)}"] += 1
        yield pd.DataFrame(list(seen.items()), columns=["event", "n"])

    found = (
        pages.where(F.col(html).isNotNull() & (draw < rate))
        .select(html, (F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2)) == 1).alias("_odd"))
        .mapInPandas(count, "event string, n long")
        .groupBy("event").agg(F.sum("n").alias("n"))
    )
    return {r["event"]: float(r["n"]) for r in found.collect()}


class Tree:
    """The model: node potentials and parent-child potentials, from counts."""

    # Counts given in advance: a parent's label mostly passes on, and a named article is content.
    PRIOR = {
        "named=1|1": 50.0, "named=1|0": 0.5, "hint=1|1": 200.0, "hint=1|0": 0.5,
        "box|1|1": 200.0, "box|1|0": 1.0, "named|1|1": 200.0, "named|1|0": 1.0,
        "box|0|1": 5.0, "box|0|0": 100.0, "page|0|1": 20.0, "page|0|0": 80.0, "named|0|1": 1.0, "named|0|0": 200.0,
    }
    VALUES = {
        "look": tuple(
            f"{kind},{n},{dense}" for kind in ("text", "page", "box") for n, dense in
            [(0, "none"), *((n, d) for n in (1, 2, 3, 4) for d in ("low", "high"))]
        ),
        "named": ("0", "1"), "hint": ("0", "1"),
    }

    def __init__(self, counts: dict[str, float]) -> None:
        n = Counter(counts)
        n.update(self.PRIOR)
        self.node: dict[str, tuple[float, float]] = {}
        for feature, values in self.VALUES.items():
            events = [f"{feature}={v}" for v in values]
            sums = [sum(n[f"{e}|{y}"] + 1.0 for e in events) for y in (0, 1)]
            for e in events:
                self.node[e] = tuple((n[f"{e}|{y}"] + 1.0) / sums[y] for y in (0, 1))
        self.edge: dict[str, tuple[tuple[float, float], tuple[float, float]]] = {}
        for kind in ("named", "page", "box"):
            rows = []
            for a in (0, 1):
                pair = [n[f"{kind}|{a}|{b}"] + 0.5 for b in (0, 1)]
                rows.append((pair[0] / sum(pair), pair[1] / sum(pair)))
            self.edge[kind] = (rows[0], rows[1])

    def marginals(self, page: Page) -> list[float]:
        """Each node's probability of content: sum-product, upward and downward."""
        size = len(page.tags)
        up = []
        for i in range(size):
            off = on = 1.0
            for value in evidence(page, i):
                a, b = self.node[value]
                off, on = off * a, on * b
            up.append([off, 0.0 if page.against[i] else on])
        sent = [(1.0, 1.0)] * size
        kinds = [kind_of_parent(page, i) for i in range(size)]
        for i in range(size - 1, 0, -1):
            off, on = up[i]
            scale = off + on
            e = self.edge[kinds[page.parents[i]]]
            m = tuple((e[a][0] * off + e[a][1] * on) / scale for a in (0, 1))
            sent[i] = m
            above = up[page.parents[i]]
            above[0] *= m[0]
            above[1] *= m[1]
            if above[0] + above[1] < 1e-200:  # many children: keep the ratio
                s = above[0] + above[1] or 1.0
                above[0], above[1] = above[0] / s, above[1] / s
        out = [0.0] * size
        down = [(1.0, 1e-6)] * size
        for i in range(size):
            if i:
                p = page.parents[i]
                rest = [down[p][a] * up[p][a] / sent[i][a] for a in (0, 1)]
                scale = sum(rest) or 1.0
                e = self.edge[kinds[p]]
                down[i] = tuple((rest[0] * e[0][b] + rest[1] * e[1][b]) / scale for b in (0, 1))
            off, on = down[i][0] * up[i][0], down[i][1] * up[i][1]
            out[i] = on / (off + on) if off + on > 0 and not math.isinf(off + on) else 0.0
        return out

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        page = parse(html)
        keep = self.marginals(page)
        blocks = (" ".join("".join(run).split()) for at, run in page.runs if keep[at] >= 0.5)
        return " ".join(b for b in blocks if b)


def extract(pages: DataFrame, counts: dict[str, float], html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each."""

    @F.pandas_udf("string")
    def main_text(part: pd.Series) -> pd.Series:
        tree = Tree(counts)
        return pd.Series([tree.text(h) for h in part], dtype=object)

    return pages.withColumn(out, main_text(F.col(html)))
