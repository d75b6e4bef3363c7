"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a binary variable, content or not. A unary potential scores its own
features (tag, words of its class and id, link density, length), and a potential on
each parent-child edge ties neighbours. Sum-product messages go up the tree and down
again and give each element's exact marginal; text under elements of at least one
half is kept.

Both potentials are trained from labelled pages: templates with known labels, and a
bounded sample of the table's own pages that mark their article up.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import broadcast_value, fresh, hashed_sample

#: Elements of the markup language by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup tt u var wbr".split())
DROPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video select option button textarea input map".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements that end no block: what stands before and behind them is one line.
UNBROKEN = INLINE | frozenset("script style template noscript svg math".split())
BEFORE_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that the model knows by name; all others are one kind, however many names pages invent.
KNOWN = VOID | INLINE | DROPPED | RAW | BEFORE_P | frozenset("#root html body caption colgroup dd dt figcaption legend li menu search summary tbody td tfoot th thead tr".split())
#: What words in class, id and role say about an element.
BOILERPLATE_WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc",
    "head": "header masthead topbar banner logo",
    "foot": "footer bottom copyright legal colophon",
    "side": "sidebar side aside widget related recommended trending popular more rail",
    "note": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall toast",
    "ad": "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion promoted",
    "form": "form login signin signup search contact input",
    "comment": "comment comments commentlist reply replies disqus discussion respond reader",
    "share": "share sharing social follow tags meta byline author",
}
CONTENT_WORDS = "article content main post entry story text prose maincontent"
_CATEGORY = {w: f"word:{c}" for c, ws in BOILERPLATE_WORDS.items() for w in ws.split()} | {w: "word:content" for w in CONTENT_WORDS.split()}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRS = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
#: One attribute: its whole name, and its value in quotes or bare.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMED = ("class", "id", "role")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Node:
    tag: str
    parent: int
    words: list[str]
    chars: int = 0
    link_chars: int = 0
    n_links: int = 0
    n_stops: int = 0
    children: int = 0
    label: int | None = None


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[list[tuple[int, str]]] = field(default_factory=list)


def _name_words(attrs: str) -> list[str]:
    out = []
    for m in _ATTR.finditer(attrs):
        if m[1].lower() in _NAMED:
            value = m[2] or m[3] or m[4] or ""
            out += [w.lower() for w in _WORD.findall(html.unescape(value) if "&" in value else value)]
    return out


def _markup(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in one forward scan: ``text``, ``open``, ``close`` and, after a raw element's start tag, no content of it.

    A quote that nothing closes ends with its tag; it is looked for once. Without a later ``>`` the rest is text.
    """
    at, end, last = 0, len(source), source.rfind(">")
    open_quote = -1  # tags that start before it and hold a quote end at their first >
    while at < end:
        a = source.find("<", at)
        if a < 0 or a > last:
            yield "text", source[at:], ""
            return
        if source.startswith("<!--", a):
            yield "text", source[at:a], ""
            b = source.find("-->", a + 4)
            at = end if b < 0 else b + 3
            continue
        closing = source.startswith("/", a + 1)
        name = _NAME.match(source, a + 1 + closing)
        if not name:
            if source.startswith(("!", "?"), a + 1):
                yield "text", source[at:a], ""
                at = source.find(">", a) + 1
            else:
                yield "text", source[at : a + 1], ""
                at = a + 1
            continue
        yield "text", source[at:a], ""
        first = source.find(">", name.end())
        attrs = None if a < open_quote and re.search("[\"']", source[name.end() : first]) else _ATTRS.match(source, name.end())
        if attrs is None and a >= open_quote:
            open_quote = max(source.rfind('"'), source.rfind("'"))
        at = attrs.end() if attrs else first + 1
        tag = name[0].lower()
        yield "close" if closing else "open", tag, source[name.end() : at - 1]
        if not closing and tag in RAW:
            found = re.compile(rf"(?i)</{tag}\s*>").search(source, at)
            at = found.end() if found else end
            yield "close", tag, ""


#: Elements that a start tag closes where one is open above all of the others.
_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
_BARRIER = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("button", "table"), "dd": ("button", "table")}


def parse(source: str, label_of: Callable[[str], int | None] | None = None) -> Page:
    """The page's tree without inline elements that have no name, and its text as blocks of (node, text) runs.

    Time is linear in the page: where each tag is open is kept by tag. ``label_of`` reads the
    labels of generated pages from an element's attributes; pages of a table have none.
    """
    page = Page([Node("#root", -1, [])])
    nodes, stack = page.nodes, [("#root", 0, False)]  # (tag, node, dropped)
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    blocks_open: list[int] = []  # where elements that are not inline are open
    run: list[tuple[int, str]] = []
    links = 0

    def flush() -> None:
        nonlocal run
        if run:
            page.blocks.append(run)
            run = []

    def text(raw: str) -> None:
        tag, node, dropped = stack[-1]
        if dropped or not raw:
            return
        value = html.unescape(raw) if "&" in raw else raw
        run.append((node, value))
        n = len(value) - value.count(" ") - value.count("\n")
        if n:
            own = nodes[node]
            own.chars += n
            own.n_stops += value.count(".") + value.count("!") + value.count("?")
            if links:
                own.link_chars += n

    def close(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            tag = stack.pop()[0]
            places[tag].pop()
            links -= tag == "a"
            if tag not in UNBROKEN:
                blocks_open.pop()
                if not stack[-1][2]:
                    flush()

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    for kind, tag, attrs in _markup(source):
        if kind == "text":
            text(tag)
            continue
        if kind == "close":
            if places[tag]:
                close(places[tag][-1])
            continue
        if tag in VOID:
            if not stack[-1][2]:
                if tag in ("br", "wbr", "img"):
                    run.append((stack[-1][1], " " if tag == "br" else ""))
                elif tag == "hr":
                    flush()
            continue
        if tag in _OWN:
            if (k := last(_OWN[tag])) > last(_BARRIER[tag]):
                close(k)
        elif tag in BEFORE_P and blocks_open and stack[blocks_open[-1]][0] == "p":
            close(blocks_open[-1])
        if tag not in UNBROKEN and not stack[-1][2]:
            flush()
        words = _name_words(attrs) if attrs else []
        _, node, dropped = stack[-1]
        if tag not in INLINE or words:
            nodes[node].children += 1
            nodes.append(Node(tag, node, words, label=label_of(attrs) if label_of else None))
            node = len(nodes) - 1
        if tag == "a":
            links += 1
            nodes[node].n_links += 1
        places[tag].append(len(stack))
        if tag not in UNBROKEN:
            blocks_open.append(len(stack))
        stack.append((tag, node, dropped or tag in DROPPED))
        if attrs.endswith("/") and (places["svg"] or places["math"]):
            close(len(stack) - 1)  # elsewhere a slash closes nothing
    close(1)
    flush()
    return page


def features(page: Page) -> list[list[str]]:
    """The names of each node's features, all binary."""
    nodes = page.nodes
    chars = [n.chars for n in nodes]
    links = [n.link_chars for n in nodes]
    stops = [n.n_stops for n in nodes]
    held = [n.tag in ("article", "main") for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        links[p] += links[i]
        stops[p] += stops[i]
        held[p] |= held[i]
    inside = [False] * len(nodes)
    above: list[frozenset[str]] = [frozenset()] * len(nodes)  # what the elements around a node say
    landmark = held[0]
    out = []
    for i, n in enumerate(nodes):
        inside[i] = n.tag in ("article", "main") or (i > 0 and inside[n.parent])
        density = links[i] / chars[i] if chars[i] else 0.0
        f = ["bias", f"tag:{n.tag if n.tag in KNOWN else 'other'}", f"links:{min(3, int(density * 4))}", f"long:{min(7, chars[i].bit_length() // 2)}", f"stops:{min(3, stops[i])}", "own" if n.chars else "container"]
        own = sorted({c for w in n.words if (c := _CATEGORY.get(w))})
        around = above[n.parent] if i else frozenset()
        f += own + [f"in:{x}" for x in sorted(around)]
        above[i] = around.union(own, [n.tag] if n.tag in ("nav", "header", "footer", "aside", "form", "h1") else [])
        if landmark and not inside[i] and not held[i]:
            f.append("outside")
        if chars[i] and stops[i] == 0:
            f.append("unpunctuated")
        out.append(f)
    return out


@dataclass
class TreeModel:
    weights: dict[str, float]
    edges: list[list[float]]  # [parent label][child label]

    def marginals(self, page: Page) -> list[float]:
        """Log-odds that each node is content, by sum-product: messages up to the root, then down."""
        (e00, e01), (e10, e11) = self.edges
        get, nodes = self.weights.get, page.nodes
        belief = [sum(get(f, 0.0) for f in fs) for fs in features(page)]
        up = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            b = max(-30.0, min(30.0, belief[i]))
            up[i] = math.log(math.exp(e11 + b) + math.exp(e10)) - math.log(math.exp(e01 + b) + math.exp(e00))
            belief[nodes[i].parent] += up[i]
        for i in range(1, len(nodes)):
            g = max(-30.0, min(30.0, belief[nodes[i].parent] - up[i]))
            belief[i] += math.log(math.exp(e11 + g) + math.exp(e01)) - math.log(math.exp(e10 + g) + math.exp(e00))
        return belief

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source)
        odds = self.marginals(page)
        out = []
        for run in page.blocks:
            joined = " ".join("".join(t for i, t in run if odds[i] >= 0).split())
            if joined:
                out.append(joined)
        return "\n".join(out)


# ---- labelled pages -------------------------------------------------------


def labelled_templates(n: int = 240) -> list[str]:
    """Pages with known labels (``data-y``), from a generator with a fixed seed: articles in several mark-ups among all kinds of boilerplate."""
    r = random.Random(7)

    def words(lo: int, hi: int) -> str:
        w = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi))]
        return " ".join(w)

    def prose(k: int) -> str:
        return " ".join(words(5, 18).capitalize() + "." for _ in range(k))

    def items(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def named(tags: str, names: str, body: str, bare: float = 0.15) -> str:
        name = r.choice(names.split())
        attr = "" if r.random() < bare else f' {r.choice(["class", "id"])}="{name}"'
        return f'<{(t := r.choice(tags.split()))}{attr} data-y="0">{body}</{t}>'

    w = BOILERPLATE_WORDS
    makers = {
        "menu": lambda: named("nav nav div ul", w["menu"], items(r.randint(3, 9))),
        "head": lambda: named("header header div", w["head"], f"<h2>{words(1, 3)}</h2>" + r.choice(["", f"<p>{words(2, 6)}</p>"])),
        "foot": lambda: named("footer footer div", w["foot"], f"&copy; {words(2, 8)}" + r.choice(["", items(3), f"<p>{prose(1)}</p>"])),
        "side": lambda: named("aside aside div section", w["side"], r.choice([items(5), f"<h3>{words(2, 4)}</h3><p>{prose(2)}</p>", f"<h4>{words(1, 3)}</h4>" + items(4)])),
        "note": lambda: named("div div section", w["note"], r.choice([f"<p>{prose(1)}</p>", prose(2)]), 0.05),
        "ad": lambda: named("div div aside", w["ad"], r.choice([prose(1), f"<p>{prose(1)}</p>", f'<a href="#">{words(3, 8)}</a>']), 0.02),
        "form": lambda: named("form form div", w["form"], f"<label>{words(1, 2)}</label><input><p>{words(2, 8)}</p><button>{words(1, 1)}</button>", 0.3),
        "comment": lambda: named("div section ol", w["comment"], "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{prose(r.randint(1, 3))}</p></div>' for _ in range(r.randint(1, 5))), 0.02),
        "share": lambda: named("div ul", w["share"], items(3), 0.05),
    }
    pages = []
    for _ in range(n):
        body = [f'<h1 data-y="1">{words(3, 9)}</h1>'] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 10)):
            kind = r.random()
            if kind < 0.75:
                body.append(f'<p data-y="1">{prose(r.randint(1, 6))}</p>' if r.random() < 0.9 else f'<p data-y="1">{words(1, 5)}</p>')
            elif kind < 0.83:
                body.append(f'<h2 data-y="1">{words(2, 5)}</h2>')
            elif kind < 0.9:
                body.append('<ul data-y="1">' + "".join(f"<li>{words(2, 9)}.</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.94:
                body.append(f'<blockquote data-y="1"><p>{prose(2)}</p></blockquote>')
            else:
                body.append(makers[r.choice(["ad", "share", "side", "note", "form"])]())
        wrap = r.choice(["article", "article", "article", "main", "div"])
        name = f' class="{r.choice(CONTENT_WORDS.split())}"' if wrap == "div" or r.random() < 0.4 else ""
        inner = f'<{wrap}{name} data-y="1">' + "".join(body)
        tail = makers["comment"]() if r.random() < 0.3 else ""
        inner += (tail + f"</{wrap}>") if r.random() < 0.4 else (f"</{wrap}>" + tail)
        top = [makers[k]() for k in ("head", "menu", "note", "ad") if r.random() < 0.55]
        low = [makers[k]() for k in ("side", "share", "form", "ad", "menu", "foot") if r.random() < 0.5]
        r.shuffle(top)
        middle = "".join(top) + inner + "".join(low)
        if r.random() < 0.4:
            middle = f'<div class="{r.choice(["wrapper", "page", "container", "row"])}" data-y="1">{middle}</div>'
        pages.append(f"<html><head><title>{words(2, 5)}</title></head><body>{middle}</body></html>")
    return pages


def _label_of(attrs: str) -> int | None:
    return int('data-y="1"' in attrs) if "data-y" in attrs else None


def _spread_labels(page: Page) -> bool:
    """Give each node its label: its own, else its parent's; a container of content is content. False if the page has none."""
    nodes = page.nodes
    if not any(n.label is not None for n in nodes):
        for n in nodes:
            if n.tag in ("article", "main"):
                n.label = 1
            elif n.tag in ("nav", "footer", "aside", "form") or any(_CATEGORY.get(w) in ("word:ad", "word:comment") for w in n.words):
                n.label = 0
        if not any(n.label == 1 for n in nodes):
            return False
    for i, n in enumerate(nodes):
        if n.label is None:
            n.label = nodes[n.parent].label if i else 0
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].label == 1 and nodes[nodes[i].parent].tag in ("#root", "html", "body", "div", "section"):
            nodes[nodes[i].parent].label = 1
    return True


Case = tuple[tuple[str, ...], int, int]  # features of a node, its label, its parent's (-1: none)


def cases(pages: Iterable[Page]) -> Counter[Case]:
    """How often each case of features, label and parent's label occurs in labelled pages."""
    out: Counter[Case] = Counter()
    for page in pages:
        if _spread_labels(page):
            for n, f in zip(page.nodes, features(page)):
                if n.tag not in DROPPED:
                    out[tuple(f), n.label, page.nodes[n.parent].label if n.parent >= 0 else -1] += 1
    return out


def fit(counted: Counter[Case], rounds: int = 12) -> TreeModel:
    """Unary weights by logistic regression, edge potentials from smoothed counts of label pairs."""
    kinds = sorted(counted)
    pairs = np.ones((2, 2))
    for (_, y, above), n in counted.items():
        if above >= 0:
            pairs[above, y] += n
    names = sorted({f for fs, _, _ in kinds for f in fs})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(kinds), len(names)))
    for i, (fs, _, _) in enumerate(kinds):
        x[i, [at[f] for f in fs]] = 1
    y, times = np.array([k[1] for k in kinds], float), np.array([counted[k] for k in kinds], float)
    w = np.zeros(len(names))
    for _ in range(rounds):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (times * (y - p)) - w
        curve = (x * (times * p * (1 - p))[:, None]).T @ x + np.eye(len(names))
        w += np.linalg.solve(curve, slope)
    joint = pairs / pairs.sum()
    edges = np.log(joint / np.outer(joint.sum(1), joint.sum(0)))
    return TreeModel({f: float(v) for f, v in zip(names, w)}, edges.tolist())


def template_cases(templates: list[str]) -> Counter[Case]:
    return cases(parse(t, _label_of) for t in templates)


def sampled(pages: DataFrame, sample_pages: int) -> DataFrame:
    """About ``sample_pages`` of the pages that mark an article up, long ones too, chosen by a hash of the page; equal pages once."""
    marked = pages.select("html").filter(F.col("html").contains("<article"))
    return hashed_sample(marked, sample_pages, "html").dropDuplicates(["html"])


def train(pages: DataFrame, sample_pages: int = 200) -> TreeModel:
    """Fit on the labelled templates and on ``sampled`` pages; tasks count the cases of these, and the driver gets the counts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = cases(map(parse, b["html"]))
            yield pd.DataFrame([(list(f), y, above, n) for (f, y, above), n in own.items()], columns=["f", "y", "above", "n"])

    rows = sampled(pages, sample_pages).mapInPandas(counted, "f array<string>, y int, above int, n long").groupBy("f", "y", "above").agg(F.sum("n").alias("n"))
    seen = template_cases(labelled_templates())
    for r in rows.collect():  # cases of sampled pages: a bounded number of distinct ones
        seen[tuple(r["f"]), r["y"], r["above"]] += r["n"]
    return fit(seen)


def extract(pages: DataFrame, sample_pages: int = 200, into: str = "extracted") -> DataFrame:
    """``pages`` with a struct column ``into`` (text, n_chars).

    Null or empty html gives an empty text. Blocks keep page order, one a line; white
    space within a block becomes one space. Repeated rows are treated alike; an empty
    table gives no rows. Other columns pass through; where one is called ``into``, the
    new column's name gets an underscore.
    """
    model = broadcast_value(pages.sparkSession, train(pages, sample_pages))

    @F.pandas_udf("text string, n_chars long")
    def run(sources: pd.Series) -> pd.DataFrame:
        texts = [model().text(s) for s in sources]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return pages.withColumn(fresh(pages, into), run(F.col("html")))
