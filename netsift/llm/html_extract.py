"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree: block elements are its inner nodes, runs of inline text its leaves. Every node has a hidden state,
content or not, with a log-linear potential over what can be seen of it (tag, words of class, id and role, length, links,
sentence ends); every edge has a parent-child potential by kind of child. Sum-product messages, upward and then downward,
give the exact probability of each leaf to be content; leaves above one half are the text, in page order.

Both potentials are trained by likelihood on labelled pages: pages of a bounded sample that mark their article themselves,
and generated pages of many layouts whose blocks are labelled where they are made, with words from that sample.

Rows: null or empty html and pages without content give an empty text; unclosed, misnested or cut off markup is read as
far as it goes; long pages are read whole; repeated rows repeat their result; an empty table trains on generated pages.
Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column

SAMPLE_PAGES = 500  # expected number of the table's own pages that the model is trained on
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")
_NAME_PART = re.compile(r"[a-z]+")
_DROP = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "select"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input link meta base param source track embed area".split())
_VOID = set("img br hr input link meta base param source track embed area col wbr".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul": {"li"}, "ol": {"li"}, "dl": {"dt", "dd"}, "table": {"tr", "td", "th"}, "tr": {"td", "th"}}
_CONCEPTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "foot": "footer foot copyright legal colophon siteinfo bottom credits",
    "head": "header masthead banner topbar logo branding hero top",
    "side": "sidebar aside rail widget related recommended trending popular secondary complementary more",
    "comment": "comment comments reply replies disqus discussion respond responses commentlist reader feedback",
    "ad": "ad ads advert advertisement adslot sponsor sponsored promo promotion adsense dfp partner",
    "notice": "cookie cookies consent notice gdpr alert popup modal newsletter subscribe signup warning overlay paywall",
    "share": "share sharing social follow tags meta byline",
    "form": "form search login contact input poll survey",
    "main": "article content main post entry story body text page prose",
}
_CONCEPT = {word: name for name, words in _CONCEPTS.items() for word in words.split()}
_TAGS = "html body div section article main nav header footer aside form ul ol li dl dt dd table tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address button label fieldset details summary dialog other".split()
_LENGTHS = (12, 30, 60, 120, 240, 500)
_NAMES = ["bias", *("tag " + t for t in _TAGS), *("name " + c for c in _CONCEPTS), "hidden", "text", *(f"text length {k}" for k in range(len(_LENGTHS) + 1)), "text ends", "text linked", "text half linked", "text marked", *("in " + t for t in _TAGS)]
_INDEX = {name: k for k, name in enumerate(_NAMES)}
_SENTENCE = re.compile(r"[.!?…。！？:;][\"'”’)\]]*$")


@dataclass
class Tree:
    """Nodes in page order: parent, kind of edge to it, depth, features; for leaves the text."""

    parent: list[int]
    kind: list[int]
    depth: list[int]
    features: list[list[int]]
    text: list[str | None]
    label: list[int]  # of generated pages: 1 content, 0 not, -1 unknown


def parse(page: str) -> Tree:
    tree = Tree([-1], [0], [0], [[0, _INDEX["tag html"]]], [None], [-1])
    stack: list[tuple[str, int, int]] = [("html", 0, -1)]  # tag, node, label below
    run: list[str] = []
    linked, links = 0, 0
    at = 0

    def leaf() -> None:
        nonlocal run, linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                tag, parent, label = stack[-1]
                share = linked / max(1, sum(map(len, run)))
                size = sum(len(text) >= k for k in _LENGTHS)
                own = [_INDEX["text"], _INDEX[f"text length {size}"], _INDEX["in " + (tag if "in " + tag in _INDEX else "other")]]
                if _SENTENCE.search(text):
                    own.append(_INDEX["text ends"])
                if share > 0.8:
                    own.append(_INDEX["text linked"])
                elif share > 0.3:
                    own.append(_INDEX["text half linked"])
                if "©" in text or "|" in text or "»" in text:
                    own.append(_INDEX["text marked"])
                add(parent, 2, own, text, label)
        run, linked = [], 0

    def add(parent: int, kind: int, features: list[int], text: str | None, label: int) -> int:
        tree.parent.append(parent)
        tree.kind.append(kind)
        tree.depth.append(tree.depth[parent] + 1)
        tree.features.append(features)
        tree.text.append(text)
        tree.label.append(label)
        return len(tree.parent) - 1

    def close(tags: set[str], stop: set[str]) -> None:
        nonlocal links
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                leaf()
                del stack[k:]
                links = 0
                return
            if stack[k][0] in stop:
                return

    while True:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            run.append(text)
            if links:
                linked += len(text)
        if not found:
            break
        at = found.end()
        closing, tag, rest = found[1], (found[2] or "").lower(), found[3]
        if not tag:
            continue
        if tag in _DROP:
            if not closing and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            run.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag in ("br", "img", "input"):
                run.append(" ")
            continue
        if tag in ("html", "head", "body"):  # the root stands for all three; the drop list covers what heads hold
            leaf()
            found_y = re.search(r"data-y=(\d)", rest or "")
            if found_y and not closing:
                stack[0] = ("html", 0, int(found_y[1]))
            continue
        if closing:
            close({tag}, {"body"} if tag != "p" else {"div", "article", "section", "td", "body"})
            leaf()
            continue
        leaf()
        if tag == "hr":
            continue
        if tag in _CLOSED_BY:
            close(_CLOSED_BY[tag], {"ul", "ol", "dl", "table", "div", "section", "article"})
        if tag not in ("li", "td", "th", "tr", "dd", "dt"):
            close({"p"}, {"li", "td", "th", "div", "section", "article", "blockquote", "main", "body", "aside", "form"})
        own = [0, _INDEX["tag " + (tag if "tag " + tag in _INDEX else "other")]]
        label = stack[-1][2]
        if rest and rest.strip():
            for name, one, two, three, hidden in _ATTRIBUTE.findall(rest):
                value = (one or two or three).lower()
                name = name.lower()
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    own += {_INDEX["name " + _CONCEPT[w]] for w in _NAME_PART.findall(value) if w in _CONCEPT}
                elif hidden or name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")) or (name == "aria-hidden" and value == "true"):
                    own.append(_INDEX["hidden"])
                elif name == "data-y":
                    label = int(value)
        small = tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "blockquote", "pre", "figcaption", "label", "button")
        node = add(stack[-1][1], 0 if small else 1, own, None, label)
        stack.append((tag, node, label))
        links = 0
    leaf()
    return tree


# ------------------------------------------------------------------ the model
@dataclass
class Forest:
    """Trees side by side, as arrays."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]  # nodes by depth
    feature: np.ndarray
    owner: np.ndarray  # node of each feature


def forest(trees: list[Tree]) -> Forest:
    parent, kind, depth, feature, owner, base = [], [], [], [], [], 0
    for t in trees:
        parent += [p + base if p >= 0 else -1 for p in t.parent]
        kind += t.kind
        depth += t.depth
        for k, own in enumerate(t.features):
            feature += own
            owner += [base + k] * len(own)
        base += len(t.parent)
    depths = np.array(depth)
    order = np.argsort(depths, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depths[order])) + 1) if len(order) else []
    return Forest(np.array(parent), np.array(kind), levels, np.array(feature, np.int64), np.array(owner, np.int64))


@dataclass
class Model:
    weights: np.ndarray  # by feature
    edges: np.ndarray  # (kind of child, state of parent, state of child)

    def messages(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content of every node, and of the states of both ends of every edge."""
        n = len(f.parent)
        inside = np.zeros((n, 2))
        inside[:, 1] = np.bincount(f.owner, self.weights[f.feature], n)
        edge = self.edges[f.kind]
        up = np.zeros((n, 2))
        for nodes in f.levels[:0:-1]:
            up[nodes] = np.logaddexp(edge[nodes][:, :, 0] + inside[nodes, :1], edge[nodes][:, :, 1] + inside[nodes, 1:])
            np.add.at(inside, f.parent[nodes], up[nodes])
        belief = inside.copy()
        both = np.zeros((n, 2, 2))
        for nodes in f.levels[1:]:
            rest = belief[f.parent[nodes]] - up[nodes]  # what the parent knows without this child
            joint = rest[:, :, None] + edge[nodes] + inside[nodes][:, None, :]
            belief[nodes] = np.logaddexp(joint[:, 0], joint[:, 1])
            both[nodes] = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(nodes), 4), axis=1)[:, None, None])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), both


def _labels(tree: Tree) -> np.ndarray:
    """States of all nodes: an element is content if most of the characters below it are."""
    good, size = np.zeros(len(tree.parent)), np.zeros(len(tree.parent))
    for k in range(len(tree.parent) - 1, -1, -1):
        if tree.text[k] is not None:
            size[k], good[k] = len(tree.text[k]), len(tree.text[k]) * max(0, tree.label[k])
        if tree.parent[k] >= 0:
            size[tree.parent[k]] += size[k]
            good[tree.parent[k]] += good[k]
    return (good * 2 > size).astype(np.int64)


def train(trees: list[Tree], rounds: int = 120) -> Model:
    """Adam on the likelihood of the labelled trees."""
    f, y = forest(trees), np.concatenate([_labels(t) for t in trees])
    model = Model(np.zeros(len(_NAMES)), np.zeros((3, 2, 2)))
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), 1)
    params = [model.weights, model.edges]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        p, both = model.messages(f)
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, f.kind[child], both[child])
        grads = [np.bincount(f.feature, (y - p)[f.owner], len(_NAMES)) - 0.1 * model.weights, seen - expected - 0.1 * model.edges]
        for x, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


# ------------------------------------------------------------------ labelled pages
def generated(words: list[str], n: int, seed: int = 5) -> list[Tree]:
    """Pages of many layouts; every block carries its label."""
    rng = np.random.default_rng(seed)
    words = words or "the of and a in to is that for it was on are by with this".split()
    one = lambda *options: options[int(rng.integers(len(options)))]
    some = lambda lo, hi: " ".join(entities.escape(words[int(k)]) for k in rng.integers(len(words), size=int(rng.integers(lo, hi))))
    say = lambda lo, hi: some(lo, hi).capitalize() + one(".", ".", ".", ".", "!", "?", "")

    def links(k: int, outer: str = "ul") -> str:
        items = "".join(f"<li><a href='/{j}'>{some(1, 4)}</a></li>" for j in range(k))
        return f"<{outer}>{items}</{outer}>"

    def box(names: tuple, tags: tuple, inner: str) -> str:
        tag = one(*tags)
        name = one(*names)
        attribute = "" if tag not in ("div", "section", "ul") and rng.random() < 0.5 else f" {one('class', 'id')}=\"{name}\""
        return f"<{tag}{attribute} data-y=0>{inner}</{tag}>"

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.12:
            return f"<{(h := one('h2', 'h3', 'h2'))}>{some(2, 9).capitalize()}</{h}>"
        if kind < 0.2:
            return "<ul>" + "".join(f"<li>{say(3, 18)}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>"
        if kind < 0.25:
            return f"<blockquote>{one('<p>', '')}{say(5, 30)}</blockquote>"
        if kind < 0.29:
            return f"<table><tr><td>{some(1, 5)}</td><td>{some(1, 5)}</td></tr></table>"
        if kind < 0.33:
            return f"<pre>{some(3, 20)}</pre>"
        if kind < 0.36:  # verses: many short blocks
            return "".join(f"<p>{say(1, 4)}</p>" for _ in range(int(rng.integers(4, 25))))
        if kind < 0.4:
            return f"<p>{some(90, 200)}{one('.', '')}</p>"
        link = f" <a href='#'>{some(1, 4)}</a> " if rng.random() < 0.25 else " "
        bold = "<b>" if rng.random() < 0.15 else ""
        return f"<p>{bold}{say(3, 60)}{link}{say(2, 60)}" + one("</p>", "</p>", "</p>", "<br>")

    out = []
    for _ in range(n):
        body = "".join(paragraph() for _ in range(int(rng.integers(0, 9))))
        extra = box(("share", "social", "tags", "byline"), ("div", "ul"), some(1, 6)) if rng.random() < 0.15 else ""
        inside_ad = box(("ad", "ad-slot", "sponsored"), ("div", "aside"), f"<p>{say(4, 20)}</p>") if rng.random() < 0.2 else ""
        title = f"<h1>{some(2, 12).capitalize()}</h1>" if rng.random() < 0.85 else ""
        holder = one("article", "article", "article", "article class='post'", "main", "div class='content'", "div id='main-content'", "div class='post-body entry'", "section class='story'", "div")
        main = f"<{holder} data-y=1>{title}{extra}{body}{inside_ad}{paragraph()}</{holder.split()[0]}>"
        if rng.random() < 0.3:
            main = f"<main data-y=1>{main}</main>" if not holder.startswith("main") else f"<div class='{one('page', 'content', 'row')}'>{main}</div>"
        before, after = [], []
        chance = rng.random
        if chance() < 0.6:
            before.append(box(("header", "masthead", "site-header", "top-bar", "branding"), ("header", "div"), one(f"<h1>{some(1, 4)}</h1>", f"<p>{say(2, 12)}</p>", some(1, 6))))
        if chance() < 0.85:
            before.append(box(("nav", "menu", "navigation", "breadcrumbs"), ("nav", "nav", "div"), links(int(rng.integers(2, 9)))))
        if chance() < 0.5:
            one(before, after).append(box(("cookie-notice", "consent", "notice", "alert", "newsletter-popup"), ("div", "section", "aside", "dialog"), f"<p>{say(4, 30)}</p>" + one("<button>" + some(1, 3) + "</button>", "")))
        if chance() < 0.65:
            one(before, after).append(box(("ad", "ads", "advert", "ad-banner", "sponsor", "promo"), ("div", "div", "aside"), one(say(3, 30), f"<p>{say(3, 30)}</p>")))
        if chance() < 0.5:
            after.append(box(("sidebar", "related", "widget", "trending", "rail"), ("aside", "aside", "div", "section"), one(f"<h3>{some(1, 4)}</h3>", "") + one(links(4), f"<p>{say(3, 40)}</p>", f"<p>{say(3, 30)}</p><p>{say(3, 20)}</p>")))
        if chance() < 0.4:
            fields = f"<label>{some(1, 4)}</label><input name=q>" + one("", f"<p>{say(2, 16)}</p>") + f"<button>{some(1, 3)}</button>"
            one(before, after).append(f"<form {one('', 'class=search', 'id=login')} data-y=0>{fields}</form>")
        if chance() < 0.5:
            replies = "".join(f"<{(t := one('div class=comment', 'li', 'div class=reply', 'div', 'li class=comment', 'article class=comment'))}><p>{say(3, 60)}</p></{t.split()[0]}>" for _ in range(int(rng.integers(1, 4))))
            block = box(("comments", "comment-list", "comments-area", "discussion", "reader-comments"), ("section", "div", "div"), one(f"<h2>{some(1, 3)}</h2>", "") + replies)
            if rng.random() < 0.3:
                main = main[: main.rindex("</")] + block + main[main.rindex("</") :]
            else:
                after.append(block)
        if chance() < 0.85:
            after.append(box(("footer", "site-footer", "copyright", "legal"), ("footer", "footer", "div"), one("&copy; ", "") + one(say(3, 20), f"<p>{say(3, 25)}</p>", links(3))))
        lower = [before, after]
        for part in lower:
            rng.shuffle(part)
        out.append(parse("<html><body>" + "".join(before) + main + "".join(after) + "</body></html>"))
    return out


def _self_labelled(page: str) -> Tree | None:
    """A page that marks its one article itself; everything else on it is not content."""
    low = page.lower()
    name = next((t for t in ("article", "main") if low.count(f"<{t}") == 1), None)
    if name is None:
        return None
    at = low.index(f"<{name}") + len(name) + 1
    mark = low.find("<body")
    page = page[:at] + " data-y=1" + page[at:]
    if 0 <= mark < at:
        page = page[: mark + 5] + " data-y=0" + page[mark + 5 :]
    for tag in ("nav", "footer", "aside", "form", "header"):
        page = re.sub(rf"<{tag}\b", f"<{tag} data-y=0", page, flags=re.IGNORECASE)
    return parse(page)


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, made: int = 600) -> Model:
    rows = pages.select("page_id", "html").where("html is not null")
    count = pages.select("page_id").count()
    unit = F.pmod(F.xxhash64("page_id", F.lit("page sample")), F.lit(1 << 30)) / float(1 << 30)
    # the largest pages teach nothing that smaller ones do not: the sample takes those of ordinary length
    picked = rows.where((unit < min(1.0, sample / max(1, count))) & (F.length("html") < 20_000)).select("html")
    own = sorted(r[0] for r in picked.collect())  # about ``sample`` pages of under 20,000 characters
    trees = [t for t in map(_self_labelled, own) if t is not None]
    words = [w for t in trees[:60] for x in t.text if x for w in x.split()[:40]]
    return train(trees + generated(words, made))


def extract_texts(pages: list[str | None], model: Model) -> list[str]:
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    content, _ = model.messages(forest(trees))
    out, base = [], 0
    for t in trees:
        out.append("\n\n".join(x for k, x in enumerate(t.text) if x is not None and content[base + k] > 0.5))
        base += len(t.parent)
    return out


def extract(spark: SparkSession, pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = spark.sparkContext.broadcast(model or fit(pages))  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = extract_texts(column(part, "html"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
