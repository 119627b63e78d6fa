"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements and text blocks.  Every node has a
label, content or not; evidence about a node comes from its tag, the words in
its class, id and role, and a text block's length, links and punctuation;
a potential couples the labels of parent and child by the kinds of both.
Sum-product messages run from the leaves to the root and back, which yields
exact marginals; text blocks whose marginal favours content are the text.

The model (P(child | parent, kinds) and P(label | evidence) / P(label | kind))
is trained from labelled pages.  :func:`labelled_pages` makes a bounded set of
``TRAINING_PAGES`` from a fixed seed; callers may pass their own.

Each page is handled alone: one narrow pass, no shuffle, whatever its size.

Cases: null and empty html give an empty text; markup that never closes ends
with its parent or the page; repeated rows are extracted each; a page without
content gives an empty text; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import functools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import only, tidy

TRAINING_PAGES = 1200
SEED = 20240607
#: Weight of P(child | parent, kind of child) against counts by both kinds.
BACKOFF = 5.0

# Elements by how they lay out, from the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title iframe template select".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math svg object noscript canvas".split()
    + "mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder semantics tspan".split()
)
BREAK = {"br", "hr", "img"}
#: A start tag of the key ends open elements of these names, up to the listed parents.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

# Words of class, id and role attributes by what they announce.
HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip topbar",
    "head": "header masthead banner logo site-header top branding",
    "foot": "footer foot copyright colophon legal bottom imprint",
    "side": "sidebar side aside widget rail related recommended recommendations trending popular more-stories teaser secondary complementary",
    "ad": "ad ads advert advertisement adbox sponsored sponsor promo promotion banner-ad dfp outbrain taboola",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay banner-cookie warning paywall disclaimer message announcement",
    "comment": "comment comments reply replies discussion disqus respond commentlist thread reader",
    "form": "form search login signup signin subscribe newsletter subscription register contact",
    "share": "share social sharing follow tags meta byline author toolbar buttons",
    "main": "article content main post entry story body text prose articlebody article-body post-content entry-content maincontent",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}

KINDS = {
    **dict.fromkeys(["article", "main"], "main"),
    **dict.fromkeys(["p", "blockquote", "pre"], "para"),
    **dict.fromkeys(["h1", "h2", "h3", "h4", "h5", "h6"], "heading"),
    **dict.fromkeys(["ul", "ol", "dl", "menu"], "list"),
    **dict.fromkeys(["li", "dt", "dd"], "item"),
    **dict.fromkeys(["table", "tbody", "thead", "tr"], "table"),
    **dict.fromkeys(["td", "th", "caption"], "cell"),
    **dict.fromkeys(["figure", "figcaption"], "figure"),
    **dict.fromkeys(["nav", "header", "footer", "aside", "form", "button", "fieldset", "dialog"], "frame"),
    **dict.fromkeys(["html", "body"], "root"),
    "#text": "text",
}

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
_ENDS = re.compile(r"[.!?:…»\"”)]$")


class Tree:
    """Nodes in document order: tag, attribute words, parent; texts of '#text' nodes."""

    def __init__(self) -> None:
        self.tag, self.hints, self.parent = ["html"], [frozenset()], [-1]
        self.text: dict[int, tuple[str, int]] = {}  # node -> text, characters in links
        self.gold: dict[int, int] = {}


@functools.lru_cache(maxsize=20_000)
def _hints(attrs: str) -> frozenset[str]:
    out = set()
    for m in _ATTR.finditer(attrs):
        for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[1] or m[2] or m[3] or "").lower().replace("_", " ")):
            out.add(_HINT.get(w) or next((_HINT[x] for x in w.split("-") if x in _HINT), None))
    out.discard(None)
    if _HIDDEN.search(attrs):
        out.add("hidden")
    return frozenset(out)


def parse(page: str) -> Tree:
    t = Tree()
    stack = [0]
    buffer: list[str] = []
    linked = link = 0
    at, n = 0, len(page)

    def add(tag: str, hints: frozenset[str]) -> int:
        t.tag.append(tag)
        t.hints.append(hints)
        t.parent.append(stack[-1])
        return len(t.tag) - 1

    def flush() -> None:
        nonlocal linked
        if buffer:
            s = " ".join("".join(buffer).split())
            if s:
                t.text[add("#text", frozenset())] = s, linked
            buffer.clear()
        linked = 0

    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            s = page[at:end]
            buffer.append(_html.unescape(s) if "&" in s else s)
            if link:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, close, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not close:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else n if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag == "a":
            link = 0 if close else 1
            continue
        if tag in BREAK:
            buffer.append(" ")
            continue
        if tag in INLINE or tag in VOID or tag in RAW:
            continue
        flush()
        link = 0
        if close:
            if any(t.tag[i] == tag for i in stack[1:]):
                while t.tag[stack.pop()] != tag:
                    pass
            continue
        if tag in ("html", "head"):
            continue
        if tag == "body" and len(stack) == 1:
            stack.append(add("body", _hints(attrs)))
            continue
        if t.tag[stack[-1]] == "p":
            stack.pop()
        if tag in CLOSES:
            names, until = CLOSES[tag]
            k = len(stack) - 1
            while k > 0 and t.tag[stack[k]] not in until and t.tag[stack[k]] not in names:
                k -= 1
            if k > 0 and t.tag[stack[k]] in names:
                del stack[k:]
                if tag == "tr" and t.tag[stack[-1]] == "tr":
                    stack.pop()
        stack.append(add(tag, _hints(attrs)))
    flush()
    return t


_FEATURES: dict[str, int] = {}


def _static(tag: str, hints: frozenset[str]) -> list[str]:
    return [f"tag={tag}", f"kind={KINDS.get(tag, 'div')}", *(f"hint={h}" for h in sorted(hints)), *(f"{KINDS.get(tag, 'div')}&{h}" for h in sorted(hints))]


def _dynamic(text: str, linked: int) -> list[str]:
    n = len(text)
    return [
        f"len={min(9, n.bit_length())}",
        f"link={min(4, int(4 * linked / n))}",
        "ends" if _ENDS.search(text) else "open",
        "stops=" + str(min(3, text.count(". ") + text.count(", "))),
        "mark" if text[0] in "©®™" or "©" in text[:40] else "plain",
    ]


class Model:
    """Evidence weights and the parent-child table: P(child is content | the parent
    is not, or is), by the kinds of both."""

    def __init__(self, weights: dict[str, float], bias: float, prior: dict[str, float], table: dict[tuple[str, str], tuple[float, float]]):
        self.weights, self.bias, self.prior, self.table = weights, bias, prior, table
        self.known: dict = {}

    def evidence(self, tag: str, hints: frozenset[str]) -> tuple[float, str]:
        got = self.known.get((tag, hints))
        if got is None:
            kind = KINDS.get(tag, "div")
            got = self.bias + sum(self.weights.get(f, 0.0) for f in _static(tag, hints)) - self.prior.get(kind, 0.0), kind
            if len(self.known) < 50_000:
                self.known[tag, hints] = got
        return got

    def marginals(self, t: Tree) -> list[float]:
        """Log odds of content for every node, by sum-product over the tree."""
        n = len(t.tag)
        up, kinds, message = [0.0] * n, [""] * n, [0.0] * n
        w = self.weights
        for i in range(n):
            up[i], kinds[i] = self.evidence(t.tag[i], t.hints[i])
        for i, (s, linked) in t.text.items():
            up[i] += sum(w.get(f, 0.0) for f in _dynamic(s, linked))
        exp, log = math.exp, math.log
        for i in range(n - 1, 0, -1):
            a, b = self.table[kinds[t.parent[i]], kinds[i]]
            x = exp(max(-30.0, min(30.0, up[i])))
            message[i] = log((1 - b + b * x) / (1 - a + a * x))
            up[t.parent[i]] += message[i]
        for i in range(1, n):  # up now becomes the belief
            a, b = self.table[kinds[t.parent[i]], kinds[i]]
            q = exp(max(-30.0, min(30.0, up[t.parent[i]] - message[i])))
            up[i] += log((a + b * q) / (1 - a + (1 - b) * q))
        return up

    def text(self, page: str) -> str:
        t = parse(page)
        odds = self.marginals(t)
        return " ".join(s for i, (s, _) in t.text.items() if odds[i] > 0)


def _labels(t: Tree) -> list[int]:
    """A node's label: most of the text below it is content."""
    yes, all_ = [0] * len(t.tag), [0] * len(t.tag)
    for i, (s, _) in t.text.items():
        all_[i], yes[i] = len(s), len(s) * t.gold[i]
    for i in range(len(t.tag) - 1, 0, -1):
        all_[t.parent[i]] += all_[i]
        yes[t.parent[i]] += yes[i]
    return [int(2 * y >= a and a > 0) for y, a in zip(yes, all_)]


def train(trees: list[Tree], steps: int = 600) -> Model:
    """Logistic evidence by gradient descent, transition counts, label priors."""
    index: dict[str, int] = {}
    rows, cols, y, kinds = [], [], [], []
    every = sorted({*KINDS.values(), "div"})
    trans = {k: np.ones((2, 2)) for k in every}  # by the child's kind
    pairs = {(p, k): np.zeros((2, 2)) for p in every for k in every}
    for t in trees:
        label = _labels(t)
        for i in range(len(t.tag)):
            f = _static(t.tag[i], t.hints[i]) + (_dynamic(*t.text[i]) if i in t.text else [])
            for x in f:
                rows.append(len(y))
                cols.append(index.setdefault(x, len(index)))
            kind = KINDS.get(t.tag[i], "div")
            y.append(label[i])
            kinds.append(kind)
            if i:
                trans[kind][label[t.parent[i]], label[i]] += 1
                pairs[KINDS.get(t.tag[t.parent[i]], "div"), kind][label[t.parent[i]], label[i]] += 1
    r, c, y_ = np.asarray(rows), np.asarray(cols), np.asarray(y, float)
    w, b, seen = np.zeros(len(index)), 0.0, np.bincount(c, minlength=len(index)) + 1.0
    for _ in range(steps):
        z = np.bincount(r, w[c], len(y_)) + b
        e = 1 / (1 + np.exp(-z)) - y_
        w -= 1.5 * (np.bincount(c, e[r], len(index)) / seen + 0.0005 * w)
        b -= 1.5 * e.mean()
    k = np.asarray(kinds)
    prior = {x: math.log((y_[k == x].sum() + 1) / ((1 - y_[k == x]).sum() + 1)) for x in set(kinds)}
    table = {}
    for (p, x), m in pairs.items():  # pairs that were seen little lean on the child's kind alone
        m = m + BACKOFF * trans[x] / trans[x].sum(1, keepdims=True)
        table[p, x] = tuple((m[:, 1] / m.sum(1)).tolist())
    return Model({x: float(w[i]) for x, i in index.items()}, float(b), prior, table)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[Tree]:
    """Pages of many layouts whose text blocks are labelled; the same for a seed."""
    rng = random.Random(seed)
    pick = rng.choice
    syll = "an ba co de el fi ga ho in jo ka lo me no or pa qui re sa ti un ve wo".split()
    word = lambda: "".join(pick(syll) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence() -> str:
        return words(4, 14).capitalize() + pick([", " + words(2, 6), ""]) + pick(["."] * 6 + ["!", "?"])

    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    yes = lambda s: f"\x01{s}"
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(a, b)))
    attr = lambda kind: pick(["class", "class", "id"]) + f'="{pick(HINTS[kind].split())}"'
    maybe = lambda s, p=0.5: s if rng.random() < p else ""

    plain = lambda: pick(["", "", f' class="{pick("abcdgkxyz")}{rng.randint(1, 40)}"', f' id="{word()}"', ' class="row"', ' class="wrap inner"'])

    def bare() -> str:
        """Menus, heads and feet whose names say nothing."""
        some = [f'<a href="/{word()}">{words(1, 2).title()}</a>' for _ in range(rng.randint(2, 7))]
        return pick([
            lambda: f"<div{plain()}>{pick([' ', ' | ', ' &middot; ']).join(some)}</div>",
            lambda: f"<div{plain()}><ul{plain()}>{links(2, 7)}</ul></div>",
            lambda: f"<div{plain()}><{(x := pick(['h1', 'div', 'span', 'b']))}>{words(1, 3).title()}</{x}></div>",
            lambda: f"<div{plain()}>{pick(['&copy; ', '© '])}{words(1, 4)}{pick(['', '. ' + sentence()])}</div>",
            lambda: f"<div{plain()}><p>{words(2, 5).capitalize()}</p></div>",
        ])()

    def comment() -> str:
        inner = "".join(f"<{pick(['li', 'div', 'p', 'article'])} {maybe(attr('comment'))}><p>{prose(1, 3)}</p>" for _ in range(rng.randint(1, 6)))
        return f"<{(x := pick(['div', 'section', 'ol', 'aside']))} {attr('comment')}>{maybe(f'<h3>{words(1, 3)}</h3>')}{inner}</{x}>"

    junk = {
        "nav": lambda: f"<nav{maybe(' ' + attr('nav'))}><ul>{links(2, 9)}</ul></nav>" if rng.random() < 0.6 else f"<{(x := pick(['div', 'ul']))} {attr('nav')}>{links(2, 9)}</{x}>",
        "head": lambda: (f"<header>{pick([f'<h1>{words(1, 3)}</h1>', f'<p>{words(2, 8)}</p>', f'<div>{words(1, 4)}</div>'])}{maybe(f'<p>{sentence()}</p>')}</header>"
                         if rng.random() < 0.6 else f"<div {attr('head')}><{(x := pick(['h1', 'h2', 'p', 'div']))}>{words(1, 6)}</{x}></div>"),
        "foot": lambda: f"<footer>{pick(['', '<p>'])}{pick(['&copy; ', '', '© '])}{words(1, 4)} &middot; {prose(1, 2)}</footer>" if rng.random() < 0.7
        else f"<div {attr('foot')}><p>&copy; {words(1, 4)}</p>{maybe(f'<p>{prose(1, 2)}</p>')}</div>",
        "side": lambda: f"<aside{maybe(' ' + attr('side'))}><h3>{words(1, 3)}</h3>{pick([f'<ul>{links(2, 6)}</ul>', f'<p>{prose(1, 3)}</p>', f'<div>{prose(1, 2)}</div>'])}</aside>"
        if rng.random() < 0.6 else f"<div {attr('side')}><p>{prose(1, 3)}</p><ul>{links(1, 5)}</ul></div>",
        "ad": lambda: f"<{(x := pick(['div', 'section', 'aside', 'p']))} {attr('ad')}>{pick([sentence(), f'<p>{prose(1, 2)}</p>', words(1, 6)])}</{x}>",
        "notice": lambda: f"<{(x := pick(['div', 'section', 'p']))} {attr('notice')}>{pick([prose(1, 3), f'<p>{prose(1, 2)}</p><button>{word()}</button>'])}</{x}>",
        "form": lambda: f"<form{maybe(' ' + attr('form'))}><label>{words(1, 3)}</label><input name=q>{maybe(f'<p>{sentence()}</p>')}<button>{word()}</button></form>",
        "comment": comment,
        "share": lambda: f"<div {attr('share')}>{pick([words(1, 4), f'<ul>{links(1, 4)}</ul>'])}</div>",
    }

    def block(divs: bool = False) -> str:
        kind = rng.random()
        if divs and kind < 0.72:
            return f"<div{plain()}>{yes(pick([prose(1, 6), prose(1, 2), words(3, 60) + '.']))}</div>"
        if kind < 0.72:
            return f"<p>{pick(['', '', '<b>', '<em>'])}{yes(pick([prose(1, 6), prose(1, 2), words(1, 5) + '.', words(1, 90)]))}{pick(['', '<br>'])}{pick(['</p>', '</p>', ''])}"
        if kind < 0.82:
            return f"<h{(k := rng.randint(2, 4))}>{yes(words(1, 7))}</h{k}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{yes(pick([words(1, 6), sentence()]))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote>{pick(['', '<p>'])}{yes(prose(1, 2))}</blockquote>"
        if kind < 0.95:
            top = maybe(f"<tr><th>{yes(words(1, 2))}<th>{yes(words(1, 2))}")
            return f"<table{plain()}>{top}" + "".join(f"<tr><td>{yes(words(1, 3))}<td>{yes(words(1, 3))}" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.97:
            return f"<pre>{yes(words(2, 12))}</pre>"
        return f"<figure><figcaption>{yes(words(2, 9))}</figcaption></figure>"

    out = []
    for _ in range(n):
        dull = rng.random() < 0.2  # a page whose names say nothing
        divs = dull and rng.random() < 0.6
        body = [block(divs) for _ in range(pick([1, 2, 3, 5, 8, 12, 20]))]
        title = f"<h1>{yes(words(1, 10))}</h1>"
        if dull:
            title = f"<h{(k := rng.randint(1, 3))}>{yes(words(1, 10))}</h{k}>"
        if (kind := rng.random()) < 0.7 or dull:
            body.insert(0, title)
        elif kind < 0.85:
            body.insert(0, f"<header>{title}{maybe(f'<p {attr('share')}>{words(1, 4)}</p>')}</header>")
        for _ in range(0 if dull else pick([0, 0, 1, 2])):
            body.insert(rng.randint(0, len(body)), junk[pick(["ad", "share", "side", "notice", "comment", "form"])]())
        inner = "".join(body)
        shell = rng.random()
        cells = dull and rng.random() < 0.35
        if dull:
            if rng.random() < 0.7 and not cells:
                inner = f"<div{plain()}>{inner}</div>"
            if cells:
                menu = pick([" ".join(f'<a href="/{word()}">{words(1, 2)}</a>' for _ in range(rng.randint(2, 6))), f"<ul>{links(2, 7)}</ul>"])
                head = maybe(f"<tr><td colspan=2>{pick(['<b>', '<h1>', ''])}{words(1, 4)}</td></tr>")
                foot = maybe(f"<tr><td colspan=2>{pick(['©', words(1, 2)])} {words(1, 5)}</td></tr>")
                inner = f"<table{plain()}>{head}<tr><td{plain()}>{menu}</td><td{plain()}>{inner}</td></tr>{foot}</table>"
        elif shell < 0.5:
            inner = f"<article{maybe(' ' + attr('main'), 0.3)}>{inner}</article>"
        elif shell < 0.65:
            inner = f"<main>{inner}</main>"
        elif shell < 0.88:
            inner = f"<{(x := pick(['div', 'section']))} {attr('main')}>{inner}</{x}>"
        elif shell < 0.96:
            inner = f"<div>{inner}</div>"
        if not dull and shell < 0.96 and rng.random() < 0.4:  # the rest stands in the body itself
            inner = f"<{(x := pick(['main', 'div', 'section']))}{maybe(' ' + attr('main'))}>{inner}{maybe(junk['comment']())}</{x}>"
        before = [junk[k]() for k in ("notice", "head", "nav", "ad", "form", "nav", "notice") if rng.random() < 0.4]
        after = [junk[k]() for k in ("share", "comment", "side", "ad", "form", "nav", "notice", "foot") if rng.random() < 0.4]
        if dull:
            before = [bare() for _ in range(rng.randint(0, 2))] + [b for b in before if rng.random() < 0.3]
            after = [a for a in after if rng.random() < 0.3] + [bare() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.1:
            after.append(f"<p>{pick(['©', words(1, 3)])} {words(1, 6)}</p>")
        t = parse(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>")
        for i, (s, linked) in list(t.text.items()):
            t.gold[i] = int("\x01" in s)
            t.text[i] = s.replace("\x01", ""), linked
        out.append(t)
    return out


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [model.text(x) if (x := v.as_py()) else "" for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return tidy(run)


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None
) -> DataFrame:
    """Per row: page_id, url, text (content blocks joined by a blank), n_chars."""
    p = only(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").withColumn("url", F.col("url").cast("string"))
    shared = p.sparkSession.sparkContext.broadcast(model or default_model())
    return p.mapInArrow(_extract(shared), f"page_id {dict(p.dtypes)['page_id']}, url string, text string, n_chars bigint")
