"""Main text of web pages: gradient-boosted trees over the nodes of the document tree, decoded along the tree.

Every block element and every run of text is a node with features of its subtree (text and link density, tags),
attribute tokens, depth, position and siblings, its own and those of its ancestors. The trees give each node the log
odds of holding main text. Decoding picks the set of nodes with the largest sum of log odds in which no kept node has
a dropped ancestor; this closure is found exactly in one pass from the leaves up and one down.

The classifier learns from pages composed here: layouts with known main text, TRAIN_PAGES of them, from a fixed seed.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, small_batches, texts_of

TRAIN_PAGES = 1500
TREES, DEPTH, BINS, RATE = 60, 4, 32, 0.25

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|aria-hidden|hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

# Kinds of HTML elements.
RAW = frozenset("script style title textarea template iframe svg select datalist xmp canvas audio video".split())
#: Of these, what HTML reads as raw text: without an end tag they go on to the end of the page. The others are skipped only up to an end tag.
OPAQUE = frozenset("script style".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source nobr noscript object math mrow mi mo mn mtext msup msub msubsup mfrac msqrt mstyle semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of the second ends an open one of the first.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr",), "tbody": ("tr", "thead"), "option": ("option",)}
#: An end tag or implied end doesn't reach beyond these.
WALLS = frozenset("table td th ul ol dl div section article main aside nav header footer form body html #root".split())
TAGS = "#text p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption div section article main aside nav header footer form fieldset button body html head center details summary address menu dialog".split()
# Parts of attribute tokens that name a node's role.
ROLES = {
    "nav": "nav menu breadcrumb crumb pager pagination toc tabs skip".split(),
    "ad": "ad ads adv advert advertisement sponsor sponsored promo banner doubleclick dfp outbrain taboola".split(),
    "comment": "comment comments reply replies respond disqus discussion thread".split(),
    "side": "sidebar side aside rail widget related recommended recommend popular trending teaser more".split(),
    "head": "header masthead topbar head logo brand hero".split(),
    "foot": "footer foot copyright colophon legal bottom imprint".split(),
    "form": "form subscribe newsletter signup login search input modal popup paywall".split(),
    "notice": "cookie consent notice alert gdpr privacy warning message toast disclaimer banner".split(),
    "share": "share social tweet facebook follow tools byline meta tags tag author date".split(),
    "main": "article content main post entry story body text page prose".split(),
    "hidden": ["hidden", "none"],
}
_ROLE_OF = {}
for _i, _words in enumerate(ROLES.values()):
    for _w in _words:
        _ROLE_OF[_w] = _ROLE_OF.get(_w, 0) | 1 << _i
_TAG_NO = {t: i for i, t in enumerate(TAGS)}
_SPLIT = re.compile(r"[^a-z]+")
#: Ancestors that are features.
ABOVE = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "ul", "table", "head")
_ABOVE_BIT = {t: 1 << i for i, t in enumerate(ABOVE)}


@lru_cache(64)
def _end_of(name: str):
    """Where an element that has no text of its own ends: its end tag, which group 1 catches, or a tag that can't stand in a form control."""
    own = rf"(</{name}\b[^>]*>)"
    return re.compile(own + r"|</?(?:article|section|main|aside|nav|header|footer|div|p|h[1-6]|ul|ol|table|body|html)\b" if name in ("select", "datalist", "textarea", "title", "iframe") else own, re.I)


@lru_cache(4096)
def _roles(attributes: str) -> int:
    """Bit set of the roles that the attribute tokens name."""
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found |= _ROLE_OF["hidden"]
        elif name != "style":
            for w in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                found |= _ROLE_OF.get(w, 0)
    return found


def parse(html: str):
    """Nodes in page order as columns: parent, tag, roles, text (of text runs), link characters."""
    parent, tag, roles, text, linked = [-1], ["#root"], [0], [""], [0]
    stack: list[int] = [0]
    run: list[str] = []
    in_link, link_chars, at = 0, 0, 0

    def flush() -> None:
        nonlocal link_chars
        if run:
            own = " ".join("".join(run).split())
            if own:
                parent.append(stack[-1])
                tag.append("#text")
                roles.append(0)
                text.append(own)
                linked.append(min(link_chars, len(own)))
            run.clear()
        link_chars = 0

    def say(raw: str) -> None:
        nonlocal link_chars
        own = unescape(raw) if "&" in raw else raw
        run.append(own)
        if in_link:
            link_chars += len(own.strip())

    def close(names, walls=WALLS) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if tag[stack[k]] in names:
                del stack[k:]
                return
            if tag[stack[k]] in walls:
                return

    while True:
        m = _TAG.search(html, at)
        if not m:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1]:
                run.append(m[1])
            continue
        name = m[3].lower()
        if m[2]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name not in INLINE and name not in VOID:
                flush()
                close((name,), ("#root",) if name in WALLS else WALLS)
            continue
        if name in RAW:
            if name in ("svg", "math") and m[4].endswith("/"):
                continue
            end = _end_of(name).search(html, at)
            if end and end[1]:
                at = end.end()
            elif end or name in OPAQUE:  # a block begins or ends first: the end tag is missing
                at = end.start() if end else len(html)
            if name not in ("script", "style"):
                run.append(" ")
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in INLINE:
            if name == "a" and not m[4].endswith("/"):
                in_link = 1
            continue
        flush()
        if name in VOID:
            continue
        in_link = in_link if name not in WALLS else 0
        close(("p",))
        if name in ENDS:
            close(ENDS[name], WALLS - {*ENDS[name]})
        parent.append(stack[-1])
        tag.append(name)
        roles.append(_roles(m[4]) if m[4] else 0)
        text.append("")
        linked.append(0)
        stack.append(len(parent) - 1)
    flush()
    return parent, tag, roles, text, linked


N_ROLES = len(ROLES)
FEATURES = len(TAGS) + 1 + 2 * N_ROLES + len(ABOVE) + 22 + 10


def features(page):
    """A row of FEATURES numbers for each node of parse()."""
    import numpy as np

    parent, tag, roles, text, linked = page
    n = len(parent)
    par = np.array(parent)
    depth, above, role_above = np.zeros(n), [0] * n, [0] * n
    chars = np.fromiter(map(len, text), np.float64, n)
    links = np.array(linked, np.float64)
    marks = np.fromiter((t.count(".") + t.count(",") + t.count("!") + t.count("?") if t else 0 for t in text), np.float64, n)
    words = np.fromiter((t.count(" ") + 1 if t else 0 for t in text), np.float64, n)
    runs, tags, items = (chars > 0).astype(float), (chars == 0).astype(float), np.fromiter((t in ("li", "td", "th", "dt", "dd") for t in tag), np.float64, n)
    paras = np.fromiter((t == "p" for t in tag), np.float64, n)
    start = np.concatenate([[0], np.cumsum(chars)[:-1]])
    children, index = np.zeros(n), np.zeros(n)
    before, after, newest = [0] * n, [0] * n, [0] * n  # neighbours among siblings; 0, the root, where there is none
    for i in range(1, n):
        p = parent[i]
        before[i], newest[p] = newest[p], i
        after[before[i]] = i
        depth[i] = depth[p] + 1
        above[i] = above[p] | _ABOVE_BIT.get(tag[p], 0)
        role_above[i] = role_above[p] | roles[p]
        index[i] = children[p]
        children[p] += 1
    sub = np.stack([chars, links, marks, words, runs, tags, items, paras])
    for i in range(n - 1, 0, -1):
        sub[:, parent[i]] += sub[:, i]
    total = max(1.0, sub[0, 0])
    c, lk, mk, wd, rn, tg, it, pp = sub
    up = np.maximum(par, 0)
    brothers = np.maximum(children[up], 1)
    mean_brother = (c[up] - c) / np.maximum(brothers - 1, 1)
    after[0] = 0
    block = np.where((chars > 0) & (brothers == 1), up, np.arange(n))  # a run that is all its element has counts as the element
    prev, next_ = np.array(before)[block], np.array(after)[block]
    heading = np.fromiter((t in ("h1", "h2", "h3", "h4") for t in tag), np.float64, n)
    around = []
    for near in (prev, next_):
        there = near > 0
        around += [np.where(there, np.log1p(c[near]), -1), np.where(there, lk[near] / np.maximum(c[near], 1), -1), there * paras[near], there * heading[near], np.where(there, c[near] / (tg[near] + 1), -1)]
    x = np.zeros((n, FEATURES), np.float32)
    numbers = np.fromiter((_TAG_NO.get(t, len(TAGS)) for t in tag), np.int64, n)
    x[np.arange(n), numbers] = 1
    at = len(TAGS) + 1
    own, over, anc = np.array(roles), np.array(role_above), np.array(above)
    for k in range(N_ROLES):
        x[:, at + k], x[:, at + N_ROLES + k] = own >> k & 1, over >> k & 1
    at += 2 * N_ROLES
    for k in range(len(ABOVE)):
        x[:, at + k] = anc >> k & 1
    at += len(ABOVE)
    one = np.maximum(c, 1)
    x[:, at:] = np.stack([
        np.log1p(c), lk / one, mk / np.maximum(wd, 1), np.log1p(wd), np.log1p(rn), np.log1p(tg), c / (tg + 1), c / np.maximum(rn, 1), it / np.maximum(tg, 1), pp / np.maximum(tg, 1), depth, children, index, index / brothers, brothers,
        c / total, c / np.maximum(c[up], 1), np.log1p(mean_brother), lk[up] / np.maximum(c[up], 1), pp[up] / np.maximum(tg[up], 1), (start / total), c[up] / total, *around,
    ], axis=1)
    return x


def decode(parent: list[int], odds):
    """Which nodes stay: the largest sum of odds such that the parent of a kept node is kept."""
    import numpy as np

    best = np.array(odds, float)
    best[0] = 0.0
    for i in range(len(parent) - 1, 0, -1):
        if best[i] > 0:
            best[parent[i]] += best[i]
    keep = best > 0
    keep[0] = True
    for i in range(1, len(parent)):
        keep[i] &= keep[parent[i]]
    return keep


def main_text(page, odds) -> str:
    keep = decode(page[0], odds)
    return " ".join(t for t, k in zip(page[3], keep) if t and k)


# --- boosted trees ---


def boost(x, y, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE):
    """Gradient-boosted complete trees on logistic loss with histogram splits: (features, thresholds, leaves, start)."""
    import numpy as np

    n, d = x.shape
    cuts = np.stack([np.quantile(x, q, axis=0) for q in np.linspace(0, 1, bins + 1)[1:-1]]).astype(np.float32)  # bins - 1 by d
    cuts = np.where(np.arange(bins - 1)[:, None] == 0, np.minimum(cuts, (x.min(0) + x.max(0)) / 2), cuts)
    code = np.zeros((n, d), np.int64)
    for j in range(d):
        cuts[:, j] = np.sort(cuts[:, j])
        code[:, j] = np.searchsorted(cuts[:, j], x[:, j], "left")
    start = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(n, start)
    feats, thresholds, leaves = [], [], []
    offset = np.arange(d) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        f_of, t_of = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf, np.float32)
        for level in range(depth):
            k = 2**level
            key = (node[:, None] * (d * bins) + offset + code).ravel()
            gs = np.bincount(key, np.repeat(g, d), k * d * bins).reshape(k, d, bins).cumsum(2)
            hs = np.bincount(key, np.repeat(h, d), k * d * bins).reshape(k, d, bins).cumsum(2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
            gain[:, :, -1] = -1
            gain[(hs < 1) | (ha - hs < 1)] = -1
            best = gain.reshape(k, -1).argmax(1)
            for i in range(k):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-6:
                    f_of[k - 1 + i], t_of[k - 1 + i] = j, cuts[b, j]
            right = x[np.arange(n), f_of[k - 1 + node]] > t_of[k - 1 + node]
            node = 2 * node + right
        gsum, hsum = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        leaf = rate * gsum / (hsum + 1)
        z += leaf[node]
        feats.append(f_of)
        thresholds.append(t_of)
        leaves.append(leaf)
    return np.stack(feats), np.stack(thresholds), np.stack(leaves), start


def log_odds(model, x):
    import numpy as np

    feats, thresholds, leaves, start = model
    z, rows = np.full(len(x), start), np.arange(len(x))
    for f, t, leaf in zip(feats, thresholds, leaves):
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            at = 2**level - 1 + node
            node = 2 * node + (x[rows, f[at]] > t[at])
        z += leaf[node]
    return z


# --- pages to learn from ---


def compose(rng) -> tuple[str, str]:
    """A page and its main text."""
    syllables = "ka lo mi ter sun ve ra do pel shi gor an en th ou la été ñu öl str and the of".split()

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(max(1, n)))

    def sentence(n: int) -> str:
        return words(n).capitalize() + rng.choice(".,!?.." if n > 5 else "   .")

    def prose() -> str:
        return " ".join(sentence(rng.randint(2, 18)) for _ in range(rng.choice((1, 1, 2, 3, 5, 8)))).strip()

    def named(tag: str, names, inner: str, bare: float = 0.15) -> str:
        w = rng.choice(names)
        w = rng.choice((w, w, f"site-{w}", f"{w}-box", f"{w} wide", f"js_{w}"))
        return f"<{tag}>{inner}</{tag}>" if rng.random() < bare else f'<{tag} {rng.choice(("class", "class", "id"))}="{w}">{inner}</{tag}>'

    def links(n: int) -> str:
        own = [f'<a href="/{i}">{words(rng.randint(1, 4))}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in own) + "</ul>" if rng.random() < 0.7 else " | ".join(own)

    said: list[str] = []

    def block(tag: str, text: str) -> str:
        said.append(" ".join(text.split()))
        own = text
        if rng.random() < 0.25 and " " in own:
            a, b = own.split(" ", 1)
            own = rng.choice((f"<b>{a}</b> {b}", f'<a href="/x">{a}</a> {b}', f"{a} <em>{b}</em>"))
        if tag == "p" and rng.random() < 0.15:
            return f"<p>{own}" if rng.random() < 0.5 else f"<p><b>{own}<br>"
        return f"<{tag}>{own}</{tag}>"

    def advert() -> str:
        return named("div", ROLES["ad"] + ["adbox"], sentence(rng.randint(2, 14)) if rng.random() < 0.7 else links(2), 0.05)

    def body() -> str:
        parts = [block("h1", sentence(rng.randint(2, 12)))] if rng.random() < 0.8 else []
        for _ in range(rng.choice((1, 2, 3, 5, 8, 14))):
            kind = rng.random()
            if kind < 0.72:
                parts.append(block("p", prose()))
            elif kind < 0.8:
                parts.append(block(rng.choice(("h2", "h3")), sentence(rng.randint(1, 6))))
            elif kind < 0.86:
                parts.append("<ul>" + "".join(block("li", sentence(rng.randint(2, 12))) for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append("<blockquote>" + block("p", prose()) + "</blockquote>")
            elif kind < 0.93:
                parts.append("<table>" + "".join("<tr>" + block("td", words(2)) + block("td", words(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.96:
                parts.append(advert())
            else:
                parts.append(named(rng.choice(("div", "aside")), ROLES["side"] + ROLES["share"], links(3)))
        return "".join(parts)

    top = [
        lambda: f"<header>{named('div', ROLES['head'], words(2))}{'<nav>' + links(5) + '</nav>' if rng.random() < 0.5 else ''}</header>",
        lambda: f"<nav>{links(rng.randint(3, 9))}</nav>",
        lambda: named("div", ROLES["nav"], links(rng.randint(3, 9)), 0.1),
        lambda: named("div", ROLES["head"], sentence(4), 0.05),
        lambda: named("div", ROLES["notice"], sentence(rng.randint(4, 20)) + "<button>OK</button>", 0.05),
        advert,
    ]
    bottom = [
        lambda: f"<aside>{rng.choice((links(4), '<h3>' + words(2) + '</h3><p>' + prose() + '</p>'))}</aside>",
        lambda: named("div", ROLES["side"], "<h3>" + words(2) + "</h3>" + links(4), 0.1),
        lambda: named(rng.choice(("div", "section")), ROLES["comment"], "<h3>" + words(1) + "</h3>" + "".join(named(rng.choice(("div", "article", "li")), ["comment", "reply"], f"<p>{prose()}</p>", 0.1) for _ in range(rng.randint(1, 5))), 0.0),
        lambda: f"<form>{words(3)}<input name=q><button>{words(1)}</button></form>",
        lambda: named("div", ROLES["form"], f"<p>{sentence(8)}</p><form><label>{words(2)}</label></form>", 0.1),
        advert,
        lambda: named("div", ROLES["share"], links(3), 0.1),
    ]
    foot = [lambda: f"<footer>&copy; {words(2)} &middot; {sentence(rng.randint(2, 9))}</footer>", lambda: named("div", ROLES["foot"], f"<p>{sentence(8)}</p>" + links(3), 0.0), lambda: f"<footer><p>{prose()}</p></footer>"]
    before = "".join(rng.choice(top)() for _ in range(rng.randint(0, 4)))
    inner = body()
    late = "".join(rng.choice(bottom)() for _ in range(rng.randint(0, 4)))
    shape = rng.random()
    if shape < 0.45:
        inner = f"<article>{inner}</article>"
    elif shape < 0.6:
        inner = f"<main>{inner}{late}</main>" if rng.random() < 0.3 else f"<main>{inner}</main>" + late
        late = ""
    elif shape < 0.9:
        inner = named(rng.choice(("div", "section")), ROLES["main"], inner, 0.1)
    if rng.random() < 0.3:
        inner = f'<div id="wrap"><div>{inner}{late}</div></div>'
        late = ""
    after = rng.choice(foot)() if rng.random() < 0.85 else ""
    head = f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style><script>x()</script></head>"
    return f"{head}<body>{before}{inner}{late}{after}</body></html>", " ".join(said)


@lru_cache(1)
def trained_model():
    """The classifier; the same in every process."""
    import random

    import numpy as np

    rng = random.Random(5)
    xs, ys = [], []
    for _ in range(TRAIN_PAGES):
        html, said = compose(rng)
        page = parse(html)
        good = np.zeros(len(page[0]))
        at = 0
        for i, t in enumerate(page[3]):  # main text comes in page order
            if t and said.startswith(t, at) and (at + len(t) == len(said) or said[at + len(t)] == " "):
                good[i] = 1
                at += len(t) + 1
        for i in range(len(good) - 1, 0, -1):
            good[page[0][i]] = max(good[page[0][i]], good[i])
        xs.append(features(page)[1:])
        ys.append(good[1:])
    return boost(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, html_col: str = "html", pass_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """pass_cols, text, n_chars, n_blocks (text runs found), n_kept (those kept) for every row. 

    A null or empty page, or one without main text, gives an empty text. Pages are read whole, however long. Repeated
    rows give repeated results; an empty table gives an empty one; of equal odds a node is left out. Columns other than
    those named play no part, whatever their names.
    """
    model = trained_model()
    longs = [T.StructField(c, T.LongType()) for c in ("n_chars", "n_blocks", "n_kept")]
    schema = T.StructType([*pages.select(*pass_cols).schema.fields, T.StructField("text", T.StringType()), *longs])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in small_batches(batches, "__html", 2 << 20):
            parsed = [parse(h) for h in texts_of(b, "__html")]
            odds = log_odds(model, np.concatenate([features(p) for p in parsed]))
            text, blocks, kept, at = [], [], [], 0
            for p in parsed:
                keep = decode(p[0], odds[at : at + len(p[0])])
                at += len(p[0])
                own = [t for t, k in zip(p[3], keep) if t and k]
                text.append(" ".join(own).encode("utf-8", "replace").decode())
                blocks.append(sum(map(bool, p[3])))
                kept.append(len(own))
            made = [pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64()), pa.array(blocks, pa.int64()), pa.array(kept, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in pass_cols] + made, names=[*pass_cols, "text", "n_chars", "n_blocks", "n_kept"])

    return map_texts(pages.select(*pass_cols, F.col(html_col).alias("__html")), run, schema)
