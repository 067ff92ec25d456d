"""Main text of web pages: boosted trees over the nodes of the DOM and hierarchical decoding.

A page becomes a tree of its block elements and runs of text. Each node has features (tag, attribute
tokens, depth, subtree text and link density, sibling statistics) from which trees estimate the
probability that its subtree belongs to the article. Decoding picks the most likely labelling in
which nothing below a dropped node is kept. The trees learn from pages generated here, whose nodes
are labelled by construction; they never see the pages of a table.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import narrowed, small_batches

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is never text of a page.
SKIPPED = frozenset("head script style noscript template textarea select button svg math iframe object canvas audio video title noembed noframes".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript template".split())
#: What may stand in a head; the start tag of another element ends an open head.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that ends an open element of these kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot menu dir body html td th".split())
NO_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
GOOD = frozenset("article articlebody content contents entry main post story text body copy prose page blog news".split())
BAD = frozenset(
    "ad ads adv advert advertisement advertising banner promo promoted sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs header masthead topbar footer foot bottom copyright legal sidebar aside rail "
    "widget related recommended more trending popular cookie cookies consent gdpr notice alert popup modal overlay comment comments commentlist reply replies disqus respond discussion feedback form login signin signup subscribe "
    "newsletter search share sharing social follow tags toc pagination pager skip hidden banner-ad toolbar contentinfo complementary dialog alertdialog".split()
)
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+(?:-ad\b)?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_ENDS = re.compile(r"[.!?,;:]")


class Node:
    __slots__ = ("tag", "parent", "kids", "good", "bad", "hidden", "depth", "text", "chars", "link_chars", "tags", "signs", "runs", "label")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids = tag, parent, []
        self.good = self.bad = 0
        self.hidden = False
        self.depth = parent.depth + 1 if parent else 0
        self.text = ""
        self.chars = self.link_chars = self.tags = self.signs = self.runs = 0
        self.label = None
        if parent:
            parent.kids.append(self)


def _attributes(node: Node, said: str) -> None:
    words: list[str] = []
    for name, value in _ATTR.findall(said):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                node.hidden = True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            node.hidden = True
        else:
            words += _WORDS.findall(_CAMEL.sub(" ", value).lower().replace("_", " "))
    node.good = sum(w in GOOD for w in words)
    node.bad = sum(w in BAD for w in words)


def parse(page: str) -> Node:
    """The tree of a page's block elements; ``text`` nodes are runs of text between block borders."""
    root = Node("html", None)
    at = root  # innermost open block
    opened: list[tuple[str, Node | None]] = []  # open elements; inline ones without a node
    parts: list[tuple[str, bool]] = []
    links = skipping = heads = 0  # open elements of these kinds
    held: dict[str, list[int]] = {}  # places in ``opened`` of the elements of each name, so that nobody has to look for one
    solid: list[int] = []  # places of those with a node

    def flush() -> None:
        if parts:
            text = " ".join("".join(x for x, _ in parts).split())
            if text:
                run = Node("text", at)
                run.text, run.chars, run.runs = text, len(text), 1
                run.link_chars = min(run.chars, sum(len(x.strip()) for x, linked in parts if linked))
                run.signs = len(_ENDS.findall(text))
            parts.clear()

    def close(k: int) -> None:
        nonlocal at, links, skipping, heads
        while len(opened) > k:
            tag, node = opened.pop()
            held[tag].pop()
            if node is not None:
                solid.pop()
                flush()
                at = node.parent
            links -= tag == "a"
            skipping -= tag in SKIPPED
            heads -= tag == "head"

    def leave_head() -> None:
        close(held["head"][0])

    def last(tags) -> int:
        return max((held[t][-1] for t in tags if held.get(t)), default=-1)

    # behind the last ">" no tag ends: what looks like the start of one there is dropped, the text before it stays
    n = page.rfind(">") + 1
    rest = _UNFINISHED.split(page[n:], maxsplit=1)[0]
    page = page[:n] + rest
    i, ends, n = 0, n, len(page)
    while i < n:
        m = _TOKEN.search(page, i, ends)
        upto = m.start() if m else n
        if heads and page[i:upto].strip():
            leave_head()
        if upto > i and not skipping:
            text = page[i:upto]
            parts.append((html.unescape(text) if "&" in text else text, links > 0))
        if not m:
            break
        i = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ending = tag.lower(), bool(m[1] or m[4])
        if ending:
            k = last((tag,))
            if k >= 0 and (tag in BLOCKS or not solid or k >= solid[-1]):  # an inline end tag doesn't close blocks
                close(k)
            continue
        if heads and tag not in IN_HEAD:
            leave_head()
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, i)
            i = end.end() if end else n
            continue
        if tag == "br":
            if not skipping:
                parts.append((" ", False))
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in NO_P and (k := last(("p",))) >= 0 and (not solid or k >= solid[-1]):
            close(k)
        if tag in CLOSES:
            holder = last(t for t in HOLDERS if t not in CLOSES[tag] and not (tag == "tr" and t in ("td", "th")))
            while (k := last(CLOSES[tag])) > holder:
                close(k)
                if tag != "tr":
                    break
        if tag == "a":
            links += 1
        if tag in SKIPPED:
            if tag != "head" and (m[3] or m[6] or "").endswith("/"):
                continue
            skipping += 1
            heads += tag == "head"
        if tag in BLOCKS and not skipping:
            flush()
            if tag == "hr":
                continue
            if tag in ("html", "body") and at is root and not root.kids:
                continue
            at = Node(tag, at)
            _attributes(at, m[3] or m[6] or "")
            opened.append((tag, at))
            solid.append(len(opened) - 1)
            held.setdefault(tag, []).append(len(opened) - 1)
        elif tag == "head" or not (m[3] or m[6] or "").endswith("/"):
            opened.append((tag, None))
            held.setdefault(tag, []).append(len(opened) - 1)
            if tag not in SKIPPED:
                at.tags += 1
    flush()
    return root


def in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.kids))
    return out


_KINDS = (
    {"article", "main"}, {"nav", "header", "footer", "aside", "form", "fieldset", "dialog", "menu"}, {"div", "section", "center"},
    {"p", "blockquote", "pre", "figcaption"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "dl", "dt", "dd"},
    {"table", "tr", "td", "th", "tbody"}, {"text"},
)
_KIND = {tag: k for k, tags in enumerate(_KINDS) for tag in tags}
WIDTH = 16 + len(_KINDS)


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node of a page, nodes in page order."""
    for node in reversed(nodes):
        node.tags += node.tag != "text"
        up = node.parent
        if up:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.signs += node.signs
            up.runs += node.runs
            up.tags += node.tags
    out = np.zeros((len(nodes), WIDTH))
    place: dict[int, int] = {}
    good: dict[int, bool] = {}
    bad: dict[int, bool] = {}
    total = max(nodes[0].chars, 1)
    for k, node in enumerate(nodes):
        up = node.parent
        if node.kids:
            for j, kid in enumerate(node.kids):
                place[id(kid)] = j
        mates = len(up.kids) if up else 1
        up_good, up_bad = (good[id(up)], bad[id(up)]) if up else (False, False)
        good[id(node)] = up_good or node.good > 0 or node.tag in _KINDS[0]
        bad[id(node)] = up_bad or node.bad > 0 or node.tag in _KINDS[1]
        row = out[k]
        row[:16] = (
            np.log1p(node.chars), node.link_chars / max(node.chars, 1), node.chars / max(node.tags, 1), node.signs / max(node.chars, 1), node.depth, node.chars / total,
            node.chars / max(up.chars, 1) if up else 1.0, mates, place.get(id(node), 0) / mates, node.good > 0, node.bad > 0, node.hidden,
            up_good, up_bad, np.log1p(node.runs), node.link_chars / max(up.chars, 1) if up else 0.0,
        )
        kind = _KIND.get(node.tag)
        if kind is not None:
            row[16 + kind] = 1
    return out


def decode(nodes: list[Node], keep: np.ndarray) -> list[str]:
    """Text runs of the most likely labelling without kept nodes below dropped ones."""
    keep = np.clip(keep, 1e-6, 1 - 1e-6)
    yes, no = -np.log(keep), -np.log1p(-keep)
    index = {id(node): k for k, node in enumerate(nodes)}
    kept, dropped = yes.tolist(), no.tolist()
    for k in range(len(nodes) - 1, 0, -1):
        up = index[id(nodes[k].parent)]
        kept[up] += min(kept[k], dropped[k])
        dropped[up] += dropped[k]
    stays = [True] * len(nodes)
    out = []
    for k in range(1, len(nodes)):
        stays[k] = stays[index[id(nodes[k].parent)]] and kept[k] <= dropped[k]
        if stays[k] and nodes[k].text:
            out.append(nodes[k].text)
    return out


def _made_page(rng: random.Random) -> str:
    """A page whose article runs start with \\x01 and all other runs with \\x02."""

    def words(least: int, most: int) -> str:
        n = rng.randint(least, most)
        return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(1, 9))) + (rng.choice(".,!?") if rng.random() < 0.12 else "") for _ in range(n))

    def main(least: int = 1, most: int = 60) -> str:
        return "\x01" + words(least, most if rng.random() < 0.7 else least + 2) + "."

    def other(least: int = 1, most: int = 14) -> str:
        return "\x02" + words(least, most) + rng.choice(["", "."])

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{other(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def attribute(names: list[str]) -> str:
        return f' {rng.choice(["class", "id"])}="{rng.choice(names)}"'

    def block() -> str:
        kind = rng.random()
        if kind < 0.62:
            return f"<p>{main()}" + rng.choice(["</p>", "</p>", "", "<br>"])
        if kind < 0.7:
            return f"<p><b>{main()}<br>"
        if kind < 0.78:
            return f"<h{(h := rng.randint(2, 4))}>{main(1, 9)}</h{h}>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{main(1, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote><p>{main()}</p></blockquote>"
        if kind < 0.91:
            return f"<pre>{main()}</pre>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{main(1, 4)}</td><td>{main(1, 4)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.97:
            return f'<p>{main()} <a href="/y">{words(1, 3)}</a> {words(1, 9)}</p>'
        return f"<div>{main()}</div>"

    def junk() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            tag = rng.choice(["div", "aside", "section"])
            text = other(1, 40)
            return f'<{tag}{attribute(["ad", "ads", "advert", "banner", "sponsored", "promo-box"])}>{rng.choice([text, f"<p>{text}</p>", links(2) + text])}</{tag}>'
        if kind == 1:
            return f"<aside{rng.choice(['', attribute(['sidebar', 'rail'])])}>{links(rng.randint(1, 6))}{rng.choice(['', f'<p>{other(3, 50)}</p>'])}</aside>"
        if kind == 2:
            return f'<div{attribute(["sidebar", "related", "widget", "recommended", "trending"])}><h3>{other(1, 4)}</h3>{links(rng.randint(1, 6))}<p>{other(1, 30)}</p></div>'
        if kind == 3:
            tag = rng.choice(["div", "section", "ol"])
            return f'<{tag}{attribute(["comments", "comment-list", "replies", "discussion"])}>' + "".join(f'<{rng.choice(["div", "p", "li"])} class="{rng.choice(["comment", "reply", "body"])}">{other(1, 60)}' for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        if kind == 4:
            return f'<div{attribute(["cookie-notice", "consent", "notice", "gdpr", "popup", "alert"])}>{other(3, 40)}<p>{other(1, 20)}</p></div>'
        if kind == 5:
            return f'<form{rng.choice(["", attribute(["search", "newsletter", "login"])])}><p>{other(1, 12)}</p><label>{other(1, 3)}</label><input name="q"></form>'
        if kind == 6:
            return f'<div{attribute(["share", "social", "breadcrumb", "tags", "pagination"])}><a href="/z">{other(1, 3)}</a> <a href="/z">{words(1, 3)}</a></div>'
        if kind == 7:
            return f"<nav>{links(rng.randint(1, 7))}</nav>"
        return f'<p class="{rng.choice(["ad", "notice", "copyright", "promo"])}">{other(2, 30)}</p>'

    title = main(1, 9)
    body = "".join(block() for _ in range(0 if rng.random() < 0.03 else rng.randint(1, 14)))
    holder = rng.choice(["<article>", "<article>", "<article class='post'>", "<main>", "<div class='content'>", "<div id='main-content'>", "<section class='story'>", "<div>", "<div class='entry-content'>"])
    tag = re.match(r"<(\w+)", holder)[1]
    inside = [junk() for _ in range(rng.choice([0, 0, 0, 1, 2]))]
    article = f"{holder}{rng.choice([f'<h1>{title}</h1>', f'<h1>{title}</h1>', f'<header><h1>{title}</h1></header>', ''])}{body}{''.join(inside)}</{tag}>"
    if rng.random() < 0.3:
        article = f"<main>{article}</main>" if tag != "main" else f"<div class='page'>{article}</div>"
    head = rng.choice(["", f"<header><h2>{other(1, 6)}</h2>{links(3)}</header>", f"<header>{other(1, 12)}</header>", f"<div class='header'><p>{other(1, 20)}</p></div>", f"<div id='masthead'>{other(1, 9)}</div>"])
    foot = rng.choice([f"<footer>{other(1, 30)}</footer>", f"<footer><p>{other(1, 30)}</p>{links(2)}</footer>", f"<div class='footer'>{other(1, 30)}</div>", f"<footer>&copy; {other(1, 30)}\n{words(1, 40)}</footer>", ""])
    before = [f"<nav>{links(rng.randint(1, 7))}</nav>" if rng.random() < 0.7 else "", *(junk() for _ in range(rng.randint(0, 3)))]
    after = [junk() for _ in range(rng.randint(0, 3))]
    return f"<html><head><title>{words(1, 5)}</title></head><body>{head}{''.join(before)}{article}{''.join(after)}{foot}</body></html>"


@lru_cache(maxsize=1)
def model(pages: int = 500, seed: int = 10) -> gbt.Trees:
    """Trees fitted to generated pages; the same in every process."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = in_order(parse(_made_page(rng)))
        for node in reversed(nodes):
            if node.text:
                node.label = "\x01" in node.text
            elif node.kids:
                node.label = any(k.label for k in node.kids)
        known = [k for k, node in enumerate(nodes) if node.label is not None]
        xs.append(features(nodes)[known])
        ys.append(np.array([nodes[k].label for k in known], float))
    return gbt.fit(np.concatenate(xs), np.concatenate(ys), trees=60, depth=4)


def main_texts(pages: list[str | None], trees: gbt.Trees) -> list[str]:
    """Main text of whole pages; blocks are parted by an empty line."""
    trees_of = [in_order(parse(x or "")) for x in pages]
    sizes = [len(x) for x in trees_of]
    keep = trees.probability(np.concatenate([features(x) for x in trees_of])) if trees_of else np.zeros(0)
    out, at = [], 0
    for nodes, n in zip(trees_of, sizes):
        out.append("\n\n".join(decode(nodes, keep[at : at + n])))
        at += n
    return out


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, text (empty if there is none) and n_chars (code points) of each whole page.

    A null or empty page has an empty text, broken markup is read as browsers roughly do, repeated
    rows give repeated results, other columns don't matter, a kept column named like a result's gets
    _given behind its name, an empty table gives no rows. Time and memory are linear in a page.
    """
    small_batches(pages.sparkSession)
    source, names, schema = narrowed(pages, keep, "text string, n_chars bigint", F.col(f"`{page}`"))
    trees = model()

    def run(batches):
        for batch in batches:
            texts: list[str] = []
            whole = batch.column(len(names)).to_pylist()
            for k in range(0, len(whole), 200):
                texts += main_texts(whole[k : k + 200], trees)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)
