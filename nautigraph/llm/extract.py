"""Main-text extraction by minimum-cut labelling.

A page becomes blocks of text with what its markup says about each.  A logistic classifier gives every block
log-odds of being content; they become capacities from the source (content) or to the sink (boilerplate).
Neighbouring blocks and neighbours within the same container are joined by smoothness edges that weigh more
the closer the two are in the document tree.  The minimum cut is the labelling of least total cost.

Blocks whose own log-odds outweigh all their edges are settled first, their edges going to their neighbours'
terminals; maximum flow runs on what is left, so long pages take time in proportion to their length.

The classifier is fitted on pages that `sample_pages()` writes from a fixed seed; no table is read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

#: Smoothness of following blocks and of followers in one container, in nats, halved per step of tree distance.
FOLLOW, CONTAINER = 1.0, 0.8

# Fixed values of HTML: elements by their part in the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title noscript template iframe textarea select svg canvas head audio video".split())
#: Skipped elements without raw text: if they aren't closed, they end at the next block.  svg ends there anyway, as in HTML parsers.
LEFT_AT_BLOCKS = frozenset("canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main maincontent post story text prose".split())
BOILER_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs byline consent cookie cookies copyright footer gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notification pagination pager popup privacy promo promoted promotion related recommended search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription tags toolbar widget warning alert overlay".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus reader replies reply respond responses".split())
#: Parts that make a compound name tell of something else than its element: what a page has or how it stands.
PREFIXES = frozenset("has have with without no not is are show hide js can tag tags category cat type format status layout page theme u l".split())
STATES = frozenset("enabled disabled on off yes no true false active inactive open opened closed ready loaded supported allowed visible free less".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")

FEATURES = (
    "bias", "article", "main", "content_name", "boiler_name", "comment_name", "nav", "aside", "footer", "header", "header_in_article", "form", "list", "table",
    "heading", "paragraph", "caption", "link_share", "all_link", "log_length", "short", "sentence_end", "copyright", "bare_body", "nearest_content", "nearest_boiler", "boiler_part",
)


@dataclass
class Node:
    """An open element with what it and its ancestors say."""

    tag: str
    depth: int
    container: int  # number of the nearest element that isn't a paragraph, heading or inline
    marks: frozenset = frozenset()
    nearest: float = 0  # 1, -1 or, for part of a name, -0.5: what the innermost telling element says
    boiler: float = 0  # 1 within an element named as boilerplate, half as much with each telling element of content between
    part: float = 0  # the same for parts of names
    named: int = 0  # the element whose name's part that is


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return _SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()


def parse(page: str) -> list[tuple[Block, str]]:
    """Blocks with their text, in page order; blocks without text are left out."""
    out: list[tuple[Block, str]] = []
    root = Node("#", 0, 0)
    stack, open_, numbers, links = [root], {}, 0, 0
    block = Block(root)
    pattern, at, n = _TAG, 0, len(page)
    endless: set[str] = set()

    def end_block() -> None:
        nonlocal block
        if block.parts and (t := block.text()):
            out.append((block, t))
        block = Block(stack[-1])

    def add(text: str) -> None:
        if text:
            block.parts.append(text)
            if links:
                block.linked += len(text)

    def pop_to(tag: str) -> None:
        nonlocal links
        while True:
            top = stack.pop()
            open_[top.tag] -= 1
            if top.tag == "a":
                links -= 1
            if top.tag == tag:
                return

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            close = ("-->", 3) if page.startswith("<!--", lt) else (">", 1)
            end = page.find(close[0], lt + 2)
            at = n if end < 0 else end + close[1]
            continue
        m = pattern.match(page, lt)
        if m is None and (nxt.isalpha() or nxt == "/") and nxt.isascii():
            # a quote that never closes: from here on tags end at the next >
            pattern = _LOOSE
            m = pattern.match(page, lt)
            if m is None and page.find(">", lt) < 0 and re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):
                break  # an unfinished tag at the end is no text
        if m is None:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attrs = bool(m[1]), m[2].lower(), m[3]
        if not closing and tag in SKIPPED:
            if tag == "head":
                continue  # what it may hold is skipped by itself
            if tag != "svg" or not attrs.endswith("/"):  # a slash ends no other of these
                at = _skip(page, tag, at, endless)
            if tag in ("textarea", "select", "iframe", "video", "audio"):
                end_block()
            continue
        if tag in ("br", "hr"):
            add(" ") if tag == "br" else end_block()
            continue
        if tag in VOID:
            continue
        inner = tag in BLOCKS
        if closing:
            if open_.get(tag):
                if not inner and any(x.tag in BLOCKS for x in _above(stack, tag)):
                    continue  # an inline end tag doesn't close blocks
                pop_to(tag)
            if inner:
                end_block()
            continue
        if inner:
            if open_.get("p") and stack[-1].tag != "button":
                pop_to("p")
            if tag in ("li", "dt", "dd", "option", "td", "th", "tr") and open_.get(tag) and _within(stack, tag):
                pop_to(tag)
        parent = stack[-1]
        numbers += 1
        plain = not inner or tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6")
        stack.append(Node(tag, parent.depth + inner, parent.container if plain else numbers, *_read(tag, attrs, parent, numbers)))
        open_[tag] = open_.get(tag, 0) + 1
        links += tag == "a"
        if inner:
            end_block()
    end_block()
    return out


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


#: What HTML parsers leave svg at, its end, and parts of it that may hold blocks.
_BLOCK = rf"<(?:{'|'.join(sorted(BLOCKS - {'html', 'body', 'legend', 'option'}))})(?=[\s/>])"
_FIRST_BLOCK = re.compile(_BLOCK, re.I)
_SVG = re.compile(rf"(?P<end></svg(?=[\s/>])[^>]*>)|<(?P<part>foreignobject|desc)(?=[\s/>])|{_BLOCK}", re.I)


def _skip(page: str, tag: str, at: int, endless: set[str]) -> int:
    """Where the skipped element that begins at `at` ends; endless holds tags that are not closed any more."""

    def end(tag: str, at: int) -> int | None:
        gone = None if tag in endless else _end_of(tag).search(page, at)
        if gone is None:
            endless.add(tag)
        return gone and gone.end()

    if tag == "svg":
        while m := _SVG.search(page, at):
            if m["end"]:
                return m.end()
            if not m["part"]:
                return m.start()
            at = end(m["part"].lower(), m.end()) or m.end()
        return len(page)
    if (out := end(tag, at)) is None and tag in LEFT_AT_BLOCKS and (m := _FIRST_BLOCK.search(page, at)):
        return m.start()
    return len(page) if out is None else out


def _above(stack: list[Node], tag: str) -> Iterator[Node]:
    for x in reversed(stack):
        if x.tag == tag:
            return
        yield x


def _within(stack: list[Node], tag: str) -> bool:
    """Whether tag is open within the current list or table."""
    stop = {"ul", "ol", "menu", "dl", "select", "table"} - {tag}
    for x in reversed(stack):
        if x.tag == tag:
            return True
        if x.tag in stop:
            return False
    return False


@lru_cache(10_000)
def _told(name: str) -> str:
    """What a class token or the like tells: comment, boiler, content, part (a compound with a boilerplate word) or nothing."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    whole = "".join(parts)
    for kind, words in (("comment", COMMENT_WORDS), ("boiler", BOILER_WORDS), ("content", CONTENT_WORDS)):
        if whole in words:
            return kind
    if len(parts) < 2 or parts[0] in PREFIXES or parts[-1] in STATES:
        return ""
    if not COMMENT_WORDS.isdisjoint(parts):
        return "comment"
    boiler, content = (not words.isdisjoint(parts) for words in (BOILER_WORDS, CONTENT_WORDS))
    if boiler and content:  # post-footer, footer-content, but not content-sidebar-wrap
        return "part" if parts[-1] in BOILER_WORDS or parts[0] in BOILER_WORDS else ""
    return "part" if boiler else "content" if content else ""


def _read(tag: str, attrs: str, parent: Node, number: int) -> tuple[frozenset, float, float, float, int]:
    """Marks, nearest, boiler, part and named of a new element, from its tag and names and its parent's."""
    new = set()
    nearest, boiler, part, named = parent.nearest, parent.boiler, parent.part, parent.named
    body = tag in ("article", "main")
    if body:
        new.add(tag)
        nearest = 1
    elif tag in ("nav", "aside", "footer", "form", "menu", "dialog", "button", "fieldset", "search"):
        new.add("form" if tag in ("button", "fieldset", "search") else "nav" if tag == "menu" else "aside" if tag == "dialog" else tag)
        nearest = -1
    elif tag == "header":
        new.add("header_in_article" if parent.marks & {"article", "main"} else "header")
        nearest = nearest if parent.marks & {"article", "main"} else -1
    elif tag in ("ul", "ol", "dl"):
        new.add("list")
    elif tag == "table":
        new.add("table")
    elif tag in ("figcaption", "caption"):
        new.add("caption")
    elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        new.add("heading")
    elif tag in ("p", "blockquote", "pre"):
        new.add("paragraph")
    told: set[str] = set()
    if attrs and tag != "body" and tag != "html":
        told = {_told(name) for m in _NAMES.finditer(attrs) for name in (m[1] or m[2] or m[3] or "").split()}
        if _HIDDEN.search(attrs):
            told.add("boiler")
    if "comment" in told:
        new.add("comment_name")
        nearest = -1
    elif "boiler" in told:
        nearest, boiler = -1, 1.0
    elif body or "content" in told:
        if "content" in told:
            new.add("content_name")
        nearest = 1 if body or "comment_name" not in parent.marks else nearest
        boiler, part = (0.0, 0.0) if tag == "main" else (boiler / 2, part / 2)
    elif "part" in told:
        nearest, part, named = min(nearest, -0.5), 1.0, number
    return (parent.marks | new if new else parent.marks), nearest, boiler, part, named


def features(blocks: list[tuple[Block, str]]) -> np.ndarray:
    """A row for each block of a page.

    A part of a name tells nothing where its element holds most of the page's text: that is a layout.
    """
    held: dict[int, int] = {}
    for b, text in blocks:
        held[b.node.named] = held.get(b.node.named, 0) + len(text)
    half = sum(held.values()) / 2
    return np.stack([_row(b, text, held[b.node.named] > half) for b, text in blocks])


def _row(block: Block, text: str, layout: bool) -> np.ndarray:
    node, n = block.node, len(text)
    m, part, nearest = node.marks, node.part, node.nearest
    if layout:
        part, nearest = 0.0, 0.0 if nearest == -0.5 else nearest
    share = min(1.0, block.linked / max(1, sum(map(len, block.parts))))
    return np.array([
        1.0, "article" in m, "main" in m, "content_name" in m, node.boiler, "comment_name" in m, "nav" in m, "aside" in m, "footer" in m, "header" in m, "header_in_article" in m, "form" in m, "list" in m, "table" in m,
        "heading" in m, "paragraph" in m, "caption" in m, share, share > 0.9, np.log1p(n) / 5, n < 25, text[-1] in ".!?…:;\"”", "©" in text or text.lower().startswith("copyright"), node.container <= 2, nearest > 0, max(-nearest, 0), part,
    ], float)


def edges(blocks: list[tuple[Block, str]]) -> list[tuple[int, int, float]]:
    """Smoothness edges: followers in the page and followers in one container."""
    out, last = [], {}
    for k, (b, _) in enumerate(blocks):
        if k:
            a = blocks[k - 1][0].node
            far = 0 if a.container == b.node.container else 1 + abs(a.depth - b.node.depth) + ((a.nearest > 0) != (b.node.nearest > 0) or (a.nearest < 0) != (b.node.nearest < 0)) * 2
            out.append((k - 1, k, FOLLOW * 0.5**far))
        if (j := last.get(b.node.container)) is not None and j != k - 1:
            out.append((j, k, CONTAINER))
        last[b.node.container] = k
    return out


def min_cut(terminal: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it's on the source side of a minimum cut; ties fall to the sink.

    terminal: capacity from the source if positive, to the sink if negative.  links: symmetric capacities.
    """
    n = len(terminal)
    u, near = list(terminal), [dict() for _ in range(n)]
    for a, b, w in links:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # settle what its own terminal decides
        i = queue.popleft()
        if label[i] is not None:
            continue
        around = sum(near[i].values())
        if u[i] > around or u[i] <= -around:
            label[i] = u[i] > around
            for j, w in near[i].items():
                u[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, side in zip(left, _max_flow(left, u, near)):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], u: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm between the terminals; which nodes the source still reaches."""
    place = {i: k for k, i in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(t + 1)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in nodes:
        if u[i] > 0:
            arc(s, place[i], u[i], 0.0)
        elif u[i] < 0:
            arc(place[i], t, -u[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                arc(place[i], place[j], w, w)
    eps = 1e-12
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        step = [0] * (t + 1)
        path: list[int] = []
        a = s
        while True:  # depth first, without recursion
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= eps)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while step[a] < len(out[a]):
                e = out[a][step[a]]
                if cap[e] > eps and level[to[e]] == level[a] + 1:
                    break
                step[a] += 1
            else:
                if a == s:
                    break
                e = path.pop()
                a = to[e ^ 1]
                step[a] += 1
                continue
            path.append(e)
            a = to[e]


#: Names of layouts and states that hold words of boilerplate.
MISLEADING = (
    "layout has-sidebar", "wrap content-sidebar-wrap", "no-ads", "page with-footer", "post tags-news share-enabled", "entry category-advertising", "container sidebar-left",
    "js-nav-open", "grid header-fixed", "comments-open", "post type-post format-banner", "site cookie-ready", "story share-on", "is-menu-closed", "body-with-banner",
)


def sample_pages(n: int = 240, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages with the label of each of their blocks, written from a seed: several layouts with and without telling markup."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ka", "lo", "mi", "ner", "sta", "ing", "po", "re", "du", "e")) for _ in range(r.randint(1, 4)))
    sentence = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    out = []
    for _ in range(n):
        parts: list[str] = []
        labels: list[bool] = []

        def put(markup: str, content: bool, blocks: int = 1) -> None:
            parts.append(markup)
            labels.extend([content] * blocks)

        def menu(tag: str) -> None:
            k = r.randint(2, 7)
            put(f"{tag}<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k)) + "</ul></" + tag[1:].split()[0].rstrip(">") + ">", False, k)

        if r.random() < 0.5:
            put(f"<header><p>{word()} {word()}</p></header>", False)
        if r.random() < 0.8:
            menu(r.choice(("<nav>", '<div class="menu">', '<div id="nav">', "<nav>")))
        extras = (
            lambda: put(f'<div class="{r.choice(("ad", "ads", "banner", "advert", "sponsored"))}">{sentence(r.randint(3, 14))}</div>', False),
            lambda: put(f"<aside><p>{sentence(r.randint(4, 20))}</p></aside>", False),
            lambda: put(f'<div class="{r.choice(("sidebar", "related", "widget", "left-sidebar", "sidebar-right", "related-posts"))}"><p>{sentence(r.randint(4, 20))}</p></div>', False),
            lambda: put(f'<div class="{r.choice(("cookie-notice", "consent", "notice", "popup"))}"><p>{sentence(r.randint(5, 20))}</p></div>', False),
            lambda: put(f"<form><label>{word()}</label><button>{word()}</button></form>", False, 2),
        )
        for _ in range(r.randint(0, 2)):
            r.choice(extras)()
        tag = r.choice(("article", "article", "main", 'div class="content"', 'div id="post"', "div", "section"))
        if wrapped := r.random() < 0.4:  # names around the article that say nothing of it
            parts.append(f'<div class="{r.choice(MISLEADING)}">')
        if r.random() < 0.3 and " " not in tag:
            parts.append(f'<{tag} class="{r.choice(MISLEADING)}">')
        else:
            parts.append(f"<{tag}>")
        put(f"<h1>{sentence(r.randint(2, 8))}</h1>", True)
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.8:
                put(f"<p>{' '.join(sentence(r.randint(1, 14)) for _ in range(r.randint(1, 6)))}</p>", True)
            elif kind < 0.88:
                put(f"<h2>{sentence(r.randint(1, 5))}</h2>", True)
            elif kind < 0.94:
                put(f"<ul><li>{sentence(5)}</li><li>{sentence(3)}</li></ul>", True, 2)
            elif kind < 0.97:
                put(f'<p><a href="/x">{sentence(6)}</a> {sentence(5)}</p>', True)
            else:
                r.choice(extras)()
        parts.append(f"</{tag.split()[0]}>" + "</div>" * wrapped)
        if r.random() < 0.4:
            k = r.randint(1, 5)
            put(f'<{r.choice(("section", "div"))} class="{r.choice(("comments", "comment-list", "replies"))}">' + "".join(f"<p>{sentence(r.randint(3, 25))}</p>" for _ in range(k)) + "</section>", False, k)
        for _ in range(r.randint(0, 2)):
            r.choice(extras)()
        if r.random() < 0.9:
            put(r.choice((f"<footer>&copy; {word()} &middot; {sentence(r.randint(2, 9))}</footer>", f'<div class="footer"><p>Copyright {sentence(4)}</p></div>')), False)
        out.append(("<html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>", labels))
    return out


@lru_cache(1)
def trained() -> np.ndarray:
    """Weights of the classifier: ridge logistic regression on sample_pages(), by Newton's method."""
    x, y = [], []
    for page, labels in sample_pages():
        blocks = parse(page)
        if len(blocks) != len(labels):
            raise AssertionError("sample pages and parser disagree")
        x += list(features(blocks))
        y += labels
    x, y = np.stack(x), np.array(y, float)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        d = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += d
        if np.abs(d).max() < 1e-8:
            break
    return w


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The content blocks of a page in page order, joined by single blanks; empty if there are none."""
    blocks = parse(page or "")
    if not blocks:
        return ""
    odds = (features(blocks) @ weights).tolist()
    keep = min_cut(odds, edges(blocks))
    return " ".join(t for (_, t), k in zip(blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null or empty html, and a page without content, give an empty text.  Rows are treated one by one, so
    repeated rows, null ids and extra columns are of no account.
    """
    weights = trained()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for page_id, url, page in rows:
            text = main_text(page, weights)
            yield page_id, url, text, len(text)

    return map_rows(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", run)
