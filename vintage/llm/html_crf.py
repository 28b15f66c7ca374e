"""Operator 3: main text of web pages by a linear-chain conditional random field.

A page becomes a sequence of leaf blocks: runs of text between block-level
tags. A block's features are its ancestors' tags and the hints in their class,
id and role, and properties of its text; neighbouring labels (main text or
not) are tied by transition weights. Weights are trained by the gradient of
the conditional likelihood (forward-backward) and blocks are labelled by Viterbi.

Labelled pages come from two places, both of documented size: pages of the
table with an ``article`` or ``main`` landmark, whose blocks are labelled by it
(``max_pages`` of least hash), and layouts built around those pages' own
sentences (``built_pages``), in which the label of each block is known and
landmarks are often missing. The trained field is applied to every page.

Half of the training pages are shown again with their hints, their telling
elements (article, nav, footer, ...) or both taken off, so that a page without
them is judged by its text and by how its characters are shared out.

Edge cases: null or empty html gives the empty text; html without tags is one
block; unclosed and stray tags are tolerated: an open head ends at the first
element or text that cannot stand in it, an unclosed drawing, choice or media
element ends with its parent or hides nothing; only an unclosed script, style or
comment hides the rest, as it does in a browser. Scripts, styles, comments, the
head and other unseen elements never give text; repeated pages give repeated
rows. Character references are decoded after the tags are found. A ``br`` ends a
block. Pages of any length are read whole, in one pass; elements nested deeper
than ``DEPTH`` add nothing to a path. An empty table gives no rows; extra columns
are kept, but ``text`` and ``n_chars`` of the input give way to the new ones.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm.common import exact, table

#: Fixed lists of HTML element names. Elements whose content is never shown:
HIDDEN = frozenset("noscript template svg math object select canvas audio video foreignobject".split())
#: Of these, those that may hold themselves.
NESTING = frozenset("svg math foreignobject template object".split())
#: Elements whose content is text up to their own end tag, never shown either.
RAW = frozenset("script style title textarea iframe noembed noframes".split())
#: What can stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Block elements that a select may hold.
IN_SELECT = frozenset("option optgroup hr legend button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: An opening tag ends these open elements (not beyond a container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl menu table tbody thead tfoot div section article main body html nav aside header footer form blockquote td th li dd fieldset".split())
#: Fixed hints in class, id and role.
BAD_HINTS = (
    "nav menu header footer sidebar aside ad ads advert adverts advertisement sponsor promo banner cookie cookies notice consent gdpr alert "
    "comment comments reply replies discussion disqus share social form login signup subscribe newsletter related recommended breadcrumb "
    "breadcrumbs widget popup modal overlay copyright legal search pagination pager tags toolbar masthead topbar complementary navigation contentinfo"
).split()
GOOD_HINTS = "article content main post entry story body text prose page blog news".split()
_BAD, _GOOD = frozenset(BAD_HINTS), frozenset(GOOD_HINTS)
_KNOWN = _BAD | _GOOD

_TOKEN = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""  # a tag
    r"""|<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<[!?/][^>]*+>"""  # comments and declarations
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^<>]*+)(?:>|\Z)"""  # a tag with an odd number of quotes, or without an end
    r"""|([^<]++|<)"""
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_END_OF = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW | HIDDEN}
_EITHER_OF = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in HIDDEN}
#: Elements deeper than this are matched with their end tags, but add nothing to a path.
DEPTH = 256


class Block(NamedTuple):
    text: str
    #: Ancestors from the root, each a tag and its known hints.
    path: tuple[str, ...]
    #: Characters inside links.
    linked: int
    #: Number of the element that holds the block's own element.
    parent: int


def blocks(page: str | None) -> list[Block]:
    """Each leaf block that has text, in page order."""
    if not page:
        return []
    out: list[Block] = []
    #: tag, path, number
    stack: list[tuple[str, tuple[str, ...], int]] = []
    count: dict[str, int] = {}  # open elements of each tag
    parts: list[str] = []
    linked, in_link, hidden, in_head, number = 0, False, 0, False, 0
    last_end: dict[str, int] = {}

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else (), min(linked, len(text)), stack[-2][2] if len(stack) > 1 else 0))
            parts, linked = [], 0

    def push(tag: str, rest: str) -> None:
        nonlocal hidden, number
        path = stack[-1][1] if stack else ()
        number += 1
        if tag in HIDDEN:
            hidden += 1
        elif len(path) < DEPTH:
            path = (*path, tag if "=" not in rest else element(tag, rest))
        stack.append((tag, path, number))
        count[tag] = count.get(tag, 0) + 1

    def cut(i: int) -> None:
        """Close the i-th open element and all inside it."""
        nonlocal hidden
        for tag, _, _ in stack[i:]:
            count[tag] -= 1
            hidden -= tag in HIDDEN
        del stack[i:]

    def open_at(tag: str) -> int:
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)

    def ends_later(tag: str, at: int) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in _END_OF[tag].finditer(page)), default=-1)
        return last_end[tag] >= at

    def ends_next(tag: str, at: int) -> bool:
        """For elements that never hold themselves: whether an end comes before another start."""
        m = _EITHER_OF[tag].search(page, at)
        return m is not None and m[1] == "/"

    at, size = 0, len(page)
    match = _TOKEN.match
    while at < size:
        m = match(page, at)
        at = m.end()
        end, tag, rest, odd_end, odd_tag, odd_rest, text = m.groups()
        if text:
            if in_head:
                in_head = text.isspace()
            if not hidden and not in_head:
                parts.append(text)
                if in_link:
                    linked += len(text)
            continue
        if odd_tag:
            end, tag, rest = odd_end, odd_tag, odd_rest
        if not tag:
            continue
        tag = tag.lower()
        if in_head and (end and tag in ("head", "body", "html") or not end and tag not in IN_HEAD and tag not in ("head", "html")):
            in_head = False
        if tag in RAW:
            # unseen up to the end tag; without one, code hides the rest of the page and other elements hide nothing
            if not end and not (hidden and rest.endswith("/")):
                if ends_later(tag, at):
                    at = _END_OF[tag].search(page, at).end()
                elif tag in ("script", "style"):
                    break
            continue
        if tag in HIDDEN:
            if end:
                if count.get(tag):
                    cut(open_at(tag))
            elif tag == "foreignobject" and not hidden:
                continue
            elif not (tag in NESTING and rest.endswith("/")) and (ends_later(tag, at) if tag in NESTING else ends_next(tag, at)):
                push(tag, rest)
            continue
        if tag == "head":
            in_head = not end and not out and not parts
            continue
        if tag in BLOCK:
            if end:
                if count.get(tag):
                    i = open_at(tag)
                    if hidden == sum(t in HIDDEN for t, _, _ in stack[i:]):  # it is not inside a hidden one
                        flush()
                    cut(i)
                elif not hidden:
                    flush()
                continue
            if hidden and not count.get("template"):
                # flow content ends an open drawing, formula or choice
                inner = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in HIDDEN)
                if stack[inner][0] in ("svg", "math") or stack[inner][0] == "select" and tag not in IN_SELECT:
                    cut(inner)
            if not hidden:
                flush()
            if stack and stack[-1][0] == "p":
                cut(len(stack) - 1)
            closes = CLOSES.get(tag)
            if closes and any(count.get(t) for t in closes):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        cut(i)
                        break
                    if stack[i][0] in CONTAINERS:
                        break
            if tag not in VOID and not rest.endswith("/"):
                push(tag, rest)
        elif tag == "a" and not hidden:
            in_link = not end
    flush()
    return out


def element(tag: str, rest: str) -> str:
    """The tag with the known hints in its class, id and role."""
    words = {w for v in _NAMED.findall(rest) for w in _WORD.findall("".join(v).lower())}
    return " ".join([tag, *sorted(words & _KNOWN)])


# --------------------------------------------------------------- features
_paths: dict[tuple[str, ...], list[str]] = {}


def path_features(path: tuple[str, ...]) -> list[str]:
    found = _paths.get(path)
    if found is None:
        names = [p.split() for p in path]
        hints = {w for n in names for w in n[1:]}
        found = ["in=" + t for t in {n[0] for n in names}] + ["hint=" + w for w in hints if w in _BAD or w in _GOOD]
        found += ["last=" + (names[-1][0] if names else "-"), "bad" if hints & _BAD else "not bad", "good" if hints & _GOOD else "not good"]
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = found
    return found


def features(page: list[Block]) -> list[list[str]]:
    """Names of what holds of each block: its ancestors and hints, its text and
    the text about it, and its part of the page's characters."""
    out = []
    n = len(page)
    total = sum(len(b.text) for b in page)
    mass: dict[int, int] = {}
    number: dict[int, int] = {}
    for b in page:
        mass[b.parent] = mass.get(b.parent, 0) + len(b.text)
        number[b.parent] = number.get(b.parent, 0) + 1
    most = max(mass.values(), default=1)
    # what a block's place and the lack of hints mean depends on the hints that the page has at all
    words = {w for b in page for name in b.path for w in name.split()}
    level = "landmark" if words & LANDMARKS else "hint" if words & _GOOD else "none"
    seen, sizes = 0, [min(9, len(b.text).bit_length()) for b in page]
    links = [4 * b.linked // len(b.text) for b in page]
    for i, (text, path, _, parent) in enumerate(page):
        size = len(text)
        own = path_features(path)
        f = [*own, own[-2] + "," + level, own[-1] + "," + level, "size=%d" % sizes[i], "links=%d" % links[i]]
        f.append("stop" if text[-1] in ".!?:;\"')»”" else "no stop")
        f.append("at=%d" % (4 * i // n))
        if "©" in text:
            f.append("copyright")
        if text.count(" ") < 2:
            f.append("few words")
        f.append("past=%d" % (5 * seen // total))
        f.append("with=%d,%s" % (5 * mass[parent] // most, level))
        f.append("peers=%d,%s" % (min(4, number[parent].bit_length()), level))
        f.append("before=%d,%d" % (sizes[i - 1], links[i - 1] > 1) if i else "first")
        f.append("after=%d,%d" % (sizes[i + 1], links[i + 1] > 1) if i + 1 < n else "final")
        if i:
            f.append("one home" if page[i - 1].parent == parent else "new home")
        seen += size
        out.append(f)
    return out


# ------------------------------------------------------------------ field
class Field:
    """Two labels; an emission weight for each feature, in favour of label 1,
    and transition weights [from][to]."""

    def __init__(self) -> None:
        self.emit: dict[str, float] = {"bias": 0.0}
        self.move = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, page: list[list[str]]) -> list[float]:
        get, bias = self.emit.get, self.emit["bias"]
        return [bias + sum([get(f, 0.0) for f in block]) for block in page]

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi."""
        (a, b), (c, d) = self.move
        zero, one, back = 0.0, 0.0, []
        for i, s in enumerate(self.scores(page)):
            if i:
                from_zero, from_one = (0 if zero + a >= one + c else 1), (0 if zero + b > one + d else 1)
                zero, one = max(zero + a, one + c), max(zero + b, one + d) + s
                back.append((from_zero, from_one))
            else:
                one = s
        if not page:
            return []
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.2, decay: float = 1e-4, seed: int = 3) -> "Field":
        rng = random.Random(seed)
        square: dict[str, float] = {}
        for _ in range(epochs):
            rng.shuffle(pages)
            for page, labels in pages:
                p, pairs = self.marginals(page)
                for block, want, is_one in zip(page, labels, p):
                    g = want - is_one
                    if abs(g) < 1e-4:
                        continue
                    for f in (*block, "bias"):
                        square[f] = square.get(f, 1e-2) + g * g
                        w = self.emit.get(f, 0.0)
                        self.emit[f] = w + rate * (g / math.sqrt(square[f]) - decay * w)
                for x in (0, 1):
                    for y in (0, 1):
                        seen = sum(1 for u, v in zip(labels, labels[1:]) if (u, v) == (x, y))
                        g = (seen - pairs[x][y]) / max(1, len(labels))
                        self.move[x][y] += rate * (g - decay * self.move[x][y])
        return self

    def marginals(self, page: list[list[str]]) -> tuple[list[float], np.ndarray]:
        """P(label 1) of each block and expected counts of transitions."""
        s = np.stack([np.zeros(len(page)), np.array(self.scores(page), float)], axis=1)
        t = np.array(self.move)
        fwd, bwd = np.zeros_like(s), np.zeros_like(s)
        fwd[0] = s[0]
        for i in range(1, len(s)):
            fwd[i] = s[i] + np.logaddexp(fwd[i - 1, 0] + t[0], fwd[i - 1, 1] + t[1])
        for i in range(len(s) - 2, -1, -1):
            z = t + s[i + 1] + bwd[i + 1]
            bwd[i] = np.logaddexp(z[:, 0], z[:, 1])
        total = np.logaddexp(*fwd[-1])
        p = np.exp(fwd + bwd - total)[:, 1]
        pairs = np.zeros((2, 2))
        if len(s) > 1:
            pairs = np.exp(fwd[:-1, :, None] + t[None] + (s[1:] + bwd[1:])[:, None, :] - total).sum(axis=0)
        return p.tolist(), pairs


# ----------------------------------------------------------- labelled pages
LANDMARKS = frozenset({"article", "main"})
_MARK = "\ue000"  # private use: set before main text while building a page


def by_landmark(page: list[Block]) -> list[int] | None:
    """Labels from the page's own article or main element; None without one.
    What such an element holds of menus, comments, forms and the like is not main text."""
    if not any(p.split()[0] in LANDMARKS for b in page for p in b.path):
        return None
    out = []
    for b in page:
        names = [p.split() for p in b.path]
        first = next((i for i, n in enumerate(names) if n[0] in LANDMARKS), None)
        inner = names[first + 1 :] if first is not None else []
        bad = any(n[0] in ("nav", "aside", "footer", "form", "button") or _BAD & set(n[1:]) for n in inner)
        out.append(int(first is not None and not bad))
    return out


#: Elements that say what they hold, and of them those that hold main text.
TELLING = frozenset("article main nav header footer aside section".split())


def muted(page: list[Block], drop_hints: bool, tags: frozenset[str] = TELLING) -> list[Block]:
    """The same page with ``tags`` as plain div and, if asked, without hints."""

    def plain(name: str) -> str:
        tag, *words = name.split()
        return " ".join(["div" if tag in tags else tag, *([] if drop_hints else words)])

    return [b._replace(path=tuple(map(plain, b.path))) for b in page]


def build_page(rng: random.Random, sentences: list[str]) -> str:
    """A page in a random layout; main text is marked."""

    def some(least: int, most: int) -> str:
        return html_lib.escape(" ".join(rng.choice(sentences) for _ in range(rng.randint(least, most))))

    def word() -> str:
        return html_lib.escape(rng.choice(rng.choice(sentences).split() or ["x"]))

    def wrap(kinds: list[str], inner: str) -> str:
        kind = rng.choice(kinds)
        return f"<{kind}>{inner}</{kind.split()[0]}>"

    items = lambda n: "".join(f'<li><a href="/{i}">{word()}</a></li>' for i in range(n))
    menu = wrap(["nav", 'div class="menu"', 'div id="nav"', 'ul class="nav"', 'div role="navigation"'], f"<ul>{items(rng.randint(3, 8))}</ul>")
    head = wrap(["header", 'div class="header"', 'div id="masthead"'], f"<p>{word()} {word()}</p>" + (menu if rng.random() < 0.5 else ""))
    advert = wrap(['div class="ad"', 'div class="advert"', 'aside class="promo"', 'div id="banner"', 'div class="sponsor"'], some(1, 3))
    notice = wrap(['div class="cookie-notice"', 'div id="consent"', 'div class="notice"', 'section class="alert"'], f"<p>{some(1, 2)}</p><button>{word()}</button>")
    side = wrap(["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"'], f"<h3>{word()}</h3><ul>{items(4)}</ul><p>{some(1, 2)}</p>")
    form = f"<form><label>{word()}</label><input name=x><p>{some(1, 1)}</p><button>{word()}</button></form>"
    talk = wrap(['section class="comments"', 'div id="comments"', 'div class="discussion"'], "".join(f'<div class="comment"><p>{some(1, 4)}</p></div>' for _ in range(rng.randint(1, 5))))
    foot = wrap(["footer", 'div class="footer"', 'div id="footer"', 'div role="contentinfo"'], f"&copy; {word()} &middot; {some(1, 2)}")
    title = f"<h1>{_MARK}{some(1, 1)[:60]}</h1>"
    body = [title] if rng.random() < 0.9 else []
    for _ in range(rng.randint(1, 9)):
        pick = rng.random()
        text = _MARK + some(1, 5)
        body.append(f"<p>{text}</p>" if pick < 0.7 else f"<h2>{_MARK}{some(1, 1)[:40]}</h2>" if pick < 0.8 else f"<ul><li>{text}</li></ul>" if pick < 0.87 else f"<blockquote>{text}</blockquote>" if pick < 0.93 else f"<div>{text}</div>")
        if rng.random() < 0.08:
            body.append(advert)
    if rng.random() < 0.3:
        body.append(rng.choice([talk, form, side]))
    core = wrap(["article", "article", "main", 'div class="post-content"', 'div class="entry"', 'div class="article-body"', 'section class="story"', 'div id="content"', "div", "div"], "".join(body))
    before = [x for x in (notice, head, menu, advert) if rng.random() < 0.6]
    after = [x for x in (side, talk, form, advert, notice) if rng.random() < 0.4]
    rng.shuffle(before)
    rng.shuffle(after)
    return "<html><body>" + "".join(before) + core + "".join(after) + (foot if rng.random() < 0.9 else "") + "</body></html>"


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", max_pages: int = 200, built_pages: int = 500, max_size: int = 1_000_000) -> Field:
    """A field from at most ``max_pages`` pages of the table (of up to
    ``max_size`` characters) with a landmark and ``built_pages`` layouts built
    around their sentences. Of each, a copy is added from which hints, telling
    elements or both are taken, so that text and structure are learned too."""
    n = pages.count()
    scale = 1 << 30
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(scale))
    some = pages.where(F.col(html).isNotNull() & (F.length(html) <= max_size) & (spot < min(scale, int(2 * scale * max_pages / max(1, n)) + 1)))
    rows = [r[0] for r in some.orderBy(spot, key).select(html).limit(max_pages).collect()]
    return train(rows, built_pages)


def train(rows: list[str], built_pages: int = 500) -> Field:
    rng = random.Random(9)
    found = [b for b in map(blocks, rows) if b]
    known = [(b, y) for b in found if (y := by_landmark(b)) is not None]
    sentences = [s for p in found for b in p for s in re.split(r"(?<=[.!?]) ", b.text) if s][:20_000] or ["Some words stand here."]
    for _ in range(built_pages):
        page = [b for b in blocks(build_page(rng, sentences)) if b.text != _MARK]
        if page:
            known.append(([b._replace(text=b.text.replace(_MARK, "")) for b in page], [int(_MARK in b.text) for b in page]))
    sample = []
    for page, labels in known:
        copy = muted(page, *rng.choice([(True, TELLING), (True, TELLING), (False, LANDMARKS), (True, LANDMARKS), (False, TELLING)]))
        sample += [(features(page), labels), (features(copy), labels)]
    return Field().fit(sample)


def extract(pages: DataFrame, field: Field, key: str = "page_id", html: str = "html") -> DataFrame:
    """``pages`` without its html, with text (main text) and n_chars."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    pages, schema, back = exact(pages.select(*[f"`{c}`" for c in (*keep, html)]), keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for page in batch[html]:
                own = blocks(page)
                labels = field.decode(features(own))
                texts.append("\n".join(b.text for b, y in zip(own, labels) if y))
            yield batch[keep].assign(text=texts, n_chars=[len(t) for t in texts])

    return back(pages.mapInPandas(run, schema + ", text string, n_chars long"))


def op3_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
