"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into blocks at block-level tags. Each block has features of its ancestors (tags, words of class and id)
and of its text (length, links, punctuation). The field labels the sequence main text or not, is trained by gradient
ascent on labelled pages and decoded by Viterbi. The labelled pages are generated layouts, whose labels are known as
they are built (`labelled_pages`); a caller may pass own ones.

Defined cases: a null or empty page has an empty text, and so has one without main text; unclosed tags, comments and
scripts end where HTML ends them or with the page; elements that HTML doesn't show unless asked (`noscript`, `template`)
are cut into blocks like any other; pages of any length and depth are read whole, in time proportional to their length;
of labellings that are equally likely the one with less main text is taken; repeated rows are treated alike; an empty table gives an empty
result; columns of the input other than id, URL and HTML are not looked at.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_given

#: Fixed values of HTML: elements without content, elements whose content is no markup, and elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe")
#: Elements of other languages, which may close themselves.
FOREIGN = frozenset(("svg", "math"))
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that tell what part of a page they hold.
MARKS = frozenset("article main form nav header footer aside dialog".split())
#: What an opening tag closes: an open element of the same kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol menu dl table tbody thead tfoot div section article".split())

_ATTR = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|(?P<open><(?P<raw>" + "|".join((*RAW, "xmp")) + rf")(?=[\s/>])(?P<attr0>{_ATTR})>)(?P<inside>.*?)(?:</(?P=raw)\s*>|\Z)"
    rf"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>{_ATTR})>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attr2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S | re.I,
)
#: A slash that closes the element; at the end of a value without quotes it is part of the value.
_CLOSED = re.compile(r"""(?<![^\s"'])/\Z|\A/\Z|(?:\A|\s)[^\s=]+/\Z""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


#: Fixed words that layouts use for the classes and ids of what is not main text, by the element they may stand on.
ASIDE_NAMES = {
    "nav": ("nav", "menu", "navbar", "navigation", "breadcrumbs", "pagination", "toc"),
    "ad": ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "sponsor"),
    "notice": ("cookie", "notice", "consent", "popup", "modal", "alert", "gdpr", "disclaimer", "newsletter", "subscribe"),
    "side": ("sidebar", "aside", "widget", "related", "share", "social", "recommended", "trending", "tags", "rail"),
    "comments": ("comments", "comment", "reply", "discussion", "responses", "disqus", "respond", "commentlist", "user-comments", "kommentare", "commentaires", "comentarios"),
    "header": ("header", "masthead", "topbar", "branding", "site"),
    "footer": ("footer", "copyright", "legal", "colophon", "bottom"),
}
MAIN_NAMES = ("content", "post", "entry", "article", "main", "body", "story", "text")
#: Their parts, as `Block.around` has them.
_ASIDE = frozenset(f".{part}" for names in ASIDE_NAMES.values() for name in names for part in _PARTS.findall(name))


@dataclass
class Block:
    """Text of a leaf block, the characters of it in links, the nearest block tag, and what surrounds it.

    `marks` names the two innermost of the elements in `MARKS`; `story` tells whether the block is in an article or main
    element ("in"), only others of its page are ("out"), or none is ("none").
    """

    text: str
    linked: int
    tag: str
    around: frozenset[str]
    marks: str = ""
    story: str = "none"


def blocks(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order; those without text are left out.

    What surrounds a block is restricted to `known` names, if given, so that deep pages take no more time than long ones.
    """
    found: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    depth: Counter[str] = Counter()
    around: Counter[str] = Counter()
    block_tags: list[str] = []
    marks: list[str] = []
    text: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        clean = " ".join(html.unescape("".join(text)).split())
        if clean:
            found.append(Block(clean, len(" ".join(html.unescape("".join(linked)).split())), block_tags[-1] if block_tags else "", frozenset(around), ">".join(marks[-2:]), "in" if depth["article"] or depth["main"] else "out"))
        text.clear()
        linked.clear()

    def say(chunk: str) -> None:
        text.append(chunk)
        if depth["a"]:
            linked.append(chunk)

    def push(tag: str, names: list[str]) -> None:
        here = [x for x in (f"<{tag}>", *names) if known is None or x in known] if tag in BLOCK or names else []
        stack.append((tag, here))
        depth[tag] += 1
        around.update(here)
        if tag in BLOCK:
            block_tags.append(tag)
        if tag in MARKS:
            marks.append(tag)

    def close(tags, stop=frozenset()) -> None:
        if not any(depth[t] for t in tags):
            return
        i = len(stack) - 1
        while stack[i][0] not in tags:
            if stack[i][0] in stop:
                return
            i -= 1
        if any(t in BLOCK for t, _ in stack[i:]):
            flush()
        for tag, here in stack[i:]:
            depth[tag] -= 1
            for x in here:
                around[x] -= 1
                if not around[x]:
                    del around[x]
            if tag in BLOCK:
                block_tags.pop()
            if tag in MARKS:
                marks.pop()
        del stack[i:]

    at, page = 0, page or ""
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            if any(depth[t] for t in FOREIGN) and _CLOSED.search(m["attr0"]):
                at = m.end("open")
            elif m["raw"].lower() == "xmp":
                flush()
                close(("p",))
                say(html.escape(m["inside"]))
                flush()
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            close((tag,))
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK:
            if not depth["foreignobject"]:
                close(FOREIGN)
            flush()
            close(("p",))
        if tag in CLOSES:
            close(CLOSES[tag], LISTS)
        attr = m["attr"] or m["attr2"] or ""
        if tag not in VOID and not (_CLOSED.search(attr) and (tag in FOREIGN or any(depth[t] for t in FOREIGN))):
            push(tag, [f".{w}" for n in _NAMES.findall(attr) for w in _PARTS.findall("".join(n).lower())])
    if at < len(page):
        say(page[at:])
    flush()
    if not any(b.story == "in" for b in found):
        for b in found:
            b.story = "none"
    return found


def block_features(block: Block, i: int, n: int) -> list[str]:
    size, words = len(block.text), block.text.count(" ") + 1
    share = block.linked / size
    return [
        "bias",
        f"tag={block.tag}",
        *sorted(block.around),
        f"marks={block.marks}",
        f"mark={block.marks.rpartition('>')[2]}",
        f"story={block.story}",
        f"story={block.story} words={min(4, words.bit_length())}",
        f"words={min(7, words.bit_length())}",
        f"long={words > 25} {words > 60} {words > 150}",
        f"links={0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"ends={block.text[-1] in '.!?…:\"”»'}",
        f"commas={min(3, block.text.count(','))}",
        f"sign={any(c in block.text for c in '©®™|»')}",
        f"first={i == 0}",
        f"last={i == n - 1}",
        f"tag={block.tag} story={block.story} aside={not _ASIDE.isdisjoint(block.around)}",
    ]


@dataclass
class Field:
    """Weights of features, and of a label after a label (False, True)."""

    weights: dict[str, float]
    move: list[list[float]]

    def decode(self, found: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks, by Viterbi."""
        if not found:
            return []
        n, (to_no, to_yes) = len(found), self.move
        best, back = (0.0, 0.0), []
        for i, block in enumerate(found):
            unit = sum(self.weights.get(f, 0.0) for f in block_features(block, i, n))
            if i:
                no = max((best[0] + to_no[0], 0), (best[1] + to_yes[0], 1))
                yes = max((best[0] + to_no[1], 0), (best[1] + to_yes[1], 1))
                back.append((no[1], yes[1]))
                best = (no[0], yes[0] + unit)
            else:
                best = (0.0, unit)
        label = int(best[1] > best[0])
        labels = [label]
        for came in reversed(back):
            label = came[label]
            labels.append(label)
        return [bool(x) for x in reversed(labels)]

    def extract(self, page: str | None) -> str:
        found = blocks(page, self.weights)
        return "\n\n".join(b.text for b, keep in zip(found, self.decode(found), strict=True) if keep)


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> Field:
    """Maximum likelihood with a ridge, by full-batch gradient ascent; forward-backward runs over all pages at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    lengths = np.array([len(b) for b, _ in pages])
    wide = int(lengths.max())
    flat, owner = [], []
    gold = np.zeros((len(pages), wide), bool)
    for p, (found, labels) in enumerate(pages):
        for i, block in enumerate(found):
            own = [names.setdefault(f, len(names)) for f in block_features(block, i, len(found))]
            flat += own
            owner += [p * wide + i] * len(own)
            gold[p, i] = labels[i]
    flat, owner = np.array(flat), np.array(owner)
    real = np.arange(wide) < lengths[:, None]
    pairs = real[:, 1:]
    wanted = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pairs).sum() for b in (False, True)] for a in (False, True)], float)
    w, move = np.zeros(len(names)), np.zeros((2, 2))
    m, v = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    total = real.sum()
    for t in range(1, rounds + 1):
        unit = np.zeros((len(pages), wide, 2))
        unit[:, :, 1] = np.bincount(owner, w[flat], len(pages) * wide).reshape(len(pages), wide)
        ahead, behind = np.zeros_like(unit), np.zeros_like(unit)
        ahead[:, 0] = unit[:, 0]
        for i in range(1, wide):
            ahead[:, i] = unit[:, i] + np.logaddexp(ahead[:, i - 1, :1] + move[0], ahead[:, i - 1, 1:] + move[1])
        for i in range(wide - 2, -1, -1):
            nxt = unit[:, i + 1] + behind[:, i + 1]
            came = np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:])
            behind[:, i] = np.where(pairs[:, i, None], came, 0.0)
        both = ahead + behind
        whole = np.logaddexp(both[:, :, 0], both[:, :, 1])
        yes = np.exp(both[:, :, 1] - whole) * real
        joint = ahead[:, :-1, :, None] + move + (unit[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, 1:, None, None]
        moved = (np.exp(np.minimum(joint, 0)) * pairs[:, :, None, None]).sum(axis=(0, 1))
        grad = np.concatenate((np.bincount(flat, (gold - yes).reshape(-1)[owner], len(names)) / total - ridge * w, ((wanted - moved) / total - ridge * move).ravel()))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, move = w + step[:-4], move + step[-4:].reshape(2, 2)
    return Field({k: float(w[i]) for k, i in names.items()}, move.tolist())


def labelled_pages(n: int = 1000, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Generated pages and the label of each of their blocks, in many layouts."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 4, high: int = 18) -> str:
        s = words(low, high)
        if rng.random() < 0.15:
            s += rng.choice((" %%%", " ***", "!!", " &amp;&amp;", " | " + words(1, 3), " &#36;"))
        return s.capitalize() + rng.choice((".", ".", ".", ".", "!", "?", ""))

    def opaque() -> str:
        """A class name that means nothing."""
        return f"{rng.choice('jqxz')}{rng.randint(1, 9)}{rng.choice('jqxz')}"

    def prose() -> str:
        return " ".join(sentence(1, 20) for _ in range(rng.choice((1, 1, 1, 2, 3, 6, 20))))

    class Page:
        def __init__(self) -> None:
            self.out, self.labels = [], []

        def leaf(self, tag: str, body: str, label: bool, attr: str = "") -> None:
            self.out.append(f"<{tag}{attr}>{body}" + ("" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag}>"))
            self.labels.append(label)

        def links(self, k: int) -> None:
            self.out.append("<ul>")
            for _ in range(k):
                self.leaf("li", f'<a href="/{words(1, 1)}">{words(1, 3)}</a>', False)
            self.out.append("</ul>")

        def plain_aside(self) -> None:
            """Links, a short line or a copyright in an element whose name tells nothing."""
            self.out.append(f'<div class="{opaque()}">')
            kind = rng.random()
            if kind < 0.6:
                self.links(rng.randint(2, 8))
            elif kind < 0.8:
                self.bare(rng.choice(("&copy; ", "© 2020 ")) + words(1, 4))
            else:
                self.leaf("div", f'<a href="/">{words(1, 3)}</a>', False, f' class="{opaque()}"')
            self.out.append("</div>")

        def plain_story(self) -> None:
            """Main text in elements whose names tell nothing."""
            self.out.append(f'<div class="{opaque()}"><div class="{opaque()}">')
            self.leaf("h1", sentence(2, 12), True)
            for _ in range(rng.choice((1, 2, 4, 8))):
                kind = rng.random()
                if kind < 0.75:
                    self.leaf("p", prose(), True, rng.choice(("", f' class="{opaque()}"')))
                elif kind < 0.85:
                    self.leaf("h2", words(1, 6).capitalize(), True)
                elif kind < 0.93:
                    self.out.append(f'<table class="{opaque()}">')
                    for _ in range(rng.randint(1, 3)):
                        self.out.append("<tr>")
                        for _ in range(rng.randint(1, 4)):
                            self.leaf("td", words(1, 4), True)
                        self.out.append("</tr>")
                    self.out.append("</table>")
                else:
                    self.leaf("div", prose(), True, f' class="{opaque()}"')
            self.out.append("</div></div>")

        def aside(self, kind: str) -> None:
            native = {"nav": "nav", "side": "aside", "header": "header", "footer": "footer", "comments": "section"}.get(kind, "div")
            tag = native if rng.random() < 0.6 else rng.choice(("div", "section"))
            name = rng.choice(ASIDE_NAMES[kind]) + rng.choice(("", "", f"-{words(1, 1)}"))
            bare = tag in ("nav", "aside", "header", "footer") and rng.random() < 0.5
            self.out.append(f"<{tag}" + ("" if bare else f' {rng.choice(("class", "id"))}="{name}"') + ">")
            if kind == "nav":
                self.links(rng.randint(2, 8))
            elif kind == "footer":
                self.bare(rng.choice(("&copy; ", "", "© 2020 ")) + sentence(2, 12))
            elif kind == "header":
                self.leaf(rng.choice(("h1", "div", "p")), words(1, 5).title(), False)
                if rng.random() < 0.4:
                    self.leaf(rng.choice(("p", "div", "h2")), sentence(1, 10), False)
                if rng.random() < 0.5:
                    self.links(rng.randint(2, 5))
            elif kind == "side":
                if rng.random() < 0.6:
                    self.leaf(rng.choice(("h2", "h3", "h4")), words(1, 4).title(), False)
                self.links(rng.randint(2, 6)) if rng.random() < 0.6 else self.leaf("p", prose(), False)
            elif kind == "comments":
                for _ in range(rng.randint(1, 4)):
                    self.leaf(rng.choice(("p", "div", "li")), prose(), False, rng.choice(("", ' class="comment"')))
            elif rng.random() < 0.5:
                self.bare(prose())
            else:
                self.leaf("p", prose(), False)
            self.out.append(f"</{tag}>")

        def bare(self, body: str) -> None:
            self.out.append(body)
            self.labels.append(False)

        def form(self) -> None:
            """A search, newsletter or answer form, with its explanations."""
            self.out.append(rng.choice(('<form action="/s">', "<form>", '<form method="post"><div>', "<form><fieldset>")))
            for _ in range(rng.choice((0, 1, 1, 2))):
                self.leaf(rng.choice(("p", "p", "h3", "div")), rng.choice((words(1, 6).capitalize(), sentence(2, 12), prose())), False)
            for _ in range(rng.choice((1, 1, 2))):
                self.out.append("<div>")
                self.bare(f"<label>{words(1, 4)}</label><input name=q>")
                self.out.append("</div>")
            if rng.random() < 0.25:
                self.select()
            if rng.random() < 0.6:
                self.leaf("button", words(1, 2).capitalize(), False)
            self.out.append("</form>")

        def select(self) -> None:
            self.out.append("<select>")
            for _ in range(rng.randint(1, 4)):
                self.leaf("option", words(1, 2), False)
            self.out.append("</select>")

        def within(self) -> None:
            """What interrupts a story."""
            kind = rng.choice(("ad", "side", "notice", "comments", "nav", "form", "form", "button", "select"))
            if kind == "form":
                self.form()
            elif kind == "select":
                self.select()
            elif kind == "button":
                self.leaf("button", words(1, 3).capitalize(), False)
            else:
                self.aside(kind)

        def single(self) -> None:
            """The whole story as one block, in an element of its own or not, its lines divided or not."""
            body = rng.choice(("<br>", "<br><br>", " ")).join(prose() for _ in range(rng.choice((1, 1, 2, 4))))
            if rng.random() < 0.5:
                self.leaf(rng.choice(("p", "p", "div", "div")), body, True, rng.choice(("", "", f' class="{opaque()}"')))
            else:
                self.out.append(body)
                self.labels.append(True)

        def story(self) -> None:
            tag = rng.choice(("article", "article", "main", "div", "section"))
            attr = f' {rng.choice(("class", "id"))}="{rng.choice(MAIN_NAMES)}"' if tag in ("div", "section") or rng.random() < 0.2 else ""
            self.out.append(f"<{tag}{attr}>")
            if rng.random() < 0.2:
                if rng.random() < 0.3:
                    self.leaf("h1", sentence(1, 12), True)
                self.single()
                if rng.random() < 0.4:
                    self.within()
                self.out.append(f"</{tag}>")
                return
            if rng.random() < 0.75:
                titled = rng.random() < 0.15
                self.out.append("<header>" if titled else "")
                self.leaf(rng.choice(("h1", "h1", "h1", "h2")), rng.choice((sentence(1, 12), words(1, 5).capitalize())), True)
                self.out.append("</header>" if titled else "")
                if rng.random() < 0.15:
                    self.within()
            for k in range(rng.choice((1, 2, 2, 3, 4, 8, 12))):
                kind = rng.random()
                if kind < 0.68 or not k:
                    self.leaf("p", rng.choice(("", "", "<b>", "<em>")) + prose() + rng.choice(("", "", "<br>", f' <a href="#">{words(1, 3)}</a> {words(1, 3)}.')), True)
                elif kind < 0.74:
                    self.leaf(rng.choice(("h2", "h3")), words(1, 6).capitalize(), True)
                elif kind < 0.80:
                    self.out.append("<ul>")
                    for _ in range(rng.randint(1, 4)):
                        self.leaf("li", sentence(2, 12), True)
                    self.out.append("</ul>")
                elif kind < 0.83:
                    self.leaf("blockquote", prose(), True)
                elif kind < 0.85:
                    self.leaf("pre", words(3, 20), True)
                elif kind < 0.87:
                    self.out.append("<figure><img src=x>")
                    self.leaf("figcaption", sentence(2, 10), True)
                    self.out.append("</figure>")
                elif kind < 0.89:
                    self.out.append("<table><tr>")
                    for _ in range(3):
                        self.leaf("td", words(1, 4), True)
                    self.out.append("</tr></table>")
                else:
                    self.within()
            if rng.random() < 0.35:
                self.aside(rng.choice(("comments", "comments", "side", "footer")))
            self.out.append(f"</{tag}>")

    def page() -> tuple[str, list[bool]]:
        p = Page()
        p.out.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>")
        if rng.random() < 0.1:
            if rng.random() < 0.3:
                p.aside(rng.choice(("nav", "header")))
            if rng.random() < 0.3:
                p.leaf("h1", sentence(1, 12), True)
            for _ in range(rng.choice((1, 1, 2, 4))):
                p.leaf("p", prose(), True)
            if rng.random() < 0.2:
                p.form()
            if rng.random() < 0.3:
                p.aside("footer")
            p.out.append("</body></html>")
            return "".join(p.out), p.labels
        if rng.random() < 0.2:
            for _ in range(rng.randint(0, 3)):
                p.plain_aside()
            p.plain_story()
            for _ in range(rng.randint(0, 3)):
                p.plain_aside()
            p.out.append("</body></html>")
            return "".join(p.out), p.labels
        whole = rng.random() < 0.04
        p.out.append('<form id="page">' if whole else "")
        for kind, chance in (("notice", 0.2), ("header", 0.4), ("nav", 0.6), ("ad", 0.4)):
            if rng.random() < chance:
                p.aside(kind)
        if not whole and rng.random() < 0.2:
            p.form()
        if rng.random() < 0.15:
            p.aside("side")
        if rng.random() < 0.97:
            p.story()
        if rng.random() < 0.2:
            p.out.append('<script>var t="</p>";</script>')
        for kind, chance in (("comments", 0.35), ("side", 0.3), ("ad", 0.2)):
            if rng.random() < chance:
                p.aside(kind)
        if not whole and rng.random() < 0.15:
            p.form()
        if rng.random() < 0.75:
            p.aside("footer")
        p.out.append("</form></body></html>" if whole else "</body></html>")
        return "".join(p.out), p.labels

    return [page() for _ in range(n)]


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on the generated pages."""
    made = [(blocks(page), labels) for page, labels in labelled_pages()]
    return train([(b, y) for b, y in made if len(b) == len(y)])


def extract(pages: DataFrame, field: Field | None = None, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """`page_id`, `url`, `text` (main text, blocks joined by blank lines) and `n_chars` of every row."""
    used = field or default_field()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [used.extract(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(x) for x in text]})

    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    made = read.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return as_given(made, "page_id", read)
