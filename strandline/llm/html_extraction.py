"""Main text of web pages by a linear-chain CRF over DOM leaf blocks.

A page is cut into leaf blocks: the text between two borders of block-level
elements. Features are the ancestors' tags, their class and id words, and
properties of the text; Viterbi decoding labels the blocks of a page together.

No table here holds labelled pages, so the CRF learns from pages that
:func:`labelled_pages` writes: a bounded, seeded number of layouts with main
text and every kind of furniture. Nothing is learned from the table it reads.

Reading rules: comments, scripts, styles, templates and the head have no
blocks; an end tag closes up to its element, or nothing if none is open; a
block-level start tag closes an open paragraph; character references are
decoded once, in text only; ``br`` counts as white space; white space is what
``str.split`` cuts at.

Where the labels of a page leave no main text, as on pages of a few short
paragraphs, all blocks are taken that no name speaks against: none of their
ancestors' tags and names weighs FURNITURE_WEIGHT or less, and they are neither
mostly links nor a copyright line.

Defined cases: null or empty html: text '' and n_chars 0; no block, or nothing
but furniture: the same; repeated rows each get a result row.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import text_pass
from strandline.llm.crf import Crf

TRAINING_PAGES = 700
#: Learned weight (for main text, less against it) from which on a tag or a name tells furniture.
FURNITURE_WEIGHT = -1.0
#: Tags that border blocks.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that have no end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: what is drawn, run, embedded or filled in.
SKIPPED = frozenset("head title template svg iframe select datalist".split())
#: Elements whose content is read up to their own end tag only, and is no text of the page.
RAW = frozenset(("script", "style", "textarea"))
#: A start tag of the key closes an open element of the values first.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What ends the search for an element to close.
SCOPE = ("table", "td", "th", "caption", "button", "object")
LISTS = ("ul", "ol", "dl", "table", "select")

QUOTES = re.compile(r"[>\"']")
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
NAMES = re.compile(r"""\b(class|id|role|style|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@lru_cache(maxsize=20_000)
def name_features(attrs: str) -> tuple[str, ...]:
    """Words of class, id, role and label; hidden styles."""
    out = []
    for kind, value in NAMES.findall(attrs):
        kind, value = kind.lower(), value.strip("\"'")
        if kind == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append("c:hidden")
            continue
        out += [f"c:{w.lower()}" for w in PART.findall(value) if len(w) > 1]
    if re.search(r"\bhidden\b|aria-hidden\s*=\s*.true", attrs, re.I):
        out.append("c:hidden")
    return tuple(out)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content): 'text', 'start' with its attributes, or 'end'. Every character is passed a bounded number of times.

    A ``>`` in quotes does not end a tag. Once a quote is met that never ends,
    quotes no longer count, so that broken markup is not read again and again.
    """
    at, length, quoted = 0, len(page), True
    while at < length:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = length if end < 0 else end + 3
            continue
        name = NAME.match(page, lt + 1)
        mark = name is None and page[lt + 1 : lt + 2] in ("!", "?")
        end = page.find(">", lt + 1) if name or mark else -1
        if end < 0:
            if name or mark:
                # No tag ends after this.
                yield "text", "", page[lt:]
                return
            yield "text", "", "<"
            at = lt + 1
            continue
        if mark:
            at = end + 1
            continue
        if quoted:
            place = name.end()
            while (m := QUOTES.search(page, place)) is not None and m[0] != ">":
                place = page.find(m[0], m.end()) + 1
                if not place:
                    m = None
                    break
            if m is None:
                quoted = False
            else:
                end = m.start()
        kind, tag = ("end", name[0][1:].lower()) if name[0][0] == "/" else ("start", name[0].lower())
        at = end + 1
        if kind == "start" and tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = -1 if close is None else page.find(">", close.end())
            at = length if stop < 0 else stop + 1
            continue
        yield kind, tag, page[min(name.end(), end) : end]


class Stack:
    """Open elements. Where the last one of a tag is, and which features hold, is known without a walk."""

    def __init__(self, known):
        self.known = known
        self.tags: list[str] = []
        self.features: list[list[str]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[str] = []
        self.active: dict[str, int] = {}
        self.linked = self.skipped = 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        own = [f for f in (f"t:{tag}", *names) if self.known is None or f in self.known]
        self.features.append(own)
        for f in own:
            self.active[f] = self.active.get(f, 0) + 1
        if tag in BLOCK:
            self.blocks.append(tag)
        self.linked += tag == "a"
        self.skipped += tag in SKIPPED

    def close(self, at: int) -> None:
        while len(self.tags) > at:
            tag = self.tags.pop()
            self.places[tag].pop()
            for f in self.features.pop():
                if self.active[f] == 1:
                    del self.active[f]
                else:
                    self.active[f] -= 1
            if tag in BLOCK:
                self.blocks.pop()
            self.linked -= tag == "a"
            self.skipped -= tag in SKIPPED

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close_open(self, tags: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        """Close the last open element of the tags, unless one of scope was opened after it."""
        at = self.last(tags)
        if at >= 0 and at >= self.last(scope):
            self.close(at)


def leaf_blocks(page: str, known=None) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, ancestor features, characters inside links) of each leaf block in page order. known: the features that matter (None: all)."""
    stack = Stack(known)
    out: list[tuple[str, tuple[str, ...], int]] = []
    parts: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, (*stack.active, f"o:{stack.blocks[-1] if stack.blocks else 'none'}"), links))
            parts.clear()
        links = 0

    for kind, name, content in tokens(page):
        if kind == "text":
            if not stack.skipped:
                text = html.unescape(content) if "&" in content else content
                parts.append(text)
                if stack.linked:
                    links += len(text.strip())
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if kind == "end":
            stack.close_open((name,))
            continue
        if name in BLOCK:
            stack.close_open(("p",), SCOPE)
        if name == "body":
            # A head left open ends here.
            stack.close_open(("head",))
        if name in CLOSES:
            stack.close_open(CLOSES[name], LISTS)
        if name not in VOID and not content.endswith("/"):
            stack.push(name, name_features(content) if content else ())
    flush()
    return out


LINK_SHARES = (0.01, 0.3, 0.7)


def bucket(n: float, bounds: tuple[float, ...]) -> int:
    return sum(n >= b for b in bounds)


def block_features(block: tuple[str, tuple[str, ...], int], at: int, count: int) -> list[str]:
    text, names, links = block
    words = text.count(" ") + 1
    out = [
        "bias",
        *names,
        f"w:{bucket(words, (2, 4, 8, 15, 30, 80))}",
        f"l:{bucket(links / max(len(text), 1), LINK_SHARES)}",
        f"e:{text[-1] in '.!?…»”\"'}",
        f"s:{bucket(sum(map(text.count, ',;:')), (1, 3))}",
        f"at:{bucket(at / max(count - 1, 1), (0.1, 0.5, 0.9))}",
    ]
    if "©" in text or "(c)" in text:
        out.append("copyright")
    if "|" in text or "»" in text or "·" in text:
        out.append("bars")
    return out


class Extractor:
    """A trained CRF and its feature numbers."""

    def __init__(self, numbers: dict[str, int], crf: Crf):
        self.numbers, self.crf = numbers, crf
        weight = crf.emit[:, 1] - crf.emit[:, 0]
        self.furniture = {f for f, k in numbers.items() if f.startswith(("t:", "c:")) and weight[k] <= FURNITURE_WEIGHT} | {"c:hidden", "copyright", f"l:{len(LINK_SHARES)}"}
        self.known = self.furniture | numbers.keys()

    def unspoken(self, blocks: list[tuple[str, tuple[str, ...], int]]) -> list[str]:
        """Texts of the blocks that no name speaks against."""
        return [b[0] for at, b in enumerate(blocks) if self.furniture.isdisjoint(block_features(b, at, len(blocks)))]

    def extract(self, pages: list[str | None]) -> list[str]:
        blocks = [leaf_blocks(p, self.known) if p else [] for p in pages]
        lengths = np.array([len(b) for b in blocks], np.int64)
        ids, starts = [], [0]
        number = self.numbers.get
        for page in blocks:
            for at, block in enumerate(page):
                ids += [k for f in block_features(block, at, len(page)) if (k := number(f)) is not None]
                starts.append(len(ids))
        emissions = self.crf.scores(np.array(ids, np.int64), np.array(starts))
        row0 = np.cumsum(lengths) - lengths
        out = [""] * len(pages)
        order = [i for i in np.argsort(lengths, kind="stable").tolist() if lengths[i]]
        for k in range(0, len(order), 64):
            group = order[k : k + 64]
            rows = np.concatenate([np.arange(row0[i], row0[i] + lengths[i]) for i in group])
            labels = self.crf.viterbi(emissions[rows], lengths[group])
            at = 0
            for i in group:
                own = labels[at : at + lengths[i]]
                at += lengths[i]
                main = [b[0] for b, y in zip(blocks[i], own.tolist(), strict=True) if y]
                out[i] = "\n".join(main or self.unspoken(blocks[i]))
        return out


SYLLABLES = "an ber co de el fa gu hi in jo ka lo mi nu or pa que ri sta tion un ver wi xo yt zu é ñ ö в о с 中".split()
MAIN = ["article", "main", 'div class="content"', 'div id="main-content"', 'div class="post"', 'div class="entry-content"', 'section class="article-body"', 'div role="main"', 'div class="story-body"', 'div class="text"', "div", 'td class="body"']
FURNITURE = {
    "nav": ["nav", 'div class="nav"', 'ul class="menu"', 'div id="navbar"', 'div class="breadcrumbs"', 'div class="topnav"', 'div role="navigation"', 'div class="pagination"', 'div class="toc-menu"', "menu"],
    "header": ["header", 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'div class="logo"', 'div class="banner"', 'div role="banner"'],
    "footer": ["footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"', 'div class="site-info"', 'div role="contentinfo"'],
    "aside": ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'div class="widget"', 'div class="recommended"', 'div class="most-read"', 'div class="tags"', 'div class="author-box"', 'div role="complementary"'],
    "notice": ['div class="cookie"', 'div class="cookie-notice"', 'div id="cookie-banner"', 'div class="consent"', 'div class="notice"', 'div class="alert"', 'div class="popup"', 'div class="modal"', "dialog", 'div class="gdpr"', 'div class="paywall"'],
    "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div id="ad-slot"', 'div class="banner-ad"', 'aside class="ad"', 'div class="sponsor"'],
    "form": ["form", 'form class="search"', 'form class="newsletter"', 'div class="subscribe"', 'form class="login"', 'div class="search-box"', 'div class="signup"'],
    "comments": ['section class="comments"', 'div id="comments"', 'div class="comment"', 'div class="comment-list"', 'ol class="commentlist"', 'div class="discussion"', 'div class="replies"', 'div class="responses"', 'div id="disqus_thread"', 'div class="reader-comments"'],
    "share": ['div class="share"', 'div class="social"', 'ul class="share-buttons"'],
}


def labelled_pages(count: int, seed: int = 3) -> list[tuple[str, list[str]]]:
    """(page, texts of its main blocks): invented layouts and words. Main blocks are marked by a word that no other block has."""
    rng = random.Random(seed)
    out = []

    def words(n: int) -> str:
        return " ".join("".join(rng.choices(SYLLABLES, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(n))

    def sentence(low: int, high: int) -> str:
        text = words(rng.randint(low, high)).capitalize()
        return (text.replace(" ", ", ", 1) if rng.random() < 0.4 else text) + rng.choice((".", ".", ".", "?", "!", ""))

    def wrap(tag: str, inner: str) -> str:
        end = tag.split()[0]
        return f"<{tag}>{inner}" + ("" if rng.random() < 0.05 and end == "p" else f"</{end}>")

    def link(text: str) -> str:
        return f'<a href="/{rng.randint(1, 99)}">{text}</a>'

    def furniture(kind: str) -> str:
        tag = rng.choice(FURNITURE[kind])
        if kind in ("nav", "share"):
            inner = "".join(wrap("li", link(words(rng.randint(1, 2)))) for _ in range(rng.randint(2, 8)))
            inner = inner if tag.startswith(("ul", "menu")) else wrap("ul", inner)
        elif kind == "header":
            inner = wrap(rng.choice(("h1", "h2", "div", "p", "span")), words(rng.randint(1, 4))) + (furniture("nav") if rng.random() < 0.4 else "")
        elif kind == "footer":
            inner = rng.choice(("", "&copy; ", "© 2020 ")) + words(rng.randint(2, 5)) + rng.choice((" &middot; ", " | ", " ")) + sentence(2, 14) + (wrap("ul", wrap("li", link(words(2)))) if rng.random() < 0.3 else "")
        elif kind == "form":
            inner = wrap("label", words(2)) + '<input type="text">' + wrap("button", words(1)) + (wrap("p", sentence(3, 12)) if rng.random() < 0.5 else "")
        elif kind == "comments":
            inner = (wrap("h3", words(2)) if rng.random() < 0.5 else "") + "".join(wrap(rng.choice(('div class="comment"', 'li class="comment"', "p", 'div class="comment-body"', "article")), rng.choice(("", wrap("span", words(1)))) + rng.choice(("", "<p>")) + " ".join(sentence(4, 25) for _ in range(rng.randint(1, 3)))) for _ in range(rng.randint(1, 4)))
        elif kind == "aside":
            inner = (wrap(rng.choice(("h2", "h3", "h4")), words(2)) if rng.random() < 0.6 else "") + "".join(wrap(rng.choice(("p", "li", "div")), link(sentence(2, 8)) if rng.random() < 0.5 else sentence(4, 25)) for _ in range(rng.randint(1, 4)))
        else:
            inner = rng.choice(("", "<p>")) + " ".join(sentence(3, 18) for _ in range(rng.randint(1, 2)))
        return wrap(tag, inner)

    for _ in range(count):
        mark, main = "zqmain", []

        def block(tag: str, low: int, high: int, many: int) -> str:
            text = " ".join(sentence(low, high) for _ in range(many)) + f" {mark}{len(main)}."
            if rng.random() < 0.08:
                text = re.sub(r"(?<=\w) (?=\w)", rng.choice((" | ", " · ", " » ")), text)
                text = re.sub(r"\W*(zqmain\d+)\.", r" \1.", text)
            main.append(text)
            return wrap(tag, rng.choice(("{}", "{}", "{}", "<b>{}<br>", "<span>{}</span>", "<em>{}</em>")).format(text))

        body = [block(rng.choice(("h1", "h1", "h2")), 3, 12, 1)] if rng.random() < 0.9 else []
        for _ in range(rng.choice((1, 2, 3, 5, 8, 14))):
            r = rng.random()
            if r < 0.64:
                body.append(block("p", 1, 40, rng.choice((1, 1, 2, 4, 8))))
            elif r < 0.72:
                body.append(block(rng.choice(("h2", "h3", "h4")), 2, 8, 1))
            elif r < 0.8:
                body.append(wrap(rng.choice(("ul", "ol")), "".join(block("li", 1, 14, 1) for _ in range(rng.randint(1, 4)))))
            elif r < 0.86:
                body.append(block(rng.choice(("blockquote", "pre", "div", "figcaption")), 3, 25, 1))
            elif r < 0.88:
                body.append(wrap("table", wrap("tr", "".join(block("td", 1, 6, 1) for _ in range(2)))))
            else:
                body.append(furniture(rng.choice(("ad", "ad", "share", "aside", "notice", "form"))))
        if rng.random() < 0.25:
            body.append(furniture(rng.choice(("comments", "share", "aside"))))
        container = rng.choice(MAIN[:2]) if rng.random() < 0.5 else rng.choice(MAIN)
        core = wrap(container, "".join(body))
        for _ in range(rng.choice((0, 0, 1, 2))):
            core = wrap(rng.choice(('div class="wrapper"', 'div id="page"', "div", 'div class="container"', "section")), core)
        before = [furniture(k) for k in ("notice", "header", "nav", "ad", "form", "aside") if rng.random() < 0.4]
        after = [furniture(k) for k in ("share", "comments", "aside", "ad", "form", "notice", "footer") if rng.random() < (0.8 if k == "footer" else 0.35)]
        rng.shuffle(before)
        end = rng.choice(("</body></html>", ""))
        page = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{''.join(before)}{core}<script>var x='<p>';</script>{''.join(after)}{end}"
        out.append((page, main))
    return out


def train(count: int = TRAINING_PAGES, seed: int = 3) -> Extractor:
    numbers: dict[str, int] = {}
    ids, starts, lengths, labels = [], [0], [], []
    for page, _ in labelled_pages(count, seed):
        blocks = leaf_blocks(page)
        lengths.append(len(blocks))
        for at, block in enumerate(blocks):
            gold = "zqmain" in block[0]
            text = re.sub(r" ?zqmain\d+\.", "", block[0]) or "x"
            ids += [numbers.setdefault(f, len(numbers)) for f in block_features((text, *block[1:]), at, len(blocks))]
            starts.append(len(ids))
            labels.append(int(gold))
    crf = Crf(len(numbers), 2)
    crf.fit(np.array(ids), np.array(starts), np.array(lengths), np.array(labels), rounds=40, rate=0.3, l2=1e-3, batch=64)
    return Extractor(numbers, crf)


def extract_pages(pages: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(extractor or train())

    def one(step):
        texts = shared.value.extract(step.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([step.column("page_id").cast(pa.int64()), step.column("url"), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return text_pass(pages.selectExpr("page_id", "url", "html AS text"), one, "page_id long, url string, text string, n_chars long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_html_extraction": op10}

ORACLE: dict[str, str] = {}
