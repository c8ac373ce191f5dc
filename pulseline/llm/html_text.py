"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A page is cut into leaf blocks, maximal runs of text between block-level tags, each with its open ancestors. Block
features are ancestor tags, words of their class, id and role, and shape of the text (length, link share, end mark,
place in the page). The field has two labels, main and rest; its weights are fitted by stochastic gradients of the penalised
log-likelihood over TRAIN_PAGES labelled pages, which labelled_pages() lays out in many styles with the label of each
part known. It's trained once a process on the driver (a few seconds) and goes to tasks as one small table.

Text of a page: labels by Viterbi, character references decoded, white space in a block (line breaks too) as
one space, blocks trimmed and joined by two line feeds in page order. Scripts, styles, templates, comments in
markup and the head never make blocks.

Edge cases: null and empty html, and html without text, give an empty string and n_chars 0. Markup may be broken:
unclosed tags end with their parent, an unclosed comment, script or tag takes the rest of the page, a lone < is text. Time is
linear in a page's length, however deep its elements and however broken its tags. Rows
are extracted one by one, so repeated rows give equal results; null ids and urls are carried along; extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

TRAIN_PAGES, EPOCHS, SEED = 500, 6, 5
TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
SPECIAL = re.compile("[>\"']")
#: Elements whose content is no text of the page.
DROPPED = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in "script style template noscript iframe svg canvas object title textarea".split()}
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-main|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
BLOCKS = frozenset("html head body article section main nav header footer aside div p ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption form fieldset legend button select option label details summary dialog address hr menu center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role that usually mark parts of a page.
REST_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead banner logo topbar footer foot copyright legal sidebar side aside widget rail ad ads advert adverts advertisement sponsor sponsored promo promotion cookie consent notice gdpr alert modal popup overlay newsletter subscribe signup login search form comment comments disqus respond reply replies discussion feedback share sharing social related recommended more trending popular tags tag pagination pager toolbar skip meta byline author rating contentinfo complementary".split())
MAIN_WORDS = frozenset("article content main post entry story body text articlebody maincontent postbody entrycontent page prose".split())
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Block:
    __slots__ = ("features", "label", "text")

    def __init__(self, text: str, features: list[str], label: int | None) -> None:
        self.text, self.features, self.label = text, features, label


def _attributes(raw: str) -> tuple[frozenset[str], int | None, bool]:
    """Words of class, id and role; the label of a training page; whether the element is hidden."""
    words: set[str] = set()
    label, hidden = None, False
    for name, a, b, c in ATTRIBUTE.findall(raw):
        value, name = a or b or c, name.lower()
        if name == "data-main":  # read in training alone
            label = 1 if value == "1" else 0
        elif name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value == "true"
        else:
            for token in value.split():
                words.add("".join(x for x in token.lower() if x.isalnum()))
                words.update(w.lower() for w in WORD.findall(token))
    return frozenset(words), label, hidden


@lru_cache(maxsize=20_000)
def _element(tag: str, raw: str) -> tuple[tuple[str, ...], int | None]:
    """The features that an ancestor gives the blocks below it."""
    words, label, hidden = _attributes(raw) if raw.strip() else (frozenset(), None, False)
    out = [f"in:{tag}"] if tag in BLOCKS else []
    rest, main = words & REST_WORDS, words & MAIN_WORDS
    if rest:
        out.append("rest-word")
    elif main:
        out.append("main-word")
    out += [f"word:{w}" for w in rest | main]
    if hidden:
        out.append("hidden")
    return tuple(out), label


def _shape(text: str, linked: int, words: int) -> list[str]:
    share = linked / max(len(text), 1)
    out = [f"words:{min(7, words.bit_length())}", f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}"]
    if text[-1] in ".!?…:;»\"”":
        out.append("ends")
    stops = sum(map(text.count, ".!?,;"))
    out.append(f"stops:{min(4, stops.bit_length())}")
    if "©" in text:
        out.append("copyright")
    if "|" in text or "·" in text or "»" in text:
        out.append("bars")
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, body) of a page: ("text", "", text), ("open", tag, attributes) or ("close", tag, "").

    Each tag ends at the first > outside quotes, or at the first > if a quote isn't closed; without any it takes the rest of the page.
    Where the scan from a place leads is kept, so no part of a page is scanned again for each tag before it.
    """
    find, n = page.find, len(page)
    known: dict[int, int] = {}
    unclosed = {'"': n + 1, "'": n + 1}  # no such quote from here on

    def end_of_tag(at: int) -> int:
        way = []
        while at not in known:
            way.append(at)
            m = SPECIAL.search(page, at)
            if m is None or m[0] == ">":
                known[at] = m.start() if m else -1
                break
            quote, inner = m[0], m.end()
            stop = find(quote, inner) if inner < unclosed[quote] else -1
            if stop < 0:
                unclosed[quote] = min(unclosed[quote], inner)
                known[at] = -1
                break
            at = stop + 1
        for step in way:
            known[step] = known[at]
        return known[at]

    at = 0
    while at < n:
        lt = find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", "", page[at:lt]
        if lt == n:
            return
        m = TAG.match(page, lt + 1)
        if m is None:
            if page.startswith("<!--", lt):
                stop = find("-->", lt + 4)
                at = stop + 3 if stop >= 0 else n
            elif page[lt + 1 : lt + 2] in ("!", "?", "/") and lt + 1 < n:
                stop = find(">", lt)
                at = stop + 1 if stop >= 0 else n
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        stop = end_of_tag(m.end())
        if stop < 0:
            stop = find(">", m.end())
        if stop < 0:
            return
        tag, body, at = m[2].lower(), page[m.end() : stop], stop + 1
        if m[1]:
            yield "close", tag, ""
        elif tag not in DROPPED:
            yield "open", tag, body
        elif not (tag == "svg" and body.endswith("/")):
            close = DROPPED[tag].search(page, at)
            at = close.end() if close else n


class Open:
    """The open elements of a place in a page, with running counts of what they give the blocks below them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...], int | None]] = []
        self.blocks: list[int] = []  # where block-level elements stand in the stack
        self.tags: Counter[str] = Counter()
        self.features: Counter[str] = Counter()

    def push(self, tag: str, features: tuple[str, ...], label: int | None) -> None:
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, features, self.label() if label is None else label))
        self.tags[tag] += 1
        self.features.update(features)

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            tag, features, _ = self.stack.pop()
            self.tags[tag] -= 1
            for f in features:
                self.features[f] -= 1
                if not self.features[f]:
                    del self.features[f]
        while self.blocks and self.blocks[-1] >= size:
            self.blocks.pop()

    def close(self, tag: str) -> None:
        """Ends the innermost element of this tag, if one is open, and all inside it."""
        if self.tags[tag]:
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.cut(k)

    def nearest(self) -> str:
        return self.stack[self.blocks[-1]][0] if self.blocks else "none"

    def label(self) -> int | None:
        return self.stack[-1][2] if self.stack else None


def leaf_blocks(page: str, labelled: bool = False) -> list[Block]:
    """The blocks of a page in order; their labels are read from its data-main marks only if it is `labelled`."""
    own = Open()
    blocks: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                features = [*own.features, f"at:{own.nearest()}", *_shape(text, linked, text.count(" ") + 1)]
                blocks.append(Block(text, features, own.label()))
            parts.clear()
        linked = 0

    for kind, tag, body in tokens(page):
        if kind == "text":
            parts.append(body)
            if own.tags["a"]:
                linked += len(body.strip())
        elif kind == "close":
            if tag in BLOCKS:
                flush()
            own.close(tag)
        elif tag == "br":
            parts.append(" ")
        else:
            if tag in BLOCKS:
                flush()
                # an open paragraph ends here, a list item at the next one
                if own.blocks and (own.nearest() == "p" or own.nearest() in CLOSES.get(tag, ())):
                    own.cut(own.blocks[-1])
            if tag not in VOID and not body.rstrip().endswith("/"):
                features, label = _element(tag, body)
                own.push(tag, features, label if labelled else None)
    flush()
    n = len(blocks)
    for i, b in enumerate(blocks):
        b.features.append(f"place:{0 if i == 0 else 4 if i == n - 1 else 1 + 3 * i // n}")
        b.features.append("bias")
    return [b for b in blocks if "in:head" not in b.features]


class Field:
    """Weights of a two-label chain: state weights by feature (label main against rest) and transitions."""

    def __init__(self) -> None:
        self.state: dict[str, float] = {}
        self.move = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, blocks: list[Block]) -> list[float]:
        get = self.state.get
        return [sum([get(f, 0.0) for f in b.features]) for b in blocks]

    def labels(self, blocks: list[Block]) -> list[int]:
        """The most probable sequence of labels."""
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.move
        back = []
        rest, main = 0.0, 0.0
        for i, s in enumerate(self.scores(blocks)):
            if i == 0:
                rest, main = 0.0, s
                continue
            from_rest, from_main = (rest + aa, main + ba), (rest + ab, main + bb)
            back.append((from_rest[1] > from_rest[0], from_main[1] > from_main[0]))
            rest, main = max(from_rest), max(from_main) + s
        label = int(main > rest)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[list[Block]], epochs: int = EPOCHS, rate: float = 0.3, penalty: float = 1e-4) -> Field:
        """Gradients page by page with a rate of each weight's own; marginals by forward and backward sums."""
        seen: dict[object, float] = {}
        rng = random.Random(SEED)
        log_add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))

        def step(key: object, grad: float, value: float) -> float:
            grad -= penalty * value
            seen[key] = seen.get(key, 1e-6) + grad * grad
            return value + rate * grad / math.sqrt(seen[key])

        for _ in range(epochs):
            for blocks in rng.sample(pages, len(pages)):
                s, n, t = self.scores(blocks), len(blocks), self.move
                ahead = [(0.0, s[0])]
                for i in range(1, n):
                    r, m = ahead[-1]
                    ahead.append((log_add(r + t[0][0], m + t[1][0]), log_add(r + t[0][1], m + t[1][1]) + s[i]))
                behind = [(0.0, 0.0)] * n
                for i in range(n - 2, -1, -1):
                    r, m = behind[i + 1]
                    behind[i] = (log_add(t[0][0] + r, t[0][1] + s[i + 1] + m), log_add(t[1][0] + r, t[1][1] + s[i + 1] + m))
                total = log_add(*ahead[-1])
                moves = [[0.0, 0.0], [0.0, 0.0]]
                for i in range(1, n):
                    moves[blocks[i - 1].label][blocks[i].label] += 1
                    for a in (0, 1):
                        for b in (0, 1):
                            moves[a][b] -= math.exp(ahead[i - 1][a] + t[a][b] + (s[i] if b else 0.0) + behind[i][b] - total)
                for i, block in enumerate(blocks):
                    grad = block.label - math.exp(ahead[i][1] + behind[i][1] - total)
                    if abs(grad) > 1e-4:
                        for f in block.features:
                            self.state[f] = step(f, grad, self.state.get(f, 0.0))
                self.move = [[step((a, b), moves[a][b], t[a][b]) for b in (0, 1)] for a in (0, 1)]
        return self


def labelled_pages(n: int, seed: int) -> list[str]:
    """Pages in many layouts; data-main marks the label of what stands below. Words are made up, so only layout can be learned."""
    rng = random.Random(seed)
    parts = "an be co du el fi go hu in ja ko lu ma ne or pi ra so tu ve".split()
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: phrase(3, 22).capitalize() + rng.choice("....?!")
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{phrase(1, 3)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9))) + "</ul>"
    rest = lambda tag, names, body: f'<{tag} data-main="0"{name(names)}>{body}</{tag}>'

    def name(names: str) -> str:
        kind = rng.choice(["class", "class", "id"])
        return f' {kind}="{rng.choice(names.split())}{rng.choice(["", "", "", " x1", " row"])}"' if names and rng.random() < 0.9 else ""

    def paragraphs() -> str:
        out = []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            body = prose(1, rng.choice([1, 3, 8])) if rng.random() < 0.9 else phrase(1, 12)
            if kind < 0.68:
                out.append(f"<p>{body}" + "</p>" * (rng.random() < 0.9))
            elif kind < 0.74:
                out.append(f"<p><b>{phrase(2, 8)}<br><p>{body}</p>")
            elif kind < 0.80:
                out.append(f"<h2>{phrase(2, 7)}</h2><p>{body}</p>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.90:
                out.append(f"<blockquote>{body}</blockquote>")
            elif kind < 0.94:
                out.append(f"<div>{body} {link()} {sentence()}</div>")
            elif kind < 0.97:
                out.append(f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{phrase(1, 3)}</td><td>{phrase(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            if rng.random() < 0.08:
                out.append(rest("div", "ad ads advert sponsored promo", prose(1, 2)))
            if rng.random() < 0.05:
                out.append(rest("aside", "related newsletter share", f"<p>{prose(1, 2)}</p>" + links()))
        return "".join(out)

    pages = []
    for _ in range(n):
        before = [
            rest(rng.choice(["nav", "nav", "div"]), "nav menu navbar topnav main-menu", links()),
            rest(rng.choice(["header", "div"]), "header masthead site-header banner", f"<p>{phrase(1, 5)}</p>" + links() * (rng.random() < 0.5)),
            rest("div", "cookie-notice consent gdpr alert notice", f"<p>{prose(1, 2)}</p>" + "<button>ok</button>" * (rng.random() < 0.5)),
            rest(rng.choice(["div", "aside", "section"]), "ad ads advert ad-slot banner-ad sponsor", prose(1, 3) if rng.random() < 0.6 else f"<p>{prose(1, 2)}</p>"),
            rest("form", "search login signup", f"<label>{word()}</label><input><button>{word()}</button>"),
            rest("div", "breadcrumb breadcrumbs", " » ".join(link() for _ in range(3))),
        ]
        after = [
            rest(rng.choice(["aside", "div"]), "sidebar widget rail side", f"<h3>{phrase(1, 3)}</h3>" + rng.choice([links(), f"<p>{prose(1, 3)}</p>"])),
            rest(rng.choice(["section", "div"]), "comments comment-list disqus discussion", "".join(f'<div class="comment"><p>{phrase(1, 2)}</p><p>{prose(1, 4)}</p></div>' for _ in range(rng.randint(1, 5)))),
            rest(rng.choice(["div", "section"]), "related recommended more trending", f"<h3>{phrase(1, 3)}</h3>" + links()),
            rest("form", "newsletter subscribe comment-form", f"<p>{prose(1, 1)}</p><input><button>{word()}</button>"),
            rest("div", "share social tags", "".join(link() for _ in range(3))),
            rest("div", "ad ads advert promo", f"<p>{prose(1, 3)}</p>"),
        ]
        rng.shuffle(before)
        rng.shuffle(after)
        before, after = before[: rng.randint(1, 4)], after[: rng.randint(0, 4)]
        title = f"<h1>{phrase(2, 10)}</h1>" if rng.random() < 0.85 else ""
        wrap = rng.random()
        if wrap < 0.45:
            body = f'<article data-main="1"{name("post entry story") if rng.random() < 0.4 else ""}>{title}{paragraphs()}</article>'
        elif wrap < 0.6:
            body = f'<main data-main="1">{title}{paragraphs()}</main>'
        elif wrap < 0.9:
            kind = rng.choice(["content", "main-content", "post", "entry-content", "article-body", "story", "post-body"])
            body = f'<div data-main="1" {rng.choice(["class", "id"])}="{kind}">{title}{paragraphs()}</div>'
        else:
            body = f'<div data-main="1">{title}{paragraphs()}</div>'
        if rng.random() < 0.15 and after and wrap < 0.45:
            cut = body.rindex("</article>")
            body = body[:cut] + after.pop() + body[cut:]
        foot = rest(rng.choice(["footer", "footer", "div"]), "footer site-footer copyright legal", f"{rng.choice(['&copy; ', ''])}{phrase(1, 4)} &middot; {rng.choice([sentence(), link()])}")
        pages.append(f"<html><head><title>{phrase(2, 6)}</title></head><body>{''.join(before)}{body}{''.join(after)}{foot * (rng.random() < 0.9)}</body></html>")
    return pages


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES) -> Field:
    return Field().fit([b for b in (leaf_blocks(page, labelled=True) for page in labelled_pages(pages, SEED)) if b])


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    return "\n\n".join(b.text for b, label in zip(blocks, field.labels(blocks), strict=True) if label)


def _extract(field: Field, columns: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = [main_text(h, field) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*columns, "text", "n_chars"])

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract(trained(), ["page_id", "url"]), "page_id long, url string, text string, n_chars long")


def op5_crf_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op5_crf_html_text": op5_crf_html_text}
SQL: dict[str, str] = {}
