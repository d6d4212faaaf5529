"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between the boundaries of block
elements, each with the elements above it. A block's features are its ancestors'
tags, the word classes of their class, id and role attributes, the shape of
its and its neighbours' text (length, link share, end of a sentence), and whether
an announced article holds it, is elsewhere on the page, or is missing. The field has two states,
main and other, weights per feature and state, and weights per pair of
neighbouring states. It is trained by gradient ascent on the log-likelihood of
labelled pages (`labelled_pages`: generated from a grammar of page layouts,
`TRAINING_PAGES` of them, whatever the input's size) and decoded by Viterbi.

The text of a page is that of its main blocks in page order, each with its white
space as single spaces and trimmed, joined by line feeds; nothing else is cut.
Scripts, styles, the head, comments in markup, options of forms and the
annotations of formulas give no blocks. Character references are decoded once.

Defined cases: a null or empty page, or one without main blocks, has the empty
text; text outside all elements is a block without ancestors; unclosed elements
end with their parent, or with the next element of their kind where HTML says
so, a head with the first thing it can't hold; repeated rows are extracted each; an empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES, EPOCHS, RATE, DECAY = 700, 12, 0.3, 1e-4

# Element kinds of HTML, by name.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = set("head script style noscript template svg iframe object select datalist textarea title annotation annotation-xml".split())
#: What may stand in a head; anything else ends it.
_HEAD = set("html head base basefont bgsound link meta title style script noscript template noframes".split())
_INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img "
              # Formulas stand in the line, apart from their annotations, which are not shown.
              "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover "
              "mmultiscripts mprescripts none mtable mtr mtd semantics annotation annotation-xml maction menclose mfenced".split())
#: Elements that a start of the same group closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_IN_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul"
            .split())
_SCOPE = set("ul ol dl table td th div section article aside nav main body form".split())
# Words of class, id and role attributes, by what they announce.
_CLASSES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toolbar tabs topbar pagination pager skip",
    "header": "header masthead banner logo branding hero top",
    "footer": "footer foot copyright colophon legal contentinfo bottom",
    "side": "sidebar side aside related widget widgets recommended trending popular rail complementary tags more",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay dialog message disclaimer paywall",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted banner-ad adsbox",
    "form": "form login signup subscribe subscription newsletter search contact",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses feedback",
    "share": "share sharing social follow like",
    "main": "article content main post entry story body text page-content post-content entry-content article-body",
}
_KIND = {w: k for k, words in _CLASSES.items() for w in words.split()}
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    tags: tuple[str, ...]
    kinds: frozenset[str]
    text: str
    linked: int
    label: int | None = None


@dataclass
class _Element:
    tag: str
    kinds: frozenset[str]
    label: int | None


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[_Element] = []
        self.parts: list[str] = []
        self.linked = self.links = self.silent = 0

    def _end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            label = next((e.label for e in reversed(self.stack) if e.label is not None), None)
            self.blocks.append(Block(tuple(e.tag for e in self.stack), frozenset().union(*(e.kinds for e in self.stack)), text, self.linked, label))
        self.parts, self.linked = [], 0

    def _pop_to(self, depth: int) -> None:
        if any(e.tag not in _INLINE for e in self.stack[depth:]):
            self._end_block()
        for e in self.stack[depth:]:
            self.links -= e.tag == "a"
            self.silent -= e.tag in _SILENT
        del self.stack[depth:]

    def _end_head(self) -> None:
        """A head without an end tag ends before what it can't hold."""
        if self.stack and self.stack[-1].tag == "head":
            self._pop_to(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _HEAD:
            self._end_head()
        if tag == "body":  # a head with an unclosed element ends here
            self._pop_to(next((i for i, e in enumerate(self.stack) if e.tag == "head"), len(self.stack)))
        closes = _CLOSES.get(tag, set()) | ({"p"} if tag in _IN_P else set())
        if closes:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag in closes:
                    self._pop_to(i)
                    break
                if self.stack[i].tag in _SCOPE - closes:
                    break
        if tag == "br":
            self.parts.append(" ")
        elif tag not in _INLINE:
            self._end_block()
        if tag in _VOID:
            return
        words = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        kinds = {_KIND[w] for w in words.split() if w in _KIND} | {_KIND[w] for w in re.split(r"[^a-z]+", words) if w in _KIND}
        label = next((int(v) for k, v in attrs if k == "data-label" and v in ("0", "1")), None)
        self.stack.append(_Element(tag, frozenset(kinds), label))
        self.links += tag == "a"
        self.silent += tag in _SILENT

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self._pop_to(i)
                return
            # An inline end tag does not close a block.
            if tag in _INLINE and self.stack[i].tag not in _INLINE:
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_block()


def leaf_blocks(html: str) -> list[Block]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.blocks


#: Elements and word classes that announce something else than the article, and those that announce it.
_OTHER_TAGS = set("nav header footer aside form menu dialog fieldset".split())
_OTHER_KINDS = set(_CLASSES) - {"main", "header"}
_MAIN_TAGS = {"article", "main"}


def _shape(block: Block) -> str:
    """Length, link share and end of a block's text."""
    n = len(block.text)
    ends = "s" if block.text[-1] in ".!?…。\"”»" else "n"
    return f"{min(max(n.bit_length(), 5), 9)}{'l' if 2 * block.linked > n else ''}{ends}"


def features(blocks: list[Block]) -> list[list[str]]:
    """The features of each block of a page: its own, its neighbours' shapes, and where it stands to an announced article."""
    shapes = [_shape(b) for b in blocks]
    announced = [bool(_MAIN_TAGS.intersection(b.tags)) or "main" in b.kinds for b in blocks]
    marked = [bool(_OTHER_TAGS.intersection(b.tags)) or bool(_OTHER_KINDS & b.kinds) for b in blocks]
    some = any(announced)
    out = []
    for i, block in enumerate(blocks):
        n = len(block.text)
        place = "in" if announced[i] else "out" if some else "none"
        found = ["bias", f"leaf:{block.tags[-1] if block.tags else ''}", f"size:{min(max(n.bit_length(), 5), 9)}",
                 f"links:{min(3, 4 * block.linked // max(n, 1))}", "sentence" if shapes[i][-1] == "s" else "no-sentence",
                 f"place:{place}", f"marked:{marked[i]}", f"place:{place}:marked:{marked[i]}", f"shape:{shapes[i]}:marked:{marked[i]}",
                 f"before:{shapes[i - 1] if i else 'start'}", f"after:{shapes[i + 1] if i + 1 < len(blocks) else 'end'}"]
        found += [f"in:{t}" for t in set(block.tags) if t not in ("html", "body", "div", "span")]
        found += [f"class:{k}" for k in block.kinds]
        if "©" in block.text[:40]:
            found.append("copyright")
        out.append(found)
    return out


@dataclass
class Field:
    """The trained weights: feature to (other, main), first state, and transitions[from][to]."""

    unary: dict[str, tuple[float, float]] = field(default_factory=dict)
    first: tuple[float, float] = (0.0, 0.0)
    step: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best sequence of states, by Viterbi."""
        back, best = [], None
        (a00, a01), (a10, a11) = self.step
        get, none = self.unary.get, (0.0, 0.0)
        for own in features(blocks):
            s0 = s1 = 0.0
            for f in own:
                w = get(f, none)
                s0 += w[0]
                s1 += w[1]
            if best is None:
                best = (s0 + self.first[0], s1 + self.first[1])
                continue
            from0 = (best[0] + a00, best[1] + a10)
            from1 = (best[0] + a01, best[1] + a11)
            back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
            best = (s0 + max(from0), s1 + max(from1))
        if best is None:
            return []
        states = [int(best[1] > best[0])]
        for b in reversed(back):
            states.append(b[states[-1]])
        return states[::-1]


def train(pages: list[list[Block]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 17) -> Field:
    """Stochastic gradient ascent on the conditional log-likelihood, by forward and backward sums."""
    seen = [features(p) for p in pages]
    names = {f: i for i, f in enumerate(sorted({f for p in seen for b in p for f in b}))}
    w, first, step = np.zeros((len(names), 2)), np.zeros(2), np.zeros((2, 2))
    data = [([np.array([names[f] for f in b]) for b in own], np.array([b.label for b in p])) for p, own in zip(pages, seen, strict=True) if p]
    order = random.Random(seed)
    for epoch in range(epochs):
        order.shuffle(data)
        eta = rate / (1 + epoch)
        for rows, y in data:
            n = len(rows)
            s = np.array([w[r].sum(axis=0) for r in rows])
            fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
            fwd[0] = s[0] + first
            for t in range(1, n):
                fwd[t] = s[t] + np.logaddexp(fwd[t - 1, 0] + step[0], fwd[t - 1, 1] + step[1])
            for t in range(n - 2, -1, -1):
                ahead = s[t + 1] + bwd[t + 1]
                bwd[t] = np.logaddexp(step[:, 0] + ahead[0], step[:, 1] + ahead[1])
            z = np.logaddexp(*fwd[-1])
            error = np.eye(2)[y] - np.exp(fwd + bwd - z)
            pull = np.zeros((2, 2))
            for t in range(1, n):
                pull -= np.exp(fwd[t - 1][:, None] + step + (s[t] + bwd[t])[None, :] - z)
                pull[y[t - 1], y[t]] += 1
            w *= 1 - eta * DECAY
            for r, e in zip(rows, error, strict=True):
                w[r] += eta * e
            first += eta * error[0]
            step += eta * pull / n
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, tuple(first.tolist()), tuple(map(tuple, step.tolist())))


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 17) -> list[str]:
    """Pages with `data-label` on their parts, drawn from a grammar of layouts; features don't see the labels."""
    r = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi)))

    def sentence(lo: int = 4, hi: int = 60) -> str:
        return words(lo, hi).capitalize() + r.choice([".", ".", ".", ".", "", "!", "?", " &amp;"])

    def links() -> str:
        return "<ul>" + "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(r.randint(2, 7))) + "</ul>"

    def named(kind: str) -> str:
        return r.choice(["class", "id"]) + f'="{r.choice(_CLASSES[kind].split())}"' if r.random() < 0.85 else ""

    def other(kind: str) -> str:
        body = {"menu": links, "header": lambda: f"<h1>{words(1, 4)}</h1><p>{words(2, 8)}</p>", "footer": lambda: f"&copy; {words(1, 3)} &middot; {sentence()}",
                "side": lambda: f"<h3>{words(1, 4)}</h3>" + links() + f"<p>{sentence(3, 30)}</p>", "notice": lambda: f"<p>{sentence(4, 30)}</p>",
                "advert": lambda: sentence(3, 30), "form": lambda: f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>",
                "comment": lambda: "".join(f"<div class='comment'><b>{words(1, 2)}</b><p>{sentence(3, 60)}</p></div>" for _ in range(r.randint(1, 5))),
                "share": links}[kind]()
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        if tag and r.random() < 0.75:
            return f'<{tag} data-label="0" {named(kind) if r.random() < 0.4 else ""}>{body}</{tag}>'
        cls = r.choice(["class", "id"]) + f'="{r.choice(_CLASSES[kind].split())}"'
        return f'<{r.choice(["div", "div", "section", "ul" if kind == "menu" else "div"])} data-label="0" {cls}>{body}</div>'

    def plain_name() -> str:
        """No class, or one that announces nothing."""
        return "" if r.random() < 0.4 else f'class="{r.choice(["css", "x", "sc", "block", "col", "wrap"])}-{words(1, 1)[:3]}{r.randint(0, 99)}"'

    def article() -> str:
        parts = [f"<h1>{words(2, 10)}</h1>"] if r.random() < 0.6 else []
        for _ in range(r.randint(0, 8)):
            x = r.random()
            parts.append(f"<p>{sentence(1, 3) if x < 0.12 else sentence(1, 120)}</p>" if x < 0.6 else f"<p><b>{sentence(2, 90)}<br>" if x < 0.72 else f"<h2>{words(1, 7)}</h2>" if x < 0.82
                         else "<ul>" + "".join(f"<li>{sentence(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>" if x < 0.9
                         else f"<blockquote>{sentence()}</blockquote>" if x < 0.94 else f"<pre>{words(3, 20)}</pre>" if x < 0.97
                         else f"<p><a href='/y'>{sentence(3, 20)}</a></p>")
            if r.random() < 0.08:
                parts.append(other(r.choice(["advert", "side", "share", "form", "notice"])))
        if r.random() < 0.12:
            parts.append(other("comment"))
        body = "".join(parts) or f"<p>{sentence()}</p>"
        if r.random() < 0.25:  # nothing announces the article
            wrapped = f"<div {plain_name()}>{body}</div>" if r.random() < 0.6 else f"<p>{sentence(4, 60)}</p>" + body
            return wrapped if r.random() < 0.7 else f"<div {plain_name()}>{wrapped}</div>"
        tag = r.choice(["article"] * 5 + ["main", "div", "section"])
        cls = r.choice(["class", "id"]) + f'="{r.choice(_CLASSES["main"].split())}"' if tag in ("div", "section") or r.random() < 0.2 else ""
        return f'<{tag} {cls}>{body}</{tag}>'

    pages = []
    for _ in range(n):
        # Some pages start or end with the article, and some are nothing else.
        many, few = r.choice([0.0, 0.25, 0.4, 0.4]), r.choice([0.0, 0.25, 0.4, 0.4])
        before = [other(k) for k in ("header", "menu", "notice", "advert", "side", "form", "share") if r.random() < many]
        after = [other(k) for k in ("share", "comment", "side", "advert", "form", "footer", "notice") if r.random() < few]
        pages.append("<html><head><title>x</title></head><body data-label='1'>" + "".join([*before, article(), *after]) + "</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train([leaf_blocks(p) for p in labelled_pages()])


def extract(html: str | None, model: Field) -> str:
    blocks = leaf_blocks(html or "")
    return "\n".join(b.text for b, main in zip(blocks, model.decode(blocks), strict=True) if main)


def main_text(pages: DataFrame, model: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = model or default_field()
    kept = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), model) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    kinds = [kept.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return kept.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
