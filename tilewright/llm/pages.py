"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between the edges of block elements. Each block has
features of its ancestor tags, of the words in their class, id and role, and of its text (length, share of
link text, punctuation, place, telling words). The field tags each block as main text or not and is decoded
by Viterbi. It is trained, once for each query, on labelled pages that a seeded generator lays out in many
ways (article, main or named containers; menus, headers, footers, sidebars, notices, adverts, forms and
reader comments around and inside them). ``train`` takes other labelled pages as well.

What is never text: comments, markup, head, script, style, template, form controls, elements with the
attribute hidden or aria-hidden="true" (not the word in another attribute's name or value). All other elements'
text is judged by the field, that of noscript, object, svg, math, canvas and media too. Character
references are decoded; white space in a block (line breaks too) becomes one space; blocks are trimmed
and joined in page order by line feeds; nothing else is dropped and nothing is capped.

Defined results: null html is an empty page with text '' and n_chars 0; unclosed and stray tags are taken
as browsers do in the common cases; a < whose tag never ends is a sign of the text, and reading stays linear in
the page's length however many there are and however deep elements nest; repeated rows agree; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import functools
import html as references
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf
from .common import slices

#: Where markup may start, and what ends a tag or opens a quoted value in it.
OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?])")
EDGE = re.compile(r"[\"'>]")
#: One attribute, its value with it; a quoted string without a name is passed over.
ATTRIBUTE = re.compile(r""""[^"]*"|'[^']*'|([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]\S*)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and elements without text of the page (scripts, styles, parts of forms, the head).
RAW = frozenset("script style textarea title".split())
HIDDEN = RAW | frozenset("head select option button datalist template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
#: An opening tag of the key ends open elements of these names.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: Elements beyond which that rule doesn't look.
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
SECTIONS = frozenset("article main nav aside header footer form section".split())
#: Families of words in class, id and role.
FAMILIES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc topbar tabs pagination pager skip", "side": "sidebar side aside related recommended more trending popular widget rail archive tags taglist categories", "foot": "footer foot copyright legal colophon bottom credits", "head": "header masthead banner branding logo top hero site",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense teaser", "note": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay message warning info banner disclaimer toast", "form": "form forms newsletter subscribe subscription signup login search register contact captcha",
    "comment": "comment comments reply replies respond discussion disqus responses commentlist reader feedback", "share": "share sharing social follow tweet facebook like buttons toolbar", "main": "article content main post entry story text page body articlebody maincontent entrycontent prose document", "meta": "byline author date meta published caption credit bio",
}
FAMILY = {word: name for name, words in FAMILIES.items() for word in words.split()}
TELLING = re.compile(r"(?i)\b(cookies?|subscribe|sign up|log ?in|newsletter|advert\w*|sponsored|copyright|all rights reserved|share|comments?|reply|replied|read more|related|menu|home|search|privacy|terms|follow us|click here|says?)\b|©")


class Path:
    """The open block elements: the names of all their features, those of the inmost ones beside. An element that
    adds no new name shares its parent's set, so deep nesting costs no more than shallow."""

    __slots__ = ("tag", "above", "names", "inmost", "inside")

    def __init__(self, tag: str = "none", marks: tuple[str, ...] = (), parent: Path | None = None):
        own = (f"tag:{tag}", *marks) if parent else ()
        above = parent.names if parent else frozenset()
        self.tag, self.above = tag, parent.tag if parent else "none"
        self.names = above if all(x in above for x in own) else above.union(own)
        telling = [m for m in marks if m.startswith("family:") or tag in SECTIONS] + ([f"tag:{tag}"] if tag in SECTIONS else [])
        self.inmost = telling[-1] if telling else parent.inmost if parent else None
        self.inside = bool(parent and parent.inside) or tag in ("article", "main") or "family:main" in marks


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: Path, linked: int):
        self.text, self.path, self.linked = text, path, linked


class Tags:
    """Ends of a page's tags. A tag ends at the first > outside of quotes; what an unsuccessful search has
    passed is remembered, so all searches together read the page a few times at most."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def end(self, at: int) -> int:
        """The place of the > of a tag whose name ends at ``at``; -1 without one."""
        passed = []
        while at <= self.last[">"]:
            m = EDGE.search(self.page, at)
            place = m.start()
            c = self.page[place]
            if c == ">":
                return place
            passed.append(place)
            if place in self.dead or place >= self.last[c]:
                break
            at = self.page.index(c, place + 1) + 1
        self.dead.update(passed)
        return -1


@functools.lru_cache(maxsize=1 << 14)
def attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    """Families and words of an element's names, and whether it is hidden."""
    marks, hidden = [], False
    for m in ATTRIBUTE.finditer(raw):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        if name not in ("class", "id", "role"):
            continue
        for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
            marks.append("family:" + FAMILY[word] if word in FAMILY else "word:" + word)
    return tuple(dict.fromkeys(marks)), hidden


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, Path, bool]] = []
    places: dict[str, list[int]] = {}  # of the open elements of each name
    outer: list[int] = []  # places of the open block elements
    held: list[str] = []
    root, tags = Path(), Tags(page)
    linked, links, hidden, at = 0, 0, 0, 0

    def flush():
        nonlocal linked
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            if text:
                out.append(Block(text, stack[outer[-1]][1] if outer else root, linked))
            held.clear()
        linked = 0

    def close(upto: int):
        nonlocal links, hidden
        while len(stack) > upto:
            tag, _, gone = stack.pop()
            places[tag].pop()
            if tag not in INLINE:
                outer.pop()
            links -= tag == "a"
            hidden -= gone

    def last(names) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=-1)

    def text(start: int, stop: int):
        nonlocal linked
        if stop > start and not hidden:
            held.append(page[start:stop])
            linked += (stop - start) if links else 0

    end = len(page)
    while at < end:
        m = OPENING.search(page, at)
        if m is None:
            text(at, end)
            break
        if m[3]:
            stop = page.find("-->", m.end())
            stop = end if stop < 0 else stop + 3
        elif m[2]:
            stop = tags.end(m.end()) + 1
        else:
            stop = page.find(">", m.end()) + 1 if m.end() <= tags.last[">"] else 0
        if not stop:  # no markup: a sign by itself
            text(at, m.end())
            at = m.end()
            continue
        text(at, m.start())
        at = stop
        if not m[2]:
            continue
        tag, rest = m[2].lower(), page[m.end() : stop - 1]
        if m[1]:
            k = last((tag,))
            if k >= 0:
                if tag not in INLINE:
                    flush()
                    close(k)
                elif not outer or outer[-1] < k:
                    close(k)
            elif tag in ("p", "br"):
                flush()
            continue
        if tag not in INLINE:
            flush()
            if not hidden:
                k = last(ENDS.get(tag, ()))
                if k > last(STOPS.get(tag, ())):
                    close(k)
                if tag not in VOID and outer and stack[outer[-1]][0] == "p":
                    close(outer[-1])
        elif tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            continue
        marks, gone = (attributes if len(rest) < 1000 else attributes.__wrapped__)(rest) if rest else ((), False)
        gone = gone or tag in HIDDEN
        if tag in RAW:
            done = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = done.end() if done else end
            continue
        places.setdefault(tag, []).append(len(stack))
        above = stack[outer[-1]][1] if outer else root
        if tag not in INLINE:
            outer.append(len(stack))
        stack.append((tag, Path(tag, marks, above) if tag not in INLINE else above, gone))
        links += tag == "a"
        hidden += gone
    flush()
    return out


def bucket(n: float, cuts: tuple[float, ...]) -> int:
    return sum(n >= c for c in cuts)


@functools.lru_cache(maxsize=1 << 14)
def name_features(names: frozenset) -> tuple[int, ...]:
    return tuple(crf.feature(x) for x in names)


def path_features(path: Path) -> tuple[int, ...]:
    names = [f"own:{path.tag}", "inside:" + ("article" if path.inside else "none")]
    if path.above != "none":
        names.append(f"two:{path.above}>{path.tag}")
    if path.inmost:
        names.append(f"inmost:{path.inmost}")
    return (*name_features(path.names), *(crf.feature(x) for x in names))


def features(found: list[Block]) -> list[list[int]]:
    out = []
    for k, b in enumerate(found):
        words = b.text.count(" ") + 1
        size, linked = bucket(words, (2, 4, 8, 15, 30, 60, 120)), bucket(b.linked / max(len(b.text), 1), (0.01, 0.3, 0.7))
        telling = {m[0].lower() for m in TELLING.finditer(b.text)} if words < 40 else set()
        names = ["bias", f"size:{size}", f"linked:{linked}", f"size:{size}:{linked}", f"end:{b.text[-1] in '.!?:;…»”'}", f"commas:{bucket(b.text.count(','), (1, 3, 8))}", f"place:{int(10 * k / len(found))}", *(f"tell:{t}" for t in telling)]
        out.append([*path_features(b.path), *(crf.feature(x) for x in names)])
    return out


# Labelled pages that are laid out by a seeded generator.


def sentence(rng: random.Random, least: int, most: int) -> str:
    words = ["".join(rng.choice(("th", "er", "on", "an", "re", "la", "de", "en", "que", "io", "st", "ch", "ung", "ción", "é", "u", "ba", "mi")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(least, most))]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?"])


def paragraph(rng: random.Random) -> str:
    return " ".join(sentence(rng, 3, 16) for _ in range(rng.choice((1, 1, 2, 3, 5, 8))))


def named(rng: random.Random, *names: str) -> str:
    name = rng.choice(names)
    return rng.choice([f'class="{name}"', f'id="{name}"', f'class="x-{name} wide"', f'class="{name}-box"'])


def boilerplate(rng: random.Random, kind: str) -> str:
    items = lambda n: "".join(f'<li><a href="/{i}">{sentence(rng, 1, 3)[:-1]}</a></li>' for i in range(rng.randint(2, n)))
    few = lambda: "".join(f"<p>{paragraph(rng)}</p>" for _ in range(rng.randint(1, 3)))
    if kind == "nav":
        return rng.choice([f"<nav><ul>{items(8)}</ul></nav>", f'<div {named(rng, "menu", "navbar", "breadcrumbs")}><ul>{items(6)}</ul></div>', f'<div role="navigation">{"".join(f"<a href=#>{sentence(rng, 1, 2)}</a> " for _ in range(5))}</div>'])
    if kind == "ad":
        return f'<div {named(rng, "ad", "ads", "advert", "promo", "sponsored")}>{rng.choice([paragraph(rng), f"<p>{paragraph(rng)}</p>", f"<a href=/x>{sentence(rng, 2, 8)}</a>"])}</div>'
    if kind == "aside":
        return rng.choice([f"<aside><h3>{sentence(rng, 1, 4)}</h3>{few()}</aside>", f"<aside><ul>{items(6)}</ul></aside>", f'<div {named(rng, "sidebar", "related", "widget")}><h3>{sentence(rng, 1, 3)}</h3>{rng.choice([few(), f"<ul>{items(5)}</ul>"])}</div>'])
    if kind == "notice":
        return rng.choice([f'<div {named(rng, "cookie", "consent", "notice", "alert", "popup")}><p>{rng.choice(["We use cookies. ", ""])}{sentence(rng, 4, 18)}</p><button>OK</button></div>', f'<div role="alert">{sentence(rng, 4, 20)}</div>', f'<section {named(rng, "notice", "disclaimer", "banner")}>{few()}</section>'])
    if kind == "form":
        return f'<form {named(rng, "newsletter", "search", "login", "f")}><label>{sentence(rng, 1, 4)}</label><p>{rng.choice(["Subscribe to our newsletter. ", ""])}{sentence(rng, 2, 12)}</p><input name=q><button>Go</button></form>'
    if kind == "comments":
        one = lambda: rng.choice([f'<div class="comment"><b>{sentence(rng, 1, 2)[:-1]}</b><p>{paragraph(rng)}</p></div>', f"<li><p>{paragraph(rng)}</p></li>", f"<article><header>{sentence(rng, 1, 2)}</header><p>{paragraph(rng)}</p></article>"])
        box = rng.choice(["section", "div", "ol"])
        return f'<{box} {named(rng, "comments", "comment-list", "discussion", "responses", "replies")}><h3>{rng.choice(["Comments", sentence(rng, 1, 2)])}</h3>{"".join(one() for _ in range(rng.randint(1, 5)))}</{box}>'
    if kind == "header":
        return rng.choice([f'<header><div class="logo">{sentence(rng, 1, 3)}</div><p>{sentence(rng, 2, 9)}</p></header>', f'<div {named(rng, "header", "masthead", "topbar")}><p>{sentence(rng, 2, 12)}</p></div>'])
    if kind == "share":
        return f'<div {named(rng, "share", "social", "tags")}><a href=#>{sentence(rng, 1, 2)}</a> <a href=#>{sentence(rng, 1, 2)}</a></div>'
    return rng.choice([f"<footer>&copy; www.example.com &middot; {paragraph(rng)}</footer>", f"<footer><p>{paragraph(rng)}</p><ul>{items(4)}</ul></footer>", f'<div {named(rng, "footer", "copyright", "legal")}><p>&copy; 2020 {sentence(rng, 2, 12)}</p></div>'])


#: Marks the generator's main text; it is taken out before features are made.
MARK = "\ue000"


def content(rng: random.Random) -> list[str]:
    out = [f"<h1>{MARK}{sentence(rng, 2, 12)}</h1>"] if rng.random() < 0.9 else []
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.08:
            out.append(rng.choice([f"<p>{MARK}{sentence(rng, 1, 2)[:-1]}</p>", f"<p><b>{MARK}{sentence(rng, 1, 3)[:-1]}<br>"]))
        elif kind < 0.72:
            out.append(f"<p>{MARK}{paragraph(rng)}" + ("</p>" if rng.random() < 0.9 else ""))
        elif kind < 0.8:
            out.append(f"<h2>{MARK}{sentence(rng, 1, 8)}</h2>")
        elif kind < 0.86:
            tag = rng.choice(["ul", "ol"])
            out.append(f"<{tag}>" + "".join(f"<li>{MARK}{sentence(rng, 2, 14)}</li>" for _ in range(rng.randint(2, 5))) + f"</{tag}>")
        elif kind < 0.9:
            out.append(f"<blockquote><p>{MARK}{paragraph(rng)}</p></blockquote>")
        elif kind < 0.93:
            out.append(f"<table><tr><td>{MARK}{sentence(rng, 1, 4)}</td><td>{MARK}{sentence(rng, 1, 4)}</td></tr></table>")
        elif kind < 0.95:
            out.append(f"<pre>{MARK}{sentence(rng, 2, 20)}</pre>")
        elif kind < 0.97:
            out.append(f"<figure><img src=x><figcaption>{MARK}{sentence(rng, 2, 10)}</figcaption></figure>")
        else:
            out.append(f'<p>{MARK}{sentence(rng, 2, 9)} <a href="/l">{sentence(rng, 1, 4)}</a> {sentence(rng, 2, 9)}</p>')
        if rng.random() < 0.1:
            out.append(boilerplate(rng, rng.choice(["ad", "ad", "aside", "share", "form", "notice"])))
    return out


def labelled_page(rng: random.Random) -> str:
    """A page in which each block of main text starts with MARK."""
    inside = "".join(content(rng))
    if rng.random() < 0.25:
        inside += boilerplate(rng, "comments")
    if rng.random() < 0.15:
        inside = f"<header>{'' if rng.random() < 0.5 else ''}<h1>{MARK}{sentence(rng, 2, 9)}</h1></header>" + inside
    wrap = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f'<div {named(rng, "content", "post", "entry", "story", "article-body", "main")}>', "</div>"), ('<div class="x"><div>', "</div></div>"), ('<section class="text">', "</section>")])
    before = [boilerplate(rng, k) for k in ("header", "nav", "notice", "ad", "aside", "form") if rng.random() < 0.45]
    after = [boilerplate(rng, k) for k in ("comments", "aside", "ad", "share", "form", "notice", "footer") if rng.random() < (0.8 if k == "footer" else 0.4)]
    rng.shuffle(before)
    return f"<!DOCTYPE html><html><head><title>{sentence(rng, 2, 8)}</title><style>p{{}}</style></head><body>{''.join(before)}{wrap[0]}{inside}{wrap[1]}{''.join(after)}</body></html>"


def train(pages: list[str] | None = None, count: int = 500, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A field from labelled pages (MARK before each block of main text); generated ones by default."""
    rng = random.Random(seed)
    sequences = []
    for page in pages if pages is not None else [labelled_page(rng) for _ in range(count)]:
        found = blocks(page)
        labels = [int(MARK in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(MARK, "")
        for s in range(0, len(found), 60):
            sequences.append((features(found)[s : s + 60], labels[s : s + 60]))
    return crf.train([x for x in sequences if x[1]], 2)


def main_text(page: str, w: np.ndarray, trans: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    e = np.stack([w[x].sum(axis=0) for x in features(found)])
    return "\n".join(b.text for b, y in zip(found, crf.viterbi(e, trans), strict=True) if y == 1)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(train())  # a fixed number of weights

    def run(batches):
        w, trans = shared.value
        for batch in slices(batches, "html"):
            texts = [main_text(x or "", w, trans) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
