"""Main text of web pages by consensus paths of their hosts.

Every page's containers are scored by the text they hold beside links and by the words in
their tag, class and id. The best one votes, with the share of the page's text that it
holds, for its generalised path: tags and classes from the body down, numbers masked. Votes
are summed per (host, path) in Spark; the winning paths of a host are those with at least a
fifth of its votes, so there are five at most. Each page is then read again and its text
taken from the containers at the first winning path that has text on it, else from its own
best container.

Left out: scripts, styles, form controls, menus, headers, footers, asides, adverts, notices,
comments of readers, and forms, but for one that holds half of the page's text or more, as
where a page is wrapped in a form, and for articles inside forms. Elements are known as such by their tag or by a whole class, id or role,
its last word, or its first word before words like list and box; a word inside a longer name
says nothing. A main element below a noisy wrapper counts again, an article does below
wrappers named for the layout (with a sidebar, a menu). A page that would have no text is
read again without the words of layouts. Of an article or main element the whole kept text
is taken, also what stands outside its best scored part. Character references are decoded, white space inside a block becomes
one space, blocks are joined by one space. Broken markup is read in one pass: an end tag
closes what is open inside its element, one without a start is ignored, the end of the page
closes everything.

A null or empty page has an empty text; so has one of left-out parts alone. Null urls share
the empty host. Repeated rows are read alike, an empty table gives an empty one, other
columns stay, and those named like the results are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import fresh, joined_by_weight, stored

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CONTAINERS = frozenset("article main section div td body".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th blockquote pre figure figcaption"
    " header footer nav aside form fieldset address hr br details summary html head option".split()
)
#: Elements that never hold main text, and words of class, id or role that mark such elements.
LEFT_OUT = RAW | frozenset(
    "head nav header footer aside button select label legend datalist noscript svg canvas object template dialog menu".split()
)
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar"
    " navbox menu breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent notice notices"
    " notification newsletter subscribe subscription popup modal share sharing social related recommended"
    " comment comments disqus respond replies widget widgets pagination pager toolbar hidden"
    " complementary contentinfo search".split()
)
#: Noise words that wrappers of whole pages bear as well.
LAYOUT = frozenset("banner nav navigation navbar menu sidebar sidebars masthead widget widgets toolbar search hidden notice header".split())
#: First words of names that end in header and mean the site's; an entry's header belongs to its text.
SITE = frozenset("site top global app brand layout sticky fixed mobile desktop nav main web".split())
#: What follows the word comment in the names of a comment's parts.
COMMENT_PARTS = frozenset("body text content author meta entry reply thread avatar date time message user name".split())
#: Words after which a name's last word says what surrounds an element or what it has.
STATES = frozenset("with without has have no not non is overflow show hide".split())
FURNITURE = frozenset(
    "area list box bar block section item items link links post posts article articles slot unit left right top bottom"
    " primary secondary form button buttons icon icons title signup panel overlay".split()
)
WRAPPERS = frozenset("wrap wrapper container inner".split())
GOOD = frozenset("article content main post entry body text story blog page hentry".split())
CLOSES = {  # an opening tag that ends an open one of these
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
ENDS_PARAGRAPH = BLOCKS - {"br", "td", "th", "tr", "option", "html", "head", "body"}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TOKENS = re.compile(r"[^\W_]+")
DIGITS = re.compile(r"\d+")
WRITTEN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote section table".split())
#: Letters that make the text of a form without any of these more than its own labels.
FORM_TEXT = 140
WINNING_SHARE = 0.2


def noise_of(name: str) -> str | None:
    """The word that marks a class, id or role (in lower case) as noise, if any."""
    words = [w for w in TOKENS.findall(name) if not w.isdigit()]
    if not words:
        return None
    first, last = words[0], words[-1]
    if last == "header" and SITE.issuperset(words[:-1]):
        return last
    if len(words) == 1 or last in NOISE:
        stated = len(words) > 1 and not STATES.isdisjoint(words[:-1])
        return last if last in NOISE and (not stated or name == "is-hidden") else None
    parts = FURNITURE | NOISE | (COMMENT_PARTS if first in ("comment", "comments") else frozenset())
    if first in NOISE and all(w in parts or (w in WRAPPERS and first not in LAYOUT) for w in words[1:]):
        return first
    return None


class Page:
    """One pass over a page: its containers, and its text pieces with their container.

    ``LAYOUT`` words count as noise unless ``layouts`` is false.
    """

    def __init__(self, text: str, layouts: bool = True):
        self.layouts = layouts
        self.main: list[str] = [""]  # per container its tag, where that is article or main
        self.paths: list[str] = [""]
        self.parent: list[int] = [-1]
        self.good: list[float] = [1.0]
        self.end: list[int] = [0]
        self.pieces: list[tuple[int, int, str, bool]] = []  # container, block, text, in a link
        self._forms: list[int] = []  # per piece the outermost form around it, or 0
        self._form = 0
        self._written: set[int] = set()  # forms with paragraphs, headings or content containers
        # tag, container, left out (1 in a layout wrapper, 2 in other noise, 3 for good), in a link, form
        self._stack: list[tuple[str, int, int, bool, int]] = [("", 0, 0, False, 0)]
        self._open: dict[str, int] = {}
        self._block = 0
        self._read(text)
        while len(self._stack) > 1:
            self._pop()
        self.end[0] = len(self.paths)
        if self._form:
            self._drop_forms()

    def _drop_forms(self) -> None:
        """Leaves out the forms that hold less than half of the page's text, or nothing but a few bare words."""
        sizes = [0] * (self._form + 1)
        for form, (_, _, text, _) in zip(self._forms, self.pieces):
            sizes[form] += len(text) - sum(map(text.count, " \n\t\r"))
        total = sum(sizes)
        kept = {i for i, n in enumerate(sizes) if not i or (2 * n >= total and (i in self._written or n >= FORM_TEXT))}
        self.pieces = [p for form, p in zip(self._forms, self.pieces) if form in kept]

    def _read(self, text: str) -> None:
        at, size = 0, len(text)
        ends = {">": text.rfind(">"), '"': text.rfind('"'), "'": text.rfind("'")}
        while at < size:
            start = text.find("<", at)
            if start < 0:
                self._text(text[at:])
                return
            if start > at:
                self._text(text[at:start])
            mark = text[start + 1:start + 2]
            closing = mark == "/"
            name = NAME.match(text, start + 1 + closing)
            if name is None:
                if text.startswith("<!--", start):
                    stop = text.find("-->", start + 4)
                    at = size if stop < 0 else stop + 3
                elif mark in ("!", "?", "/"):
                    stop = text.find(">", start)
                    at = size if stop < 0 else stop + 1
                else:
                    self._text("<")
                    at = start + 1
                continue
            stop = self._tag_end(text, name.end(), ends)
            if stop < 0:
                return
            tag, at = name.group().lower(), stop + 1
            if closing:
                self._close(tag)
                continue
            self._start(tag, text[name.end():stop])
            if tag in RAW:
                over = re.compile(rf"</{tag}(?![\w-])", re.I).search(text, at)
                if over is None:
                    return
                at = over.start()

    @staticmethod
    def _tag_end(text: str, at: int, ends: dict[str, int]) -> int:
        """Where the tag's ``>`` is, outside quoted values that are closed; -1 if nowhere."""
        while ends[">"] >= at:
            found = STOP.search(text, at)
            sign = found.group()
            if sign == ">":
                return found.start()
            at = found.end()
            if ends[sign] >= at:
                after = text.find(sign, at) + 1
                if ends[">"] >= after:
                    at = after
        return -1

    def _text(self, piece: str) -> None:
        tag, container, left_out, link, form = self._stack[-1]
        if not left_out:
            self._forms.append(form)
            self.pieces.append((container, self._block, entities.unescape(piece) if "&" in piece else piece, link))

    def _pop(self) -> None:
        tag, container, *_ = self._stack.pop()
        self._open[tag] -= 1
        if tag in BLOCKS:
            self._block += 1
        if container != self._stack[-1][1]:
            self.end[container] = len(self.paths)

    def _close(self, tag: str) -> None:
        if self._open.get(tag):
            while self._stack[-1][0] != tag:
                self._pop()
            self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._block += 1
        if tag in VOID:
            return
        if tag in ENDS_PARAGRAPH and self._open.get("p") and self._stack[-1][0] == "p":
            self._pop()
        ends = CLOSES.get(tag, ())
        while self._stack[-1][0] in ends:
            self._pop()
        _, container, left_out, link, form = self._stack[-1]
        classes: list[str] = []
        words: set[str] = set()
        noise = 3 if tag in LEFT_OUT else 0
        if attributes and not attributes.isspace():
            seen: set[str] = set()
            for found in ATTRIBUTE.finditer(attributes):
                name, value = found.group(1).lower(), found.group(2) or found.group(3) or found.group(4) or ""
                if name in seen:
                    continue
                seen.add(name)
                if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                    noise = 3
                elif name in ("class", "id", "role"):
                    parts = value.lower().split()
                    words.update(TOKENS.findall(value.lower()))
                    if name == "class":
                        classes = sorted({DIGITS.sub("#", c) for c in parts})
                    for word in filter(None, map(noise_of, parts)):
                        noise = max(noise, (1 if self.layouts else 0) if word in LAYOUT else 2)
        whole = tag in ("article", "main")
        if whole and left_out == (1 if tag == "article" else min(left_out, 2)):
            left_out = 0
        if whole:
            form = 0
        elif tag == "form" and not form:
            self._form += 1
            form = self._form
        if form and (tag in WRITTEN or (tag in CONTAINERS and words & GOOD)):
            self._written.add(form)
        if noise == 3 or (noise and not whole and tag not in ("body", "html")):
            left_out = max(left_out, noise)
        if tag in CONTAINERS and not left_out:
            self.paths.append(self.paths[container] + ">" + ".".join([tag, *classes]))
            self.parent.append(container)
            self.good.append(2.0 if tag in ("article", "main") else 1.5 if words & GOOD else 1.0)
            self.main.append(tag if whole else "")
            self.end.append(0)
            container = len(self.paths) - 1
        self._stack.append((tag, container, left_out, link or tag == "a", form))
        self._open[tag] = self._open.get(tag, 0) + 1

    def best(self) -> tuple[int, float]:
        """The container with the best score, and the share of the page's text in it."""
        if len(self.paths) == 1:
            return 0, 1.0
        own = [0.0] * len(self.paths)
        for container, _, text, link in self.pieces:
            size = len(text) - text.count(" ")
            own[container] += -0.5 * size if link else size
        score, inside = own[:], own[:]
        for i in range(len(own) - 1, 0, -1):  # children follow their parents
            inside[self.parent[i]] += inside[i]
            score[self.parent[i]] += 0.6 * score[i]
        chosen = self._whole(max(range(len(own)), key=lambda i: (score[i] * self.good[i], -i)), inside)
        return chosen, (inside[chosen] / inside[0] if inside[0] > 0 else 0.0)

    def _whole(self, chosen: int, inside: list[float]) -> int:
        """The article, or else the main element, around a container, if it has further text."""
        above, main = chosen, chosen
        while above >= 0 and self.main[above] != "article":
            main = above if self.main[above] else main
            above = self.parent[above]
        above = main if above < 0 else above
        return above if inside[above] > inside[chosen] else chosen

    def text_of(self, containers: list[int]) -> str:
        """Text of the containers, in page order, each piece once."""
        blocks: dict[int, list[str]] = {}
        spans = [(c, self.end[c]) for c in containers]
        for container, block, text, _ in self.pieces:
            if any(a <= container < b for a, b in spans):
                blocks.setdefault(block, []).append(text)
        joined = (" ".join("".join(parts).split()) for parts in blocks.values())
        return " ".join(b for b in joined if b)

    def outermost(self, path: str) -> list[int]:
        found: list[int] = []
        for i, own in enumerate(self.paths):
            if own == path and not (found and i < self.end[found[-1]]):
                found.append(i)
        return found

    def main_text(self, winning: list[str]) -> str:
        for path in winning:
            text = self.text_of(self.outermost(path))
            if text:
                return text
        return self.text_of([self.best()[0]])


def read(text: str | None) -> Page:
    """The page, its layout words being no noise where they leave no text."""
    page = Page(text or "")
    if not any(piece.strip() for _, _, piece, _ in page.pieces):
        page = Page(text or "", layouts=False)
    return page


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


@F.pandas_udf(T.StructType().add("path", "string").add("share", "double"))
def page_vote(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        votes = []
        for text in batch:
            page = read(text)
            chosen, share = page.best()
            votes.append((page.paths[chosen], max(share, 0.0)))
        yield pd.DataFrame(votes, columns=["path", "share"])


@F.pandas_udf(T.StringType())
def page_text(pages: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for batch, winning in pages:
        yield pd.Series(
            [read(text).main_text([] if paths is None else list(paths)) for text, paths in zip(batch, winning, strict=True)],
            dtype=object,
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths, many): a host's winning generalised paths, most votes first, and its number of pages."""
    votes = pages.select(host_of(F.col("url")).alias("host"), page_vote("html").alias("v"))
    counted = votes.groupBy("host", F.col("v.path").alias("path")).agg(F.sum("v.share").alias("votes"), F.count("*").alias("n"))
    counted = stored(counted, "votes")
    totals = counted.groupBy("host").agg(F.sum("votes").alias("total"), F.sum("n").alias("many"))
    won = counted.join(totals, "host").filter((F.col("votes") > 0) & (F.col("votes") >= WINNING_SHARE * F.col("total")))
    ranked = won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))).alias("w"))
    paths = ranked.select("host", F.transform("w", lambda w: w["path"]).alias("paths"))
    return totals.join(paths, "host", "left").select("host", "paths", "many")


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``.

    Pages of hosts with many pages meet the host's paths where they lie; only those of
    hosts with less than a thousandth of all are shuffled to them.
    """
    pages = pages.drop("text", "n_chars")
    host, paths, many = fresh(pages, "host"), fresh(pages, "paths"), fresh(pages, "many")
    winning = stored(host_paths(pages), "paths").toDF(host, paths, many)
    joined = joined_by_weight(pages.withColumn(host, host_of(F.col("url"))), winning, host, many)
    out = joined.withColumn("text", page_text("html", paths)).select(*pages.columns, "text")
    return out.withColumn("n_chars", F.length("text").cast("long"))
