"""HTML extraction by consensus host paths.

A page is read into containers (elements that hold blocks of text), each with the generalised path of tags and
classes that leads to it (digits in classes become #). A container scores the text of its blocks outside links and
boilerplate, plus nearly all of what its inner containers score. The best is the one that scores most, or the outermost
around it with a heading or paragraph outside the one before. Pages vote for the paths of their best containers; votes are summed per host in Spark, and every page of a host is extracted again at the winning path. A page
without that path, or with much less text there than in its own best container, keeps its own.

Boilerplate (menus, headers and footers of the page, sidebars, notices, adverts, forms, reader comments, scripts and
styles) is told by tag, role and the words of class and id, and never scores nor is extracted. A class word doesn't hold
for an element with a main element, the page's only article, or most of the page's text (unless it tells comments or
related pages), nor on a page that would be empty by it.

Nulls: null html is empty and gives an empty text; a null url is the host ''. Broken markup is read as far as it
goes. Repeated rows vote and are extracted each. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, map_arrow

#: Hosts up to which the winning paths are broadcast; beyond, they are joined by shuffle.
BROADCAST_HOSTS = 20_000
#: Share of its inner containers' score that a container takes over.
INHERIT = 0.95
#: A container votes if it scores this share of the page's best.
VOTES_FROM = 0.6
#: The host's path is used on a page if it holds this share of the text outside links of the page's best container.
USED_FROM = 0.6

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ENDS = re.compile("[>\"']")
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Kinds of tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body center blockquote".split())
ARTICLE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())  # blocks of these are article text
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = ("ul", "ol", "dl", "table", "tbody", "select", *sorted(CONTAINER))  # what CLOSES doesn't reach beyond
BOILER_TAGS = frozenset("nav aside footer form button select dialog menu template svg object canvas audio video head script style title textarea xmp iframe noembed noframes noscript".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted promotion banner cookie cookies consent gdpr notice notices"
    " notification alert popup modal overlay sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs footer social share sharing related recommended recommendations"
    " comment comments commentlist disqus respond reply replies discussion newsletter subscribe subscription signup login widget widgets toolbar pagination pager".split()
)
OTHERS_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion related recommended recommendations".split())  # may hold more text than the article
PAGE_ONLY = frozenset(["header", "masthead", "topbar"])  # boilerplate outside the article only


_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
#: Characters of a tag up to which its quotes are counted; longer ones are looked up.
_SHORT = 2000


class Tags:
    """Tags and comments of a page, each found in time that depends on its own length. What isn't there ahead is remembered: that no
    '>' follows, and where the quotes from each place on lead to."""

    def __init__(self, source: str):
        self.source = source
        self._gt = -2  # the next '>' from the place last asked for; -1 if none follows
        self._known = False

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name, attributes) of the first tag from at on, its name empty for comments and declarations;
        or None. A '<' that begins none is text."""
        source = self.source
        while (i := source.find("<", at)) >= 0:
            if source.startswith("<!--", i):
                end = source.find("-->", i + 4)
                return i, len(source) if end < 0 else end + 3, False, "", ""
            if -1 != self._gt < i:
                self._gt = source.find(">", i)
            if self._gt < 0:
                return None if (i := source.find("<!--", i)) < 0 else (i, len(source), False, "", "")
            if source[i + 1] in "!?":
                return i, self._gt + 1, False, "", ""
            if m := _NAME.match(source, i + 1):
                end = self._end(m.end())
                if end >= 0:
                    return i, end + 1, bool(m[1]), m[2].lower(), source[m.end() : end]
            at = i + 1
        return None

    def _end(self, at: int) -> int:
        """The first '>' from at on that is in no quotes; -1 if there is none before quotes that don't close."""
        if self._gt - at <= _SHORT:
            double, single = self.source.count('"', at, self._gt), self.source.count("'", at, self._gt)
            if not (double and single) and not (double + single) % 2:
                return self._gt
        if not self._known:
            self._learn()
        k, passed = bisect.bisect_left(self._at, at), []
        while k < len(self._at) and self._leads[k] == -2:
            passed.append(k)
            k = self._after[k]
        found = self._leads[k] if k < len(self._at) else -1
        for k in passed:
            self._leads[k] = found
        return found

    def _learn(self) -> None:
        """All '>' and quotes: where each stands, the number of the one behind its closing quote, and the '>' it leads to (-2: not known)."""
        self._known = True
        self._at = [m.start() for m in _ENDS.finditer(self.source)]
        n = len(self._at)
        self._after, self._leads = [n] * n, [-2] * n
        last = {}
        for k in range(n - 1, -1, -1):
            c = self.source[self._at[k]]
            if c == ">":
                self._leads[k] = self._at[k]
            else:
                self._after[k] = last.get(c, n - 1) + 1
                last[c] = k


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}


def _boiler(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """By tag, role or style."""
    if tag in BOILER_TAGS or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body", "article", "main") and "comment" not in attrs.get("class", "").lower():
        return False
    return attrs.get("role", "").lower() in BOILER_ROLES or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _named_boiler(tag: str, attrs: dict[str, str], in_article: bool) -> frozenset[str]:
    """The words of class and id that tell boilerplate."""
    if not attrs or tag in ("html", "body", "article", "main") and "comment" not in attrs.get("class", "").lower():
        return frozenset()
    words = {w.lower() for w in _WORDS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}
    return frozenset(words & (BOILER_WORDS if in_article else BOILER_WORDS | PAGE_ONLY))


class Page:
    """containers: (path number, parent container or -1); blocks: (container, text, characters in links, whether in a heading or
    paragraph) outside boilerplate. A path is a step below another path; only those that vote are written out.

    Reading takes time and memory in proportion to the page, however its elements nest: what is open is known by tag."""

    def __init__(self, source: str):
        self.containers: list[tuple[int, int]] = [(0, -1)]
        self._paths: dict[tuple[int, str], int] = {}
        self._steps: list[tuple[int, str]] = [(-1, "")]
        self.blocks: list[tuple[int, str, int, bool]] = []
        # an element that a class word tells: the told element around it or -1, whether by OTHERS_WORDS, whether it holds main, and whether article
        self._told: list[list] = []
        # text as read: container, whether in a heading or paragraph, and of each part the text, whether linked, and the told element around it
        self._raw: list[tuple[int, bool, list[tuple[str, bool, int]]]] = []
        self._outer_article = False
        # open elements: tag, container, boilerplate, in article, in link, told element around; and where each tag and any block is open
        self._stack: list[tuple[str, int, bool, bool, bool, int]] = [("", 0, False, False, False, -1)]
        self._where: dict[str, list[int]] = {}
        self._open_blocks: list[int] = []
        self._parts: list[tuple[str, bool, int]] = []
        self._read(source)
        self._settle()

    def _settle(self) -> None:
        """Blocks from the text as read. A told element stays if it holds main, the page's only article, or most text of headings
        and paragraphs (comments and related pages may hold more than the article); all stay on a page that would be empty."""
        whole, held = 0, [0] * len(self._told)
        for _, article, parts in self._raw:
            for text, link, told in parts if article else ():
                if not link:
                    whole += len(text.strip())
                    if told >= 0:
                        held[told] += len(text.strip())
        for i in range(len(held) - 1, -1, -1):  # inner elements come after outer ones
            around = self._told[i][0]
            if around >= 0:
                held[around] += held[i]
                for flag in (2, 3):
                    self._told[around][flag] |= self._told[i][flag]
        spared: list[bool] = []
        for i, (around, others, main, article) in enumerate(self._told):
            stays = main or article and not self._outer_article or not others and 2 * held[i] > whole
            spared.append(stays and (around < 0 or spared[around]))
        for everything in (False, True):
            for box, article, parts in self._raw:
                parts = [(text, link) for text, link, told in parts if everything or told < 0 or spared[told]]
                text = " ".join(html_lib.unescape("".join(t for t, _ in parts)).split())
                if text:
                    self.blocks.append((box, text, min(sum(len(t.strip()) for t, link in parts if link), len(text)), article))
            if self.blocks:
                break

    def _flush(self) -> None:
        if self._parts:
            block = self._stack[self._open_blocks[-1]][0] if self._open_blocks else ""
            self._raw.append((self._stack[-1][1], block in ARTICLE, self._parts))
            self._parts = []

    def _take(self, text: str) -> None:
        _, _, boiler, _, in_link, told = self._stack[-1]
        if text and not boiler:
            self._parts.append((text, in_link, told))

    def _read(self, source: str) -> None:
        at, tags = 0, Tags(source)
        while found := tags.next(at):
            start, end, closes, tag, raw = found
            self._take(source[at:start])
            at = end
            if not tag:
                continue
            if closes:
                self._close(tag)
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self._take(" ")
            elif tag in RAW:
                end = _RAW_END[tag].search(source, at)
                at = (source.find(">", end.end()) + 1 if end else 0) or len(source)
            else:
                self._open(tag, raw)
        self._take(source[at:])
        self._flush()

    def _last(self, tags) -> int:
        return max((self._where[t][-1] for t in tags if self._where.get(t)), default=0)

    def _cut_stack(self, size: int) -> None:
        """Ends the open elements from place size on."""
        for i in range(len(self._stack) - 1, size - 1, -1):
            self._where[self._stack[i][0]].pop()
        while self._open_blocks and self._open_blocks[-1] >= size:
            self._open_blocks.pop()
        del self._stack[size:]

    def _open(self, tag: str, raw: str) -> None:
        if tag in BLOCK:
            self._flush()
            if self._open_blocks and self._stack[self._open_blocks[-1]][0] == "p":  # a block ends an open paragraph
                self._cut_stack(self._open_blocks[-1])
        if tag in CLOSES:
            bound = self._last(BOUNDS)
            while (i := self._last(CLOSES[tag])) > bound:
                self._cut_stack(i)
                if tag != "tr":
                    break
        _, box, boiler, in_article, in_link, told = self._stack[-1]
        attrs = _attributes(raw)
        boiler = boiler or _boiler(tag, attrs, in_article)
        if not boiler:
            words = _named_boiler(tag, attrs, in_article)
            if words:
                self._told.append([told, bool(words & OTHERS_WORDS), False, False])
                told = len(self._told) - 1
            elif tag in ("article", "main"):
                self._outer_article |= told < 0
                if told >= 0:
                    self._told[told][2 if tag == "main" else 3] = True
        if tag in CONTAINER and not boiler:
            classes = sorted(re.sub(r"\d+", "#", c).replace(">", "") for c in attrs.get("class", "").split())
            step = (self.containers[box][0], ".".join([tag, *classes]))
            if step not in self._paths:
                self._paths[step] = len(self._steps)
                self._steps.append(step)
            self.containers.append((self._paths[step], box))
            box = len(self.containers) - 1
        self._where.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCK:
            self._open_blocks.append(len(self._stack))
        self._stack.append((tag, box, boiler, in_article or tag in ("article", "main"), in_link or tag == "a", told))

    def _close(self, tag: str) -> None:
        i = self._last((tag,))
        # a stray end tag doesn't end the block around it
        if not i or (tag not in BLOCK or tag == "p") and self._open_blocks and i < self._open_blocks[-1]:
            return
        if tag in BLOCK:
            self._flush()
        self._cut_stack(i)

    def _written(self, path: int) -> str:
        steps = []
        while path > 0:
            path, step = self._steps[path]
            steps.append(step)
        return "".join(f">{s}" for s in reversed(steps))

    def _numbered(self, path: str) -> int:
        """The number of a path that was written out; -1 if the page doesn't have it."""
        at = 0
        for step in path.split(">")[1:]:
            at = self._paths.get((at, step), -1)
        return at

    def scores(self) -> list[float]:
        out = [0.0] * len(self.containers)
        for box, text, linked, _ in self.blocks:
            out[box] += max(0, len(text) - 2 * linked)
        for i in range(len(out) - 1, 0, -1):  # inner containers come after outer ones
            out[self.containers[i][1]] += INHERIT * out[i]
        return out

    def best(self, scores: list[float]) -> int:
        """The container with the best score, or the outermost around it that has a heading or paragraph outside the one before."""
        box = max(range(len(scores)), key=lambda i: (scores[i], -i))
        own = [0] * len(scores)
        for at, text, linked, article in self.blocks:
            own[at] += max(0, len(text) - 2 * linked) if article else 0
        for i in range(len(own) - 1, 0, -1):
            own[self.containers[i][1]] += own[i]
        around = box
        while (around := self.containers[around][1]) >= 0:
            if own[around] > own[box]:
                box = around
        return box

    def votes(self) -> list[tuple[str, float]]:
        """(path, share of the best score) of the containers that vote; each path once.

        Containers around the best one don't vote: they are on every page of a host whatever its layouts, so they would
        win wherever a host has several. Those inside it don't either: they lack a part of the article."""
        scores = self.scores()
        top = max(scores)
        if top <= 0:
            return []
        best = self.best(scores)
        around, box = set(), self.containers[best][1]
        while box >= 0:
            around.add(box)
            box = self.containers[box][1]
        inside = self._within({best})
        out: dict[int, float] = {self.containers[best][0]: 1.0}
        for i, ((path, _), s) in enumerate(zip(self.containers, scores)):
            if s >= VOTES_FROM * top and i not in around and not inside[i]:
                out[path] = max(out.get(path, 0.0), s / top)
        return sorted((self._written(path), share) for path, share in out.items())

    def text(self, path: str | None) -> str:
        """The blocks in containers of that path; if these hold too little, or lack a part of the page's best container around them, those of the best."""
        number = -1 if path is None else self._numbered(path)
        chosen = self._within({i for i, (p, _) in enumerate(self.containers) if p == number})
        best = self._within({self.best(self.scores())})
        if any(c and not b for c, b in zip(chosen, best)):
            lost = False  # the path leads elsewhere, or around the best
        else:
            lost = any(article and len(text) > 2 * linked and best[box] and not chosen[box] for box, text, linked, article in self.blocks)
        own, its = (sum(max(0, len(text) - 2 * linked) for box, text, linked, _ in self.blocks if inside[box]) for inside in (best, chosen))
        return "\n".join(([] if lost or its < USED_FROM * own else self._inside(chosen)) or self._inside(best))

    def _within(self, chosen: set[int]) -> list[bool]:
        inside = [False] * len(self.containers)
        for i, (_, parent) in enumerate(self.containers):
            inside[i] = i in chosen or parent >= 0 and inside[parent]
        return inside

    def _inside(self, inside: list[bool]) -> list[str]:
        return [text for box, text, *_ in self.blocks if inside[box]]


def host(url=None):
    return F.lower(F.regexp_extract(F.coalesce(F.col("url") if url is None else url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def consensus(pages: DataFrame) -> DataFrame:
    """host, path, votes: the path with the most votes of each host, by total share, then pages, then the path itself."""

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(h, path, share) for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for path, share in Page(source or "").votes()]
        cols = list(zip(*rows)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["host", "path", "share"])

    votes = map_arrow(pages.select(host().alias("host"), "html"), vote, "host string, path string, share double")
    # shares are summed in whole thousandths, so that the order of rows can't change a winner
    tally = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1000).cast("long")).alias("votes"), F.count("*").alias("pages"))
    best = F.max(F.struct("votes", "pages", "path"))
    return tally.groupBy("host").agg(best.alias("best")).select("host", "best.path", "best.votes")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path (the host's) of every row of pages."""

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [Page(source or "").text(path) for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3)], names=["page_id", "url", "text", "n_chars", "path"])

    paths = cut(consensus(pages).select("host", "path"), "paths")
    few = paths.count() <= BROADCAST_HOSTS
    rows = pages.select("page_id", "url", "html", host().alias("host")).join(F.broadcast(paths) if few else paths, "host", "left")
    return map_arrow(rows.select("page_id", "url", "html", "path"), read, "page_id long, url string, text string, n_chars long, path string")
