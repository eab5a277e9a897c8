"""Main text of web pages by consensus host paths (operator 13).

1. Every page is parsed leniently and its containers are scored: the text of
   their blocks, less a penalty for linked text; menus, headers, footers,
   sidebars, notices, adverts, forms, scripts, styles and reader comments
   count nothing.  From the top the page goes down into the one container
   that holds nearly all of the score, and votes for that container's
   generalised path: the tags and classes down to it, digits as ``#``.
2. Spark counts the votes per host and path.  A host's winning paths are those
   with at least ``SHARE`` of its votes, so at most 1 / SHARE of them.
3. Pages are read again: the text is that of the container on the host's
   first winning path that the page has (the best scored, if several); a page
   that has none of them, or no host, uses its own choice.

Only (host, path, count) rows are shuffled.  The winning paths of up to
``BROADCAST_HOSTS`` hosts (counted; a row is bounded) are broadcast, so no page
moves; those of more hosts are joined by host and a salt, so that one host's
pages spread over ``SALTS`` tasks.

Text: character references are decoded, white space inside a block becomes one
space (line breaks of ``br`` too), blocks are trimmed and joined by a line
feed in page order; empty blocks are left out.  Parsing takes time linear in
the page, however broken it is.

Cases: null html is empty; a page without markup is one block; repeated pages
and null ids each give a row; a null url has no host; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import lean, text_of

SHARE = 0.05                   # of a host's votes that a winning path has
MOST_OF = 0.8                  # of the score that a container must hold to be entered
LINK_PENALTY = 3               # score lost for a linked character
BROADCAST_HOSTS = 10_000
SALTS = 32
PATH_CHARS = 160               # a longer path is named by its end and a hash

# FIXED VALUES: elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CONTAINERS = frozenset("html body main article section div td table tbody tr center form fieldset blockquote".split())
BLOCKS = (CONTAINERS - {"td"}) | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre hr figure figcaption address details summary header footer nav aside "
    "thead tfoot caption menu hgroup search dialog legend option optgroup select noscript template".split())
LEFT_OUT = frozenset(
    "head nav footer aside form script style textarea title noscript iframe template button select input svg canvas "
    "object applet audio video menu dialog search xmp noembed noframes math".split())
# words of a class, id or role that name parts beside the article
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos "
    "promotion nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager footer masthead topbar "
    "toolbar sidebar sidebars aside widget widgets comment comments respond replies reply disqus cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations skip hidden complementary contentinfo search searchbox form".split())
READERS = frozenset("comment comments respond replies reply disqus".split())
ARTICLE_ROLES = frozenset(("main", "article"))

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))?+)*?)>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden)(?=[\s=/]|$)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Page:
    """A page as nodes in page order and a list of tokens: text, a node's
    begin (its number) or end (-1 - its number)."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#root"]
        self.step: list[str] = [""]              # the node's part of a path
        self.parent: list[int] = [-1]
        self.beside: list[bool] = [False]        # a part that is left out
        self.role: list[bool] = [False]
        self.begin: list[int] = [0]
        self.end: list[int] = [0]
        self.tokens: list = [0]
        self._article = False                    # whether an article has begun
        self._of_readers: set[int] = set()
        self._unended: set[str] = set()          # raw elements without an end tag
        self._count: dict[str, int] = {}         # open elements
        self._parse(source)

    # an open element: (node, then the stack heights of the nearest open p, li,
    # dt/dd, cell and row that a new one may close; -1 for none)
    _KINDS = {"p": 1, "li": 2, "dt": 3, "dd": 3, "td": 4, "th": 4, "tr": 5, "option": 6}
    _LIMITS = {"ul": (2,), "ol": (2,), "menu": (2,), "dl": (3,), "table": (1, 2, 3, 4, 5), "td": (1, 2, 3), "th": (1, 2, 3),
               "select": (6,)}

    def _open(self, tag: str, attributes: str, stack: list) -> None:
        names, roles, hidden = "", "", False
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                value = (m[2] or "").strip("\"'")
                key = m[1].lower()
                if key == "hidden":
                    hidden = True
                elif key == "role":
                    roles += " " + value
                elif key == "class":
                    names += " " + value
                else:
                    roles += " " + _CAMEL.sub(" ", value)
        classes = sorted({_DIGITS.sub("#", c) for c in names.split()})
        words = set(_WORDS.findall((_CAMEL.sub(" ", names) + roles).lower()))
        node = len(self.tag)
        self.tag.append(tag)
        self.step.append(".".join([tag, *classes]))
        self.parent.append(stack[-1][0])
        self.role.append(tag in ARTICLE_ROLES or bool(words & ARTICLE_ROLES) and "role" in attributes.lower())
        self.beside.append(tag in LEFT_OUT or hidden or tag not in ("html", "body") and bool(words & BESIDE))
        if tag in ARTICLE_ROLES and not self.beside[node] and not self._article:
            # a wrapper of the page's first article is no part beside it, whatever its name
            self._article = True
            for held in stack:
                if self.tag[held[0]] in CONTAINERS and held[0] not in self._of_readers:
                    self.beside[held[0]] = False
        if words & READERS:
            self._of_readers.add(node)
        self.begin.append(len(self.tokens))
        self.end.append(-1)
        self.tokens.append(node)
        near = list(stack[-1])
        near[0] = node
        for kind in self._LIMITS.get(tag, ()):
            near[kind] = -1
        kind = self._KINDS.get(tag)
        if kind:
            near[kind] = len(stack)
        stack.append(near)
        self._count[tag] = self._count.get(tag, 0) + 1

    def _close_to(self, height: int, stack: list) -> None:
        while len(stack) > height:
            node = stack.pop()[0]
            self.end[node] = len(self.tokens)
            self.tokens.append(-1 - node)
            self._count[self.tag[node]] -= 1

    def _parse(self, source: str) -> None:
        stack = [[0] + [-1] * 6]
        at, n, last = 0, len(source), source.rfind(">")
        no_comment_end = False
        while at < n:
            less = source.find("<", at)
            if less < 0 or less > last:
                # no tag can end any more: an unfinished one is dropped
                rest = source[at:] if less < 0 or not _opens(source, less) else source[at:less]
                self.tokens.append(rest)
                break
            if less > at:
                self.tokens.append(source[at:less])
            follows = source[less + 1:less + 2]
            if follows in ("!", "?") or follows == "/" and not source[less + 2:less + 3].isalpha():
                if source.startswith("<!--", less) and not no_comment_end:
                    close = source.find("-->", less + 4) if not source.startswith("<!-->", less) else less + 2
                    if close < 0:
                        no_comment_end = True    # the rest is a comment up to the next >
                        close = source.find(">", less)
                        at = close + 1
                    else:
                        at = close + 3
                else:
                    at = source.find(">", less) + 1
                continue
            m = _TAG.match(source, less) if follows.isalpha() or follows == "/" else None
            if m is None:
                self.tokens.append("<")
                at = less + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if self._count.get(tag):
                    height = len(stack) - 1
                    while self.tag[stack[height][0]] != tag:
                        height -= 1
                    self._close_to(height, stack)
                continue
            attributes = m[3]
            if tag == "br":
                self.tokens.append(" ")
                continue
            if tag in VOID:
                if tag in BLOCKS:
                    self._open(tag, attributes, stack)
                    self._close_to(len(stack) - 1, stack)
                continue
            kind = self._KINDS.get(tag)
            near = stack[-1]
            closes = [near[1]] if tag in BLOCKS or tag in ("td", "th") else []
            if kind and kind > 1:
                closes.append(near[kind])
            if tag == "tr":
                closes.append(near[4])
            closes = [h for h in closes if h >= 0]
            if closes:
                self._close_to(min(closes), stack)
            self._open(tag, attributes, stack)
            if tag in RAW_TEXT:
                close = self._raw_end(source, at, tag)
                if tag not in LEFT_OUT:
                    self.tokens.append(source[at:close])
                at = close
        self._close_to(1, stack)
        self.end[0] = len(self.tokens)
        self.tokens.append(-1)

    def _raw_end(self, source: str, at: int, tag: str) -> int:
        """Where a raw element's end tag begins; without one, right here (its
        content is then read as markup)."""
        if tag in self._unended:
            return at
        m = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
        if m is None:
            self._unended.add(tag)
            return at
        return m.start()

    def blocks(self, root: int = 0) -> Iterator[tuple[int, str, int]]:
        """(node, text, linked characters) of the non-empty blocks inside
        ``root``; parts beside the article are left out.  The node is the block
        or container that the text stands in."""
        tokens, at, stop = self.tokens, self.begin[root], self.end[root]
        pieces: list[str] = []
        links: list[str] = []
        owners, linked = [root], 0
        while at < stop:
            token = tokens[at]
            if isinstance(token, str):
                pieces.append(token)
                if linked:
                    links.append(token)
                at += 1
                continue
            node = token if token >= 0 else -1 - token
            if token > 0 and self.beside[node] and node != root:
                if self.tag[node] in BLOCKS and pieces:
                    yield from self._block(owners[-1], pieces, links)
                at = self.end[node] + 1
                continue
            tag = self.tag[node]
            if tag in BLOCKS and pieces:
                yield from self._block(owners[-1], pieces, links)
            elif tag in ("td", "th"):
                pieces.append(" ")
            if token >= 0:
                if tag in BLOCKS or tag == "td":
                    owners.append(node)
                linked += tag == "a"
            else:
                if (tag in BLOCKS or tag == "td") and len(owners) > 1:
                    owners.pop()
                linked -= tag == "a" and linked > 0
            at += 1
        if pieces:
            yield from self._block(owners[-1], pieces, links)

    def _block(self, owner: int, pieces: list[str], links: list[str]):
        text = _one_line("".join(pieces))
        inside = len(_one_line("".join(links))) if links else 0
        pieces.clear()
        links.clear()
        if text:
            yield owner, text, min(inside, len(text))

    def text(self, root: int) -> str:
        return "\n".join(text for _, text, _ in self.blocks(root))

    def scores(self) -> list[int]:
        """Of every node: the characters of its blocks less their penalties."""
        out = [0] * len(self.tag)
        for node, text, linked in self.blocks():
            out[node] += len(text) - LINK_PENALTY * linked
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] += max(0, out[node])       # lists of links take nothing from the rest
        return out

    def choice(self, scores: list[int]) -> int | None:
        """The page's own container; None where no text counts."""
        if max(scores) <= 0:
            return None
        inside: dict[int, list[int]] = {}
        titled: set[int] = set()
        for node in range(1, len(self.tag)):
            if self.beside[node]:
                continue
            inside.setdefault(self.parent[node], []).append(node)
            if self.tag[node] == "h1":
                titled.add(self.parent[node])
        at = 0
        while True:
            if self.role[at] and self.tag[at] != "main":
                return at
            best = max(inside.get(at, ()), key=lambda c: (scores[c], -c), default=None)
            if (best is None or scores[best] < MOST_OF * scores[at] or scores[best] <= 0
                    or self.tag[best] not in CONTAINERS
                    or at in titled and self.tag[at] not in ("body", "html", "#root")):
                return at
            at = best

    def paths(self) -> list[str | None]:
        """The generalised path of every container (None for other nodes and
        for those inside parts left out)."""
        steps: list[str | None] = [""] * len(self.tag)
        out: list[str | None] = [None] * len(self.tag)
        out[0] = "/"
        for node in range(1, len(self.tag)):
            above = steps[self.parent[node]]
            if above is None or self.beside[node]:
                steps[node] = None
                continue
            path = f"{above}/{self.step[node]}"
            if len(path) > PATH_CHARS:
                name = hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=8).hexdigest()
                path = f"#{name}/{path[-(PATH_CHARS - 20):]}"
            steps[node] = path
            if self.tag[node] in CONTAINERS:
                out[node] = path
        return out


def _opens(source: str, at: int) -> bool:
    follows = source[at + 1:at + 2]
    return follows.isalpha() or follows in ("/", "!", "?")


def _one_line(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


def vote(source: str) -> str | None:
    """The path of the page's own container."""
    page = Page(source)
    chosen = page.choice(page.scores())
    return None if chosen is None else page.paths()[chosen]


def main_text(source: str, winning: list[str] | None) -> tuple[str, str | None, bool]:
    """(text, path, whether by the host's consensus)."""
    page = Page(source)
    scores = page.scores()
    paths = page.paths()
    at: dict[str, int] = {}
    for node, path in enumerate(paths):
        if path is not None and (path not in at or scores[node] > scores[at[path]]):
            at[path] = node
    for path in winning or ():
        if path in at:
            return page.text(at[path]), path, True
    chosen = page.choice(scores)
    return ("", None, False) if chosen is None else (page.text(chosen), paths[chosen], False)


# ---------------------------------------------------------------------- Spark
def host_of(url: Column) -> Column:
    """The url's host, lower case, without user and port; null where there is
    none (a name over 255 characters is replaced by its hash)."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@\s]+)", 1))
    return F.when(host != "", F.when(F.length(host) > 255, F.sha2(host, 256)).otherwise(host))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [vote(h) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [main_text(h, w) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()),
             pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()),
             pa.array([g[2] for g in got])], names=["page_id", "url", "text", "n_chars", "path", "consensus"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE) -> DataFrame:
    """``host, path, votes`` of every host's winning paths."""
    rows = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), text_of(F.col(f"`{html_col}`")).alias("body"))
    votes = store(rows.where("host is not null").mapInArrow(lean(_votes), "host string, path string")
                  .where("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes")))
    totals = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    return votes.join(totals, "host").where(F.col("votes") >= F.lit(share) * F.col("total")).select("host", "path", "votes")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            share: float = SHARE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars, path, consensus``."""
    # most votes first, then the path
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("minus"), F.col("path").alias("path"))))
    winners = store(host_paths(pages, url_col, html_col, share).groupBy(F.col("host").alias("of"))
                    .agg(ranked["path"].alias("winning")))      # 1 / share paths at most
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        text_of(F.col(f"`{html_col}`")).alias("body"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    if winners.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(winners), F.col("host") == F.col("of"), "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, (F.col("host") == F.col("of")) & (F.col("own") == F.col("salt")), "left")
    kind = pages.schema[id_col].dataType.simpleString()
    return (joined.select("page_id", "url", "body", "winning")
            .mapInArrow(lean(_texts), f"page_id {kind}, url string, text string, n_chars long, path string, consensus boolean"))
