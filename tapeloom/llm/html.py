"""Main text of web pages by removing site templates: element subtrees that recur across many pages of a host.

Every element's subtree is hashed; Spark counts on how many different pages of its host each hash occurs. Pages are then read again with
the hashes of theirs that recur, and those subtrees are deleted with what the markup itself names as no article: menus, footers,
forms and so on. Where a page marks its article (or main part) only that is read, and running text in it (paragraphs, headings,
lists) is never taken for a template, however often it recurs; nor is a subtree that holds half of the page's text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# An attribute value ends before the next tag at the latest, which keeps the scan linear on broken markup.
TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<[!?/a-zA-Z][^<>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w-])(hidden)(?![\w-])""")
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul br title".split()
)
#: Elements that a start tag closes if they are open and nothing of the second set lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NO_PARAGRAPH = BLOCK - {"br", "option", "title", "legend", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot"}
DROPPED = frozenset("head title nav footer aside script style noscript template iframe noembed noframes button select textarea input svg canvas object dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: The elements a start tag can close, each with what it can't reach beyond, numbered; and what opening an element does to them.
SCOPES = [({"p"}, {"table", "td", "th", "button", "object"}), *dict.fromkeys((frozenset(a), frozenset(b)) for a, b in CLOSES.values())]
SCOPE = {tag: next(k for k, (a, b) in enumerate(SCOPES) if k and a == own[0] and b == own[1]) for tag, own in CLOSES.items()}
EDGES = {"article", "body", "html"}
TOUCHED = EDGES.union(*(set(a) | set(b) for a, b in SCOPES))
#: Class names or ids, or the first or last part of them, of what is no article. They, roles and forms say nothing of a wrapper, see Page._wrappers.
NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner sidebar menu nav navbar navigation footer masthead cookie cookies consent notice popup modal newsletter subscribe share sharing social comment comments disqus related breadcrumb breadcrumbs pagination widget".split())
#: Parts that turn a name's sense, names that say nothing in first place, and what makes them say something there.
TURNED = frozenset("has no not non with without is free hide show toggle below above".split())
VAGUE, LISTED = frozenset("related share notice widget menu".split()), frozenset("posts articles stories links content items news buttons bar list area box toggle".split())
#: Elements that can be templates inside an article; all others there are running text.
PARTS = frozenset("div section figure aside header table ul ol".split())
SPARED = frozenset("html body main".split())


@lru_cache(maxsize=1 << 14)
def names(token: str) -> bool:
    """Whether a class or id names what is no article: comment-list and site-footer do, has-sidebar, ad-free and related-work don't."""
    if token in NAMES:
        return True
    parts = re.split(r"[-_]+", token.strip("-_"))
    if len(parts) < 2 or not TURNED.isdisjoint(parts):
        return False
    return parts[-1] in NAMES or parts[0] in NAMES and (parts[0] not in VAGUE or parts[-1] in LISTED)


class Page:
    """Blocks of a page's text in order, and the hash and text length of each element's subtree."""

    def __init__(self, text: str) -> None:
        #: Per element: tag, parent, whether named as no article, whether in an article, whether in a main part, hash, characters, whether hidden or by its tag no article.
        self.elements: list[list] = []
        #: Elements that only a name, a role or their being a form calls no article.
        self._soft: set[int] = set()
        self.blocks: list[tuple[int, str]] = []
        self._open: list[int] = []
        #: Per open element the depth of the nearest element of each scope that can still be closed, and how many of a tag are open.
        self._near: list[tuple[int, ...]] = []
        self._count: Counter[str] = Counter()
        self._parts: list[list[bytes]] = []
        self._text: list[str] = []
        at = 0
        while m := TAG.search(text, at):
            self._text.append(text[at: m.start()])
            at = m.end()
            if name := m[2]:
                name = name.lower()
                if m[1]:
                    self._end(name)
                else:
                    self._start(name, m[3])
                    if name in RAW:
                        stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(text, at)
                        at = stop.start() if stop else len(text)
        self._text.append(text[at:])
        while self._open:
            self._pop()
        self._flush()
        self._resolve(self._soft)
        if self._soft and (free := self._wrappers()):
            self._resolve(self._soft - free)

    def _resolve(self, soft: set[int]) -> None:
        """Sets what is named as no article, in an article and in a main part, of parents first."""
        for i, e in enumerate(self.elements):
            tag, up = e[0], e[1]
            _, _, off, article, main, _, _, _ = self.elements[up] if up >= 0 else ("", -1, False, False, False, 0, 0, False)
            if tag not in SPARED or tag == "main":
                off = off or e[7] or i in soft or (tag == "header" and not article)
            e[2:5] = off, article or (tag == "article" and not off), main or (tag == "main" and not off)

    def _wrappers(self) -> set[int]:
        """Of the soft elements, those that wrap the article: with an article or main part in them where else none is found, or that
        and over half of the page's text; or, on a page without such a part, over half of the text."""
        found, half, holds = any(e[3] or e[4] for e in self.elements), sum(len(words) for _, words in self.blocks) / 2, set()
        for i, e in enumerate(self.elements):
            if e[0] in ("article", "main"):
                while i >= 0 and i not in holds:
                    holds.add(i)
                    i = self.elements[i][1]
        return {i for i in self._soft if not self.elements[i][3] and (i in holds and not found or self.elements[i][6] > half and (i in holds or not found))}

    def _flush(self) -> None:
        if self._text:
            words = " ".join(unescape("".join(self._text)).split())
            self._text = []
            if words:
                self.blocks.append((self._open[-1] if self._open else -1, words))
                if self._parts:
                    self._parts[-1].append(words.encode("utf-8", "surrogatepass"))
                    self.elements[self._open[-1]][6] += len(words)

    def _start(self, tag: str, rest: str) -> None:
        if tag in RAW:  # what it holds is never read
            return
        if tag in BLOCK:
            self._flush()
        if tag in NO_PARAGRAPH:
            self._close(0)
        if tag in CLOSES:
            self._close(SCOPE[tag])
        if tag in VOID:
            return
        named, soft = tag in DROPPED, tag == "form"
        if rest and not named and not rest.isspace():
            for key, a, b, c, flag in ATTRIBUTE.findall(rest):
                key, value = key.lower(), (a or b or c).lower()
                named = named or bool(flag) or (key == "aria-hidden" and value == "true")
                soft = soft or (key == "role" and value in ROLES) or (key in ("class", "id") and any(map(names, value.split())))
        up = self._open[-1] if self._open else -1
        # blocks are taken to the innermost open element, so inline elements end no block but do start one
        if tag not in BLOCK and tag not in ("script", "style") and not named and not soft:
            return
        self._flush()
        if soft and not named:
            self._soft.add(len(self.elements))
        self.elements.append([tag, up, False, False, False, 0, 0, named])
        self._open.append(len(self.elements) - 1)
        near = self._near[-1] if self._near else (-1,) * len(SCOPES)
        if tag in TOUCHED:
            near = tuple(len(self._near) if tag in a else -1 if tag in b or tag in EDGES else n for (a, b), n in zip(SCOPES, near, strict=True))
        self._near.append(near)
        self._count[tag] += 1
        self._parts.append([tag.encode()])

    def _close(self, scope: int) -> None:
        """Closes the nearest element of the scope, if one is in reach."""
        if self._near and (at := self._near[-1][scope]) >= 0:
            while len(self._open) > at:
                self._pop()

    def _end(self, tag: str) -> None:
        if self._count[tag]:
            while self.elements[self._open[-1]][0] != tag:
                self._pop()
            self._pop()
        elif tag in BLOCK:
            self._flush()

    def _pop(self) -> None:
        self._flush()
        me, parts = self.elements[self._open.pop()], self._parts.pop()
        self._near.pop()
        self._count[me[0]] -= 1
        digest = xxhash.xxh64_digest(b"\0".join(parts))
        me[5] = int.from_bytes(digest, "big", signed=True)
        if self._parts:
            self._parts[-1].append(digest)
            self.elements[self._open[-1]][6] += me[6]

    def templates(self) -> set[int]:
        """Hashes of the subtrees that are deleted if they recur."""
        half = sum(len(words) for _, words in self.blocks) / 2
        return {h for tag, _, _, article, main, h, n, _ in self.elements if 0 < n < half and tag not in SPARED and tag != "article" and (tag in PARTS or not (article or main))}

    def main(self, recurring: set[int]) -> str:
        """The blocks that are left, joined by single spaces."""
        gone = recurring & self.templates() if recurring else recurring
        off = []  # parents come first
        for _, up, named, _, _, h, _, _ in self.elements:
            off.append(named or h in gone or (up >= 0 and off[up]))
        kept = [(self.elements[i] if i >= 0 else ["", -1, False, False, False, 0, 0], words) for i, words in self.blocks if i < 0 or not off[i]]
        for part in (3, 4):
            if any(e[part] for e in self.elements):
                kept = [(e, words) for e, words in kept if e[part]]
                break
        return " ".join(words for _, words in kept)


def extract(pages: DataFrame, least_pages: int = 8, least_share: float = 0.1, enough: int = 200) -> DataFrame:
    """(page_id, url, text, n_chars) of every row. A subtree recurs if on at least `least_pages` pages of the host and `least_share` of them, or on `enough`.

    Pages with the same html count as one. Null html is an empty page with empty text; pages without a host in their url share one.
    Repeated rows give repeated results; null page_ids stay; an empty table gives an empty result.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    hashes = F.pandas_udf(lambda s: s.map(lambda t: sorted(Page(t).templates())), "array<long>")
    content = F.unhex(F.substring(F.sha2("html", 256), 1, 32)).alias("content")  # half of it tells contents apart
    seen = rows.select("page_id", F.xxhash64(host).alias("host"), content, F.explode(hashes("html")).alias("tree"))
    sizes = rows.select(F.xxhash64(host).alias("host"), content).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    common = seen.select("host", "tree", "content").distinct().groupBy("host", "tree").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages).join(sizes, "host").where(F.col("n") >= F.least(least_share * F.col("pages"), F.lit(enough))).select("host", "tree")
    drop = seen.join(common, ["host", "tree"]).groupBy(F.col("page_id").alias("_id")).agg(F.collect_set("tree").alias("gone"))  # at most a page's elements
    both = rows.join(drop, F.col("page_id").eqNullSafe(F.col("_id")), "left").select("page_id", "url", "html", "gone")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [Page(h).main(set() if g is None else set(g.tolist())) for h, g in zip(b["html"], b["gone"], strict=True)]
            yield b[["page_id", "url", "text"]]

    out = both.mapInPandas(work, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
