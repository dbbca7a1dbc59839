"""Main text of web pages by consensus of their host.

Each page's containers are scored by the text of their blocks, and the best one votes
for its path: the names and classes of the elements around it, numbers left out.  Votes
are counted per host.  Pages are then extracted again with the paths that their host
has chosen, in order of votes; a page that has text under none of them is extracted
with its own best path.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarframe.llm.shared import named, settle, table
from sonarframe.llm.url_filters import host

#: Paths that at least this share of a host's pages vote for are its own.
SHARE = 0.05
#: Hosts' paths that are broadcast (a path has 801 characters at most); more are joined.
MOST_PATHS = 1 << 14
_LONGEST_PATH = 400
#: An element is left out unless an article begins in it, or in any case.
SOFT, HARD = 1, 2

# Names of elements by what they mean to an extraction (from the HTML standard).
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav noscript ol optgroup option p plaintext pre search section select summary table tbody td template tfoot th thead tr ul".split())
DROPPED = frozenset("aside audio button canvas datalist dialog fieldset footer form head iframe input label map menu meter nav noembed noframes noscript object optgroup option output progress script search select style svg template textarea title video xmp".split())
LEAF = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose end tag may be left out: what they're closed by, and where that search ends.
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Words in classes, ids and roles of what isn't the article.
OTHER = frozenset("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disclaimer discussion disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar trending widget widgets".split())
#: Words in classes, ids and roles of what holds the article, and beginnings that only say what an element has.
OWN = frozenset("article articlebody content entry main post story".split())
STATES = frozenset("category format has is no not status tag type with without".split())

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']*)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _tag_end(page: str, at: int) -> int:
    """The place of the ``>`` that ends the tag at ``at``, quoted values left out; -1 if there is none."""
    end = page.find(">", at)
    while end >= 0:
        quote = min((q for q in (page.find('="', at, end), page.find("='", at, end)) if q >= 0), default=-1)
        if quote < 0:
            return end
        close = page.find(page[quote + 1], quote + 2)
        if close < 0:
            return end
        at = close + 1
        if at > end:
            end = page.find(">", at)
    return -1


def _events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): "text" with the text, "open" and "close" with name and attributes.  Each character is passed once."""
    at, n, raw_end = 0, len(page), {}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            if end < 0:
                return  # the rest is a comment
            at = end + 3
            continue
        if after in ("!", "?"):
            end = page.find(">", lt)
            if end < 0:
                return
            at = end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            yield "text", "", "<"
            at = lt + 1
            continue
        end, name = _tag_end(page, m.end()), m[1].lower()
        if end < 0:
            return  # an unfinished tag
        at = end + 1
        if after == "/":
            yield "close", name, ""
            continue
        yield "open", name, page[m.end() : end]
        if name in RAW and not page.startswith("/>", end - 1):
            close = raw_end.setdefault(name, re.compile(rf"</{name}(?=[\s/>])", re.I)).search(page, at)
            if not close:
                return
            at = close.start()


class _Element:
    """An open element.  dropped: 0, SOFT (a form, which may hold the whole page) or HARD; article: path of the article around it;
    tagged: whether that is an ``article`` element; under: those of the wanted paths that are around it or its own."""

    __slots__ = ("article", "dropped", "header", "holder", "name", "parent", "path", "tagged", "under")

    def __init__(self, name: str, path: str, parent: _Element | None, wanted: frozenset[str]):
        self.name, self.path, self.parent = name, path, parent
        self.dropped, self.article, self.tagged, self.header, self.under = (parent.dropped, parent.article, parent.tagged, False, parent.under) if parent else (0, None, False, False, ())
        if path in wanted and path not in self.under:
            self.under = (*self.under, path)
        self.holder = parent.holder if parent and name in LEAF else self  # whose block its text is


def _attributes(said: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(said)} if said else {}


def _marks(name: str, attributes: dict[str, str]) -> tuple[bool, bool, bool]:
    """Whether classes, id or role say that an element isn't the article, that it is, or that it's a header."""
    other = own = header = False
    for label in " ".join(attributes.get(k, "") for k in ("class", "id", "role", "itemprop")).split():
        words = [w.lower() for w in _WORD.findall(label)]
        if words and words[0] not in STATES:
            other |= words[0] in OTHER or name != "article" and words[-1] in OTHER
            own |= words[-1] in OWN or words[0] in OWN and words[-1] in ("body", "text", "wrapper", "container", "inner")
            header |= words[-1] in ("header", "banner")
    return other, own and not other, header


def _entered(top: _Element, name: str, attributes: dict[str, str], wanted: frozenset[str]) -> _Element:
    """The element that begins within ``top``."""
    other, own, header = _marks(name, attributes) if attributes else (False, False, False)
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
    step = ".".join([name, *sorted({_DIGITS.sub("#", c)[:100] for c in attributes.get("class", "").split()})])[:_LONGEST_PATH]
    above = top.path if len(top.path) < _LONGEST_PATH else "#" + hashlib.blake2b(top.path.encode(), digest_size=16).hexdigest()
    at = _Element(name, f"{above}/{step}", top, wanted)
    header = (header or name == "header") and name not in HEADINGS
    whole = name in ("html", "body", "main")
    if at.dropped == SOFT and (name in ("article", "main") or own):
        at.dropped = 0
    if hidden or not whole and (name in DROPPED or other or header and top.article is None):
        at.dropped = max(at.dropped, SOFT if name in ("form", "fieldset") and not hidden else HARD)
    if header and top.article is not None and name not in DROPPED and not hidden and not top.dropped:
        at.dropped, at.header = 0, True  # an article's own header: its headings stay
    elif top.header and name not in HEADINGS:
        at.header = True
        if name in LEAF or name not in BLOCK:
            at.dropped = HARD
    if not at.dropped and (name == "article" and not at.tagged or at.article is None and own and not whole and name not in LEAF):
        at.article, at.tagged = at.path, name == "article"
    return at


class _Page:
    """Walks a page's elements; ``blocks`` gives each block of text outside of menus, adverts and the like."""

    def __init__(self, page: str, wanted: frozenset[str] = frozenset()):
        self.page, self.wanted = page, wanted
        self.root = self.top = _Element("", "", None, wanted)
        self.open: dict[str, int] = {}
        self.pieces: list[str] = []
        self.linked = self.link = 0

    def _pop(self, to: _Element) -> None:
        """Close the innermost elements up to ``to``, it included."""
        while True:
            closed = self.top
            self.open[closed.name] -= 1
            self.top = closed.parent
            if closed is to:
                return

    def _innermost(self, names, until=()) -> _Element | None:
        at = self.top
        while at is not self.root and at.name not in names:
            if at.name in until:
                return None
            at = at.parent
        return None if at is self.root else at

    def _taken(self) -> tuple[_Element, str, int] | None:
        """The block that ends here."""
        text, linked = " ".join("".join(self.pieces).split()), self.linked
        self.pieces, self.linked, self.link = [], 0, 0
        return (self.top, text, min(linked, len(text))) if text else None

    def _close_before(self, name: str) -> None:
        """Close what may lack its end tag when ``name`` begins."""
        if self.top.name == "head" and name not in ("noscript", "template", *RAW):
            self._pop(self.top)
        if self.open.get("p") and name != "option":
            p = self._innermost({"p"}, BLOCK - {"p"})
            if p:
                self._pop(p)
        names, until = ENDED_BY.get(name, ((), ()))
        if any(self.open.get(x) for x in names):
            found = self._innermost(names, until)
            if found:
                self._pop(found)
                if self.top.name in names:  # a row with its last cell
                    self._pop(self.top)

    def blocks(self) -> Iterator[tuple[_Element, str, int]]:
        """(element, text, characters in links) of each block in page order."""
        for kind, name, said in _events(self.page):
            if kind == "text":
                if not self.top.dropped and not (self.top.header and self.top.name not in HEADINGS):
                    text = html.unescape(said)
                    self.pieces.append(text)
                    self.linked += len(text.strip()) if self.link else 0
                continue
            if name == "br":
                self.pieces.append(" ")
                continue
            if name in BLOCK:
                block = self._taken() if self.pieces else None
                if block:
                    yield block
            if kind == "open":
                attributes = _attributes(said) if said.strip(" /") else {}
                if name in BLOCK:
                    self._close_before(name)
                elif name == "a" and "href" in attributes:
                    self.link += 1
                if name in VOID:
                    continue
                if name in BLOCK or name in DROPPED:
                    self._enter(_entered(self.top, name, attributes, self.wanted))
                elif attributes and name != "a":
                    inline = _entered(self.top, name, attributes, self.wanted)
                    if inline.dropped > self.top.dropped:
                        self._enter(inline)
            else:
                if name == "a":
                    self.link = max(0, self.link - 1)
                if self.open.get(name):
                    self._pop(self._innermost({name}))
        block = self._taken()
        if block:
            yield block

    def _enter(self, element: _Element) -> None:
        self.top = element
        self.open[element.name] = self.open.get(element.name, 0) + 1


def best_path(page: str | None) -> tuple[str, float] | None:
    """Path and score of a page's best container, or None without text.

    A block's text counts for the container it stands in, half for the one around that,
    and so on; what's linked counts against it.  Within an article the article is meant.
    """
    scores: dict[str, float] = {}
    article_of: dict[str, str] = {}
    for e, text, linked in _Page(page or "").blocks():
        weight, at = float(max(0, len(text) - 3 * linked)), e.holder
        if e.article:
            article_of.setdefault(e.holder.path, e.article)
        while at is not None and weight >= 1:
            scores[at.path] = scores.get(at.path, 0.0) + weight
            weight, at = weight / 2, at.parent
    if not scores:
        return None
    path = min(scores, key=lambda p: (-scores[p], -len(p), p))
    return article_of.get(path, path), scores[path]


def extract(page: str | None, paths: list[str]) -> str:
    """The blocks under the first of ``paths`` that has text, else under the page's best path, joined by empty lines."""

    def under(paths: list[str]) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for e, text, _ in _Page(page or "", frozenset(paths)).blocks():
            for path in e.under:
                found.setdefault(path, []).append(text)
        return found

    found = under(paths)
    path = next((p for p in paths if p in found), None)
    if path is None:
        best = best_path(page)
        if best is None:
            return ""
        path, found = best[0], under([best[0]])
    return "\n\n".join(found[path])


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, score): each page's vote; pages without text don't vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_path(p.as_py()) for p in batch.column("html")]
            voted = pa.array([f is not None for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("host").filter(voted), pa.array([f[0] for f in found if f], pa.string()), pa.array([f[1] for f in found if f], pa.float64())], ["host", "path", "score"])

    return pages.select(host(named(url_col)).alias("host"), named(html_col).cast("string").alias("html")).mapInArrow(run, "host string, path string, score double")


def winners(votes: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the paths of a host with at least ``share`` of its votes, 1 / share at most, by votes, then by score."""
    counts = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    total = counts.groupBy("host").agg(F.sum("n").alias("pages"))
    chosen = counts.join(total, "host").where(F.col("n") >= share * F.col("pages"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.round("score")).alias("score"), "path")))
    return chosen.groupBy("host").agg(F.transform(order, lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, most_paths: int = MOST_PATHS) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null, empty or textless page has the text ''.  Pages without a host vote together
    under the empty one.  Repeated rows each have a row and a vote; an empty table gives
    no rows; other columns are ignored.  A very long page is one value of a column: each
    character is passed a fixed number of times.  Ties of votes go to the higher score,
    then to the lesser path.  Up to ``most_paths`` hosts' paths are broadcast; more are joined, with the same result.
    """
    settle(pages.sparkSession)
    chosen = table(winners(table(votes(pages, url_col, html_col), "votes"), share), "paths")
    wanted = pages.select(named(id_col).alias("page_id"), named(url_col).alias("url"), named(html_col).cast("string").alias("html"), host(named(url_col)).alias("at_host"))
    few = chosen.agg(F.coalesce(F.sum(F.size("paths")), F.lit(0))).first()[0] <= most_paths
    wanted = wanted.join(F.broadcast(chosen) if few else chosen, F.col("at_host") == F.col("host"), "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), paths.as_py() or []) for p, paths in zip(batch.column("html"), batch.column("paths"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(wanted.dtypes)
    return wanted.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
