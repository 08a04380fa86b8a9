"""HTML extraction by template deduction over the pages of a host.

Tokens of a page are its elements, told apart by their path (tags with class and id from the
root down), and its text blocks with their path. A token's occurrence vector says how often each
page of the host has it; tokens of a host with equal vectors form an equivalence class. Vectors
are never built: each is summed up as a 128-bit fingerprint (a random number of the page times
the count, added modulo 2^64, twice), so a host with a third of all pages costs partial sums,
not a group. A class is valid if at least ``share`` of the host's pages, and ``min_pages``, have
it; an element's parent occurs wherever it does, so valid classes nest, and together they are
the host's template.

What is left between template tokens are the slots. A page's text is its slots in article
regions (``article``, ``main``), else in the body:

* outside regions a text block that is a template token is not a slot;
* inside them a text block is template only if it shares its class with its own element, that is,
  if that element says the same on every page that has it (a strip without a name). A passage
  that only many pages repeat stands in elements that say other things elsewhere, so it stays;
  so do headings, blocks of hosts whose pages are mostly copies (under ``min_inside`` different
  ones), and all blocks of a page where such text is more than a quarter;
* elements that are furniture by kind (menus, page headers, footers, sidebars, forms, scripts,
  styles) or by a name that says nothing else (adverts, cookies, breadcrumbs) are no slots. In an
  article, names that may be the article's own words (notice, related, discussion) count only
  as a whole class name of an element that the template holds; ids, headings and inline
  elements never do.

Blocks end where block elements begin or end. Character references are decoded, white space in
a block becomes one space, ends are trimmed, blocks are joined by an empty line.

Defined cases: null or empty html, and pages without slots, give an empty text; broken or cut
markup is read as far as it goes (open elements end with the page); pages without a host share
the empty host; repeated pages count as pages; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm import common as C

# Element kinds of HTML, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr "
                   "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover semantics mstyle".split())
DROPPED = frozenset("head title script style noscript template iframe object svg canvas audio video nav aside footer "
                    "form button select option textarea input dialog menu".split())
REGION = frozenset(("article", "main"))
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup login comment comments disqus respond reply replies share sharing "
    "social side sidenav rail skip discussion related recommended recommendations widget toolbar search pagination pager banner paywall".split())
#: Of these, words that name nothing else wherever they stand.
CLEAR = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar navbar navigation "
                  "breadcrumb breadcrumbs cookie cookies consent gdpr newsletter subscribe disqus paywall pager pagination".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = frozenset("address article aside blockquote center dialog dir div dl fieldset footer form h1 h2 h3 h4 h5 h6 header "
                   "hr main menu nav ol p pre section table ul li dt dd".split())
#: First words of class names that say what an element has or is about, not what it is.
ABOUT = frozenset("no has with without is category tag type format status".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
NAMED = 2
SCOPE = frozenset("table ul ol dl body html".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


def _furniture(name: str, whole: bool, words: frozenset = FURNITURE) -> bool:
    """Does a class or id name page furniture? ``whole``: only if it is one of the words."""
    if whole:
        return name.lower() in words
    parts = [w.lower() for w in _WORDS.findall(name)]
    return bool(parts) and parts[0] not in ABOUT and not words.isdisjoint(parts)


IN_MAIN, IN_ARTICLE = 1, 2  # regions; 0: neither


class Page:
    """One reading of a page: ``paths`` (element path -> [count, parent]), and ``blocks``
    (path, in an article region?, text, in a heading?) of what is not boilerplate. ``template``:
    the host's template tokens, which confirm the names of furniture inside articles."""

    def __init__(self, source: str, template: frozenset[int] = frozenset()):
        self.paths: dict[int, list[int]] = {}
        self.blocks: list[tuple[int, bool, str, bool]] = []
        self._template = template
        self._open: list[tuple[str, int, int, int]] = []  # tag, path, dropped (NAMED: by a name only), region
        self._now: list[str] = []
        at, size = 0, len(source)
        while at < size:
            m = _TOKEN.match(source, at)
            if m is None:  # a tag with an open quote: up to its first ">"
                end = source.find(">", at)
                at = size if end < 0 else end + 1
                continue
            at = m.end()
            if m["text"] is not None:
                if not (self._open and self._open[-1][2]):
                    self._now.append(m["text"])
            elif m["tag"]:
                tag = m["tag"].lower()
                if m["end"]:
                    self._close(tag)
                else:
                    self._start(tag, m["attrs"] or "")
                    if tag in RAW and not (m["attrs"] or "").endswith("/"):
                        close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                        at = close.end() if close else size
                        self._close(tag)
        self._flush()

    def _flush(self) -> None:
        if self._now:
            text = " ".join(html.unescape("".join(self._now)).split())
            self._now = []
            if text:
                tag, path, _, region = self._open[-1] if self._open else ("", 0, 0, 0)
                self.blocks.append((path, region > 0, text, tag in HEADINGS))

    def _pop(self, n: int) -> None:
        while len(self._open) > n:
            if self._open[-1][0] not in INLINE:
                self._flush()
            self._open.pop()

    def _close(self, tag: str) -> None:
        for n in range(len(self._open) - 1, -1, -1):
            if self._open[n][0] == tag:
                self._pop(n)
                return
        if tag not in INLINE:
            self._flush()

    def _start(self, tag: str, attrs: str) -> None:
        if tag not in INLINE:
            self._flush()
        if tag == "br":
            self._now.append(" ")
        if tag in ENDS_P:
            self._end_open({"p"})
        if tag in SIBLINGS:
            self._end_open(SIBLINGS[tag])
        _, parent, dropped, region = self._open[-1] if self._open else ("", 0, 0, 0)
        classes, ids, role = self._named(attrs) if attrs else ([], [], "")
        path = _hash(parent, tag, " ".join(classes + ids))
        self.paths.setdefault(path, [0, parent])[0] += 1
        if tag in VOID or attrs.endswith("/") and tag not in INLINE and tag in RAW:
            return
        if dropped == NAMED and (tag == "main" or role == "main"):
            dropped = False  # a wrapper named for its layout (content-sidebar-wrap), no furniture
        if not dropped:
            dropped = tag in DROPPED or role in DROPPED_ROLES or tag == "header" and not region
            if not dropped and tag not in ("html", "body", "main") and role != "main":
                dropped = NAMED * self._named_furniture(tag, path, classes, ids, region)
            if tag == "article" or role == "article":
                region = IN_ARTICLE
            elif not region and (tag in REGION or role == "main"):
                region = IN_MAIN
        if dropped:
            self._flush()
        self._open.append((tag, path, dropped, region))

    def _end_open(self, tags: set[str]) -> None:
        for n in range(len(self._open) - 1, -1, -1):
            if self._open[n][0] in tags:
                self._pop(n)
                return
            if self._open[n][0] in SCOPE or self._open[n][0] in REGION:
                return

    def _named_furniture(self, tag: str, path: int, classes: list[str], ids: list[str], region: int) -> bool:
        if region != IN_ARTICLE:
            return any(_furniture(n, tag in REGION) for value in classes + ids for n in value.split())
        if tag in INLINE or tag in HEADINGS:
            return False
        names = [n for value in classes for n in value.split()]
        return any(_furniture(n, tag in REGION, CLEAR) for n in names) or path in self._template and any(
            _furniture(n, True) for n in names)

    @staticmethod
    def _named(attrs: str) -> tuple[list[str], list[str], str]:
        classes, ids, role = [], [], ""
        for name, a, b, c in _ATTR.findall(attrs):
            value = a or b or c
            if name.lower() == "role":
                role = value.strip().lower()
            else:
                (ids if name.lower() == "id" else classes).append(re.sub(r"\d+", "0", value))
        return classes, ids, role

    def text_tokens(self) -> list[tuple[int, int]]:
        """(token, element path) of the blocks."""
        return [(_hash(path, text), path) for path, _, text, _ in self.blocks]

    def content(self) -> int:
        """A number that pages of the same text share."""
        return _hash(*(text for _, _, text, _ in self.blocks))

    def text(self, template: frozenset[int], constant: frozenset[int] = frozenset()) -> str:
        """The slots, joined; ``template`` holds the host's template tokens, ``constant`` those
        texts that share their element's class."""
        inside = [(text, not heading and _hash(path, text) in constant) for path, region, text, heading in self.blocks if region]
        if not inside:
            return "\n\n".join(text for path, _, text, _ in self.blocks if _hash(path, text) not in template)
        fixed = sum(len(text) for text, same in inside if same)
        few = 4 * fixed <= sum(len(text) for text, _ in inside)
        return "\n\n".join(text for text, same in inside if not (same and few))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


ELEMENT, TEXT, CONTENT, HOST = range(4)
OCCURRENCES = "host string, token long, parent long, kind int, pages long, f1 long, f2 long"


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, parent, kind, pages, f1, f2 (fingerprint of the occurrence vector). Kinds: ELEMENT,
    TEXT (parent: its element), and with parent 0 CONTENT (a page's whole text) and HOST (token 0: the
    host's pages). ``pages``: host, ph (hash of the page), html."""
    types = C.pa_schema(pages.sparkSession, OCCURRENCES)

    def count(batches):
        for b in batches:
            sums: dict = {}
            for host, ph, source in zip(*(b.column(c).to_pylist() for c in ("host", "ph", "html"))):
                page = Page(source or "")
                tokens = {(t, parent, ELEMENT): n for t, (n, parent) in page.paths.items()}
                for t, parent in page.text_tokens():
                    tokens[t, parent, TEXT] = tokens.get((t, parent, TEXT), 0) + 1
                tokens[0, 0, HOST] = tokens[page.content(), 0, CONTENT] = 1
                r1, r2 = _hash(ph, 1) | 1, _hash(ph, 2) | 1
                for token, n in tokens.items():
                    s = sums.setdefault((host, *token), [0, 0, 0])
                    s[0] += 1
                    s[1] = (s[1] + r1 * n) & _ALL
                    s[2] = (s[2] + r2 * n) & _ALL
            keys, values = list(sums), list(sums.values())
            two = np.array([v[1:] for v in values], dtype=np.uint64).reshape(-1, 2)
            yield C.to_batch({"host": [k[0] for k in keys], "token": [k[1] for k in keys],
                              "parent": [k[2] for k in keys], "kind": [k[3] for k in keys], "pages": [v[0] for v in values],
                              "f1": np.ascontiguousarray(two[:, 0]).view(np.int64),
                              "f2": np.ascontiguousarray(two[:, 1]).view(np.int64)}, types)

    part = C.arrow_stream(pages, count, OCCURRENCES)
    # sums modulo 2^64, as 32-bit halves so that nothing overflows before 2^31 partial sums
    low, high = (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftrightunsigned(c, 32))
    sums = part.groupBy("host", "token", "parent", "kind").agg(
        F.sum("pages").alias("pages"), *(F.sum(g(c)).alias(f"{c}{n}") for c in ("f1", "f2") for n, g in (("l", low), ("h", high))))
    whole = lambda c: F.shiftleft(
        (F.col(f"{c}h") + F.shiftrightunsigned(f"{c}l", 32)).bitwiseAND(F.lit(0xFFFFFFFF)), 32
    ).bitwiseOR(F.col(f"{c}l").bitwiseAND(F.lit(0xFFFFFFFF)))
    return sums.select("host", "token", "parent", "kind", "pages", whole("f1").alias("f1"), whole("f2").alias("f2"))


_ALL = (1 << 64) - 1


def templates(pages: DataFrame, share: float, min_pages: int, min_inside: int) -> DataFrame:
    """host, host_pages, tokens (of all valid classes), constant (texts that share a class with
    their element, if the host has ``min_inside`` different pages, and as many as ``share`` of all),
    classes (pages, f1, f2, tokens, parents): the nested classes of each host that has a template. A
    valid class's tokens are on at least ``share`` of the pages, so there are at most 1 / share as
    many as a mean page has."""
    seen = C.cut(occurrences(pages))
    hosts = seen.filter(F.col("kind") == HOST).select("host", F.col("pages").alias("host_pages"))
    different = seen.filter(F.col("kind") == CONTENT).groupBy("host").agg(F.count(F.lit(1)).alias("different"))
    enough = seen.filter(F.col("kind").isin(ELEMENT, TEXT)).join(hosts, "host").filter(
        (F.col("pages") >= min_pages) & (F.col("pages") >= share * F.col("host_pages")))
    member = F.struct("token", "parent", "kind")
    classes = enough.groupBy("host", "host_pages", "pages", "f1", "f2").agg(F.sort_array(F.collect_list(member)).alias("of"))
    of = lambda kind, field: F.transform(F.filter("of", lambda m: m["kind"] == kind), lambda m: m[field])
    classes = classes.withColumn("elements", of(ELEMENT, "token"))
    same = F.filter("of", lambda m: (m["kind"] == TEXT) & F.array_contains("elements", m["parent"]))
    classes = classes.select("host", "host_pages", "pages", "f1", "f2", F.transform("of", lambda m: m["token"]).alias("tokens"),
                             F.transform(same, lambda m: m["token"]).alias("same"),
                             F.array_distinct(F.transform("of", lambda m: m["parent"])).alias("parents"))
    found = classes.groupBy("host", "host_pages").agg(
        F.flatten(F.collect_list("tokens")).alias("tokens"), F.flatten(F.collect_list("same")).alias("same"),
        F.sort_array(F.collect_list(F.struct("pages", "f1", "f2", "tokens", "parents")), asc=False).alias("classes"))
    known = (F.col("different") >= min_inside) & (F.col("different") >= share * F.col("host_pages"))
    return found.join(different, "host").select("host", "host_pages", "tokens", "classes",
                                                F.when(known, F.col("same")).otherwise(F.array()).alias("constant"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            share: float = 0.5, min_pages: int = 4, min_inside: int = 8, hot_share: int = 1024) -> DataFrame:
    """id, url, text of every page. Pages of hosts with over 1/hot_share of all pages get their
    template from a broadcast (fewer than hot_share rows); the others meet it in a join in which
    no host is large."""
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                       host_of(F.col(url_col)).alias("host"))
    found = C.cut(templates(src.select("host", F.xxhash64("id", "url", "html").alias("ph"), "html"), share, min_pages, min_inside))
    total = pages.count()
    large = F.col("host_pages") * hot_share > total
    found = found.select("host", "host_pages", F.struct("tokens", "constant").alias("of"))
    hot = F.broadcast(found.filter(large).select("host", F.col("of").alias("hot")))
    marked = src.join(hot, "host", "left")
    rest = marked.filter(F.col("hot").isNull()).join(found.filter(~large).select("host", "of"), "host", "left")
    both = marked.filter(F.col("hot").isNotNull()).select("id", "url", "html", "host", F.col("hot").alias("of")).unionByName(
        rest.select("id", "url", "html", "host", "of"))

    def fill(b: pa.RecordBatch) -> dict:
        sets: dict = {}
        out = []
        for i, (host, source) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist())):
            if host not in sets:
                of = b.column("of")[i].as_py() or {"tokens": (), "constant": ()}
                sets[host] = frozenset(of["tokens"]), frozenset(of["constant"])
            template, constant = sets[host]
            out.append(Page(source or "", template).text(template, constant))
        return {"id": b.column("id"), "url": b.column("url"), "text": out}

    kind = src.schema["id"].dataType.simpleString()
    return C.arrow_map(both, fill, f"id {kind}, url string, text string")
