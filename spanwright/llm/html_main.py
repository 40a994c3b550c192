"""Main text of web pages by removal of what their site repeats.

Every page is parsed once. The subtrees of its elements are hashed (tag, class, text, children), the
hashes are counted per host over all its pages, and subtrees that recur on many pages of their host
are deleted. There are three counts, by where a subtree stands:

- in what the page marks as no article text (menus, forms, advertisements, comments, by tag, role or
  class name): left out anyway, but counted, so that `n_removed` tells the site's templates;
- inside a marked article (`article`, `main` or such a role): an article that consists mostly of
  recurring subtrees is a copy of another and is no evidence, and a subtree goes if it recurs on many
  of the host's other articles. So copies of an article stay whole;
- elsewhere: a page all of which recurs is a copy and no evidence; an element that holds a marked
  article is never a template.

From what is left, the article is the narrowest of three kinds of content roots (article, main,
elements named like content) that holds at least half of the text of the widest; without one, it is
all that is left but blocks that are mostly links. A class name marks an element only if all words
of one of its names are known (`related-posts`, but not `related-work`).

Text is decoded, white space inside a block becomes one space, and blocks are joined by one
line feed. The parser takes time linear in the page, however broken or deep it is.

Verdicts meet pages by (host, hash), never by host alone, so a host may hold any share of all pages.

Defined cases: a null or empty page gives the empty text; a null url is the host ""; repeated
rows each come back (and each count as a page of their host); broken and unclosed markup is
read as browsers do roughly (an open paragraph ends at the next block). An empty table gives
an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, materialize

#: A subtree is a template if it is on so many pages of its host, and on this share of them or on
#: MANY_PAGES. An article (a page without one) is a copy if more than this share of its characters recurs.
MIN_PAGES, MIN_SHARE, MANY_PAGES, COPY_SHARE, PAGE_COPY_SHARE = 3, 0.3, 1_000, 0.5, 0.95
#: Kinds of content roots, narrowest first, and places where subtrees are counted.
ARTICLE, MAIN, NAMED = 4, 2, 1
ELSEWHERE, INSIDE, LEFT_OUT = 0, 1, 2

#: Elements that open a block of text, those without an end, those whose content is no markup,
#: those that hold no article text (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
DROPPED = frozenset(
    "head nav footer aside form script style textarea title noscript iframe noembed noframes xmp template svg math button select option datalist menu "
    "dialog object audio video canvas map label".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark what is no article text, and words that say nothing beside them (fixed values).
MARKS = frozenset(
    "ad ads adbox advert advertisement adverts advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist "
    "cookie cookies consent copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification notifications overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar tracking widget widgets".split()
)
PLAIN = frozenset(
    "a all area article articles bar block body bottom box btn button buttons col column container content desktop div fixed form global group icon icons "
    "inline inner item items left link links list main mobile module outer page panel post posts primary right row secondary section site slot sticky "
    "story text thread top unit user users reader readers view wrap wrapper zone the of and to on".split()
)
HEADINGS = frozenset("header masthead banner".split())
CONTENT = frozenset("content article entry post story articlebody maincontent main".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_MARKED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I | re.S)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_ENDS = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
#: Elements that end an open one of the same kind.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset("ul ol dl table".split())
_STOPS = _LISTS | _SIBLINGS.keys()


def marks_of(names: str, in_article: bool) -> tuple[bool, bool]:
    """Whether class names or an id mark what is no article text, and whether they name content."""
    dropped = content = False
    for name in names.split():
        words = {w for w in _WORDS.findall(_HUMP.sub(" ", name).lower()) if not w.isdigit() and w != "x"}
        marked = words & MARKS
        if in_article:  # an article has headings of its own
            marked -= HEADINGS
        if marked and words <= MARKS | PLAIN:
            dropped = True
        elif not words & MARKS and words & CONTENT:
            content = True
    return dropped, content


class _Element:
    __slots__ = ("tag", "dropped", "roots", "link", "hash", "number", "holds", "texts", "doubted")

    def __init__(self, tag: str, dropped: bool, roots: int, link: bool, mark: str, doubted: int = -1):
        self.tag, self.dropped, self.roots, self.link, self.doubted = tag, dropped, roots, link, doubted
        self.hash, self.number, self.holds, self.texts = xxhash.xxh3_64(f"{tag} {mark}"), -1, False, False


def _about(tag: str, attributes: str, inside: _Element) -> tuple[bool, bool, int, str]:
    """Whether an element is left out, whether that may be wrong (forms and class names may stand for
    a page's layout), the kinds of content roots that it lies in, and its marks."""
    in_article = inside.roots >= MAIN
    doubted = tag == "form"
    dropped = (tag in DROPPED and not doubted) or (tag == "header" and not in_article)
    roots, mark = inside.roots | (ARTICLE if tag == "article" else MAIN if tag == "main" else 0), ""
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, value in _MARKED.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                if name == "class":
                    mark += f" {value}"
                if tag not in ("body", "html"):
                    out, content = marks_of(value, in_article)
                    doubted = doubted or out
                    roots |= NAMED * content
            elif name == "role":
                value = value.lower()
                dropped = dropped or value in ROLES
                roots |= ARTICLE if value == "article" else MAIN if value == "main" else 0
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                dropped = True
            elif name == "style" and _HIDING.search(value.lower()):
                dropped = True
    return dropped, doubted and not dropped, roots, mark


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Page:
    """Blocks in page order (text, innermost element, content roots, mostly links?), elements that hold
    any, outer ones first (hash, parent, place), and hashes of subtrees that are left out.

    Forms and elements with the class names of what is no article are left out, unless they hold the article:
    where no content root is outside all of them, those around one stay; where there is none at all, a form that holds
    most of the text does, or whatever holds all of it. `spared` are their numbers.
    """

    def __init__(self, page: str, spared: set[int] | _Every = frozenset()):
        self._spared, self._elements, self.around, self.doubted_chars, self.kept_chars, self.forms = spared, 0, set(), {}, 0, set()
        self.texts, self.element, self.roots, self.links = [], [], [], []
        self.hashes, self.parents, self.places, self.left_out = [], [], [], set()
        self._stack = [_Element("", False, 0, False, "")]
        self._open: dict[str, int] = {}
        self._blocks: list[int] = []  # where block elements stand in the stack
        self._stops: list[int] = []  # where lists and their items do
        self._held: list[str] = []
        self._linked = 0
        self._parse(page)
        del self._stack, self._open, self._blocks, self._stops, self._held

    def _text(self, raw: str) -> None:
        top, words = self._stack[-1], raw.strip()
        if words:
            top.hash.update(words)
            top.texts = True
        if top.dropped:
            if top.doubted >= 0 and top.tag not in RAW:
                self.doubted_chars[top.doubted] = self.doubted_chars.get(top.doubted, 0) + len(words)
        else:
            self.kept_chars += len(words)
            self._held.append(raw)
            if top.link:
                self._linked += len(words)

    def _number(self, e: int) -> int:
        """The number of the stack's element `e`; outer ones get theirs first."""
        stack, first = self._stack, e
        while first > 0 and stack[first - 1].number < 0:
            first -= 1
        for i in range(first, e + 1):
            if stack[i].number < 0:
                stack[i].number = len(self.hashes)
                self.hashes.append(0)
                self.parents.append(stack[i - 1].number if i else -1)
                self.places.append(-1)
        return stack[e].number

    def _flush(self) -> None:
        held = self._held
        if held:
            words = " ".join(html.unescape("".join(held)).split())
            if words:
                top = self._stack[-1]
                self.element.append(self._number(len(self._stack) - 1))
                self.texts.append(words)
                self.roots.append(top.roots)
                self.links.append(2 * self._linked > sum(len(x.strip()) for x in held))
                top.holds = top.holds or top.roots >= MAIN
            held.clear()
        self._linked = 0

    def _push(self, element: _Element) -> None:
        tag, at = element.tag, len(self._stack)
        self._stack.append(element)
        self._open[tag] = self._open.get(tag, 0) + 1
        if tag in BLOCKS:
            self._blocks.append(at)
        if tag in _STOPS:
            self._stops.append(at)

    def _close(self) -> None:
        done = self._stack.pop()
        above, at = self._stack[-1], len(self._stack)
        self._open[done.tag] -= 1
        if self._blocks and self._blocks[-1] == at:
            self._blocks.pop()
        if self._stops and self._stops[-1] == at:
            self._stops.pop()
        value = done.hash.intdigest()
        above.hash.update(value.to_bytes(8, "little"))
        above.holds = above.holds or done.holds
        above.texts = above.texts or (done.texts and done.tag not in RAW)
        if done.dropped:
            if not above.dropped and done.texts and done.tag not in RAW and done.tag != "head":
                self.left_out.add(_signed(value ^ LEFT_OUT))
        elif done.number >= 0 and done.tag not in ("html", "body"):
            inside = done.roots >= MAIN
            if above.roots >= MAIN if inside else not done.holds:  # an article and what holds it are no parts of it
                self.places[done.number] = INSIDE if inside else ELSEWHERE
                self.hashes[done.number] = _signed(value ^ self.places[done.number])

    def _parse(self, page: str) -> None:
        stack, size, at = self._stack, len(page), 0
        last, quoted = page.rfind(">"), True
        while True:
            tag_at = page.find("<", at)
            comment = page.startswith("<!--", tag_at) if tag_at >= 0 else False
            if tag_at < 0 or (tag_at > last and not comment):
                break
            if tag_at > at:
                self._text(page[at:tag_at])
            if comment:
                end = page.find("-->", tag_at + 2)
                at = end + 3 if end >= 0 else size
                continue
            m = _NAME.match(page, tag_at)
            if m is None:
                if page[tag_at + 1] in "!?/":
                    at = page.find(">", tag_at) + 1
                else:
                    self._text("<")
                    at = tag_at + 1
                continue
            rest = _REST.match(page, m.end()) if quoted else None
            if rest:
                attributes, at = rest[1], rest.end()
            else:  # a quote that never ends: from here on tags end at the next bracket
                quoted = False
                end = page.find(">", m.end())
                attributes, at = page[m.end() : end], end + 1
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            if tag in BLOCKS:
                self._flush()
                if tag != "body" and self._blocks and stack[self._blocks[-1]].tag == "p":
                    self._close_to(self._blocks[-1])
            if tag in _SIBLINGS:
                for i in reversed(self._stops):
                    if stack[i].tag in _LISTS:
                        break
                    if stack[i].tag in _SIBLINGS[tag]:
                        self._flush()
                        self._close_to(i)
                        break
            if tag in VOID:
                if tag in ("br", "hr"):
                    self._text(" ")
                continue
            top = stack[-1]
            dropped, doubted, roots, mark = _about(tag, attributes, top)
            self._elements += 1
            doubted = doubted and self._elements not in self._spared
            if tag == "form":
                self.forms.add(self._elements)
            within = -1 if dropped else top.doubted if top.dropped else self._elements if doubted else -1
            self._push(_Element(tag, dropped or doubted or top.dropped, roots, top.link or tag == "a", mark, within))
            if within >= 0 and roots >= MAIN and roots & ~NAMED and not (top.roots & ~NAMED and top.dropped):
                self.around.add(within)
            if attributes.endswith("/") and tag in ("svg", "math", "path"):
                self._close()
            elif tag in RAW:
                found = _ENDS[tag].search(page, at)
                self._text(page[at : found.start() if found else size])
                end = page.find(">", found.end()) if found else -1
                at = end + 1 if end >= 0 else size
                self._close()
        if at < size:
            self._text(page[at:])
        self._flush()
        self._close_to(1)

    def _close_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._close()

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if not self._open.get(tag):
            return
        stack, depth = self._stack, len(self._stack) - 1
        while stack[depth].tag != tag:
            depth -= 1
        if self._blocks and self._blocks[-1] >= depth:
            self._flush()
        self._close_to(depth)


class _Every:
    def __contains__(self, number: int) -> bool:
        return True


def read_page(page: str) -> Page:
    """A page whose article isn't left out with what it lies in; behind three such layers all of them stay."""
    spared: set[int] = set()
    for _ in range(3):
        own = Page(page, spared)
        rooted = any(r & (ARTICLE | MAIN) for r in own.roots)
        most = max(own.doubted_chars, key=lambda k: (own.doubted_chars[k], -k), default=-1)
        if not rooted and own.around:
            spared |= own.around
        elif not rooted and own.doubted_chars.get(most, 0) > own.kept_chars * (most in own.forms or 1 << 60):
            spared.add(most)
        else:
            return own
    return Page(page, _Every())


def dead_elements(hashes: list[int], parents: list[int], places: list[int], templates: set[int]) -> list[bool]:
    """Whether each element is a template or lies in one."""
    dead: list[bool] = []
    for h, up, place in zip(hashes, parents, places, strict=True):
        dead.append((place >= 0 and h in templates) or (up >= 0 and dead[up]))
    return dead


def article_of(texts: list[str], roots: list[int], links: list[bool], alive: list[bool]) -> str:
    """The blocks of the narrowest kind of content root that holds half of the text of the widest, or all but links."""
    chars = {kind: sum(len(t) for t, r, a in zip(texts, roots, alive, strict=True) if a and r & kind) for kind in (ARTICLE, MAIN, NAMED)}
    widest = max(chars.values())
    chosen = next((kind for kind, n in chars.items() if n and 2 * n >= widest), 0)
    rows = zip(texts, roots, links, alive, strict=True)
    return "\n".join(t for t, r, link, a in rows if a and (r & chosen if chosen else not link))


#: Pages that are parsed or written at a time.
_ROWS = 200
_PARSED = "row long, texts array<string>, element array<int>, roots array<int>, links array<boolean>, hashes array<long>, parents array<int>, places array<int>, found array<array<long>>"
_TYPES = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64()))]
_FIELDS = ["row", "texts", "element", "roots", "links", "hashes", "parents", "places", "found"]


def parsed(pages: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """key, url, the fields of Page by row, and found: its distinct hashes by place."""
    schema = pages.select(key, url).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                rows = []
                for x in part.column(2):
                    p = read_page(x.as_py() or "")
                    found = [list({h for h, at in zip(p.hashes, p.places, strict=True) if at == place}) for place in (ELSEWHERE, INSIDE)]
                    rows.append((row, p.texts, p.element, p.roots, p.links, p.hashes, p.parents, p.places, [*found, list(p.left_out)]))
                    row += 1
                arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=[key, url, *_FIELDS])

    return pages.select(key, url, text).mapInArrow(run, f"{fields}, {_PARSED}")


def site_templates(found: DataFrame, pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many: int = MANY_PAGES) -> DataFrame:
    """host, hash of the subtrees (found: host, place, hash, once a page) that recur on `min_pages` of the host's
    pages and on `min_share` of those that have the place (pages: host, place) or on `many`; what pages mark
    themselves as no article needs `min_pages` only."""
    counted = found.groupBy("host", "hash", "place").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    sizes = pages.groupBy("host", "place").agg(F.count("*").alias("pages"))
    enough = (F.col("place") == LEFT_OUT) | (F.col("n") >= F.least(min_share * F.col("pages"), F.lit(float(many))))
    return attach(counted, sizes, ["host", "place"], "inner").where(enough).select("host", "hash")


def _meet(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """`rows` with templates: the hashes of `hits` (row, hash) of each; broadcast only if the hashes are few."""
    few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = hits.groupBy("row").agg(F.collect_list("hash").alias("templates"))
    return rows.join(F.broadcast(own) if few else own, "row", "left")


def _copies(batches):
    """row, copy of every page: whether its article, or the page if it marks none, is mostly templates."""
    for batch in batches:
        rows, copy = batch.column("row"), []
        columns = [batch.column(c).to_pylist() for c in ("element", "roots", "sizes", "hashes", "parents", "places", "templates")]
        for element, roots, sizes, hashes, parents, places, templates in zip(*columns, strict=True):
            dead = dead_elements(hashes, parents, places, set(templates or ()))
            marked = any(r >= MAIN for r in roots)
            own = [(n, dead[e]) for e, r, n in zip(element, roots, sizes, strict=True) if r >= MAIN or not marked]
            total, gone = sum(n for n, _ in own), sum(n for n, d in own if d)
            copy.append(bool(gone) and gone > (COPY_SHARE if marked else PAGE_COPY_SHARE) * total)
        yield pa.RecordBatch.from_arrays([rows, pa.array(copy, pa.bool_())], names=["row", "copy"])


def _written(key: str, url: str):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                texts, removed = [], []
                columns = [part.column(c).to_pylist() for c in ("texts", "element", "roots", "links", "hashes", "parents", "places", "left_out", "templates")]
                for words, element, roots, links, hashes, parents, places, left_out, templates in zip(*columns, strict=True):
                    templates = set(templates or ())
                    dead = dead_elements(hashes, parents, places, templates)
                    alive = [not dead[e] for e in element]
                    texts.append(article_of(words, roots, links, alive))
                    removed.append(len(alive) - sum(alive) + len(templates.intersection(left_out)))
                arrays = [part.column(key), part.column(url), pa.array(texts, pa.string()), pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["__key", "__url", "text", "n_removed"])

    return run


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """key, url, text, n_chars, n_removed (blocks, and subtrees left out, that are templates of their site) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("__url"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.col(text).alias("__html"))
    blocks = materialize(parsed(own, "__key", "__url", "__html").withColumn("host", F.xxhash64(host)), "blocks")
    places = blocks.select("row", "host", F.posexplode("found").alias("place", "hashes")).where(F.size("hashes") > 0)
    found = places.select("row", "host", "place", F.explode("hashes").alias("hash"))

    # Subtrees that recur at all, then without the evidence of copies.
    often = materialize(site_templates(found, places), "recurring")
    hits = materialize(attach(found, often, ["host", "hash"], "inner").select("row", "host", "place", "hash"), "hits")
    sizes = F.transform("texts", lambda t: F.length(t)).alias("sizes")
    narrow = blocks.select("row", "element", "roots", sizes, "hashes", "parents", "places")
    copies = _meet(narrow, hits.where(F.col("place") != LEFT_OUT).select("row", "hash")).mapInArrow(_copies, "row long, copy boolean").where("copy").select("row")
    copies = materialize(copies, "copies")
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    counts = lambda df: df.where(F.col("place") == LEFT_OUT).unionByName(df.where(F.col("place") != LEFT_OUT).join(F.broadcast(copies) if few else copies, "row", "left_anti"))
    templates = materialize(site_templates(counts(hits), counts(places.drop("hashes"))), "templates")
    hits = materialize(attach(hits, templates, ["host", "hash"], "inner").select("row", "hash"), "template_hits")
    wide = blocks.select("__key", "__url", "row", "texts", "element", "roots", "links", "hashes", "parents", "places", F.get("found", F.lit(LEFT_OUT)).alias("left_out"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select("__key", "__url").schema)
    out = _meet(wide, hits).mapInArrow(_written("__key", "__url"), f"{kinds}, text string, n_removed long")
    return out.select(F.col("__key").alias(key), F.col("__url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "n_removed")


def op8_site_template(spark, sf_dir):
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
