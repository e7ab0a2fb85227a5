"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from one template. A page is a sequence of tokens: the
beginnings and ends of block elements, told apart by their place in the page,
and the texts between them. Tokens that occur equally often on the same pages of
a host - that share an occurrence vector - form an equivalence class. A class is
valid on a page where its tokens stand, round by round, in the one order that
they have on the host; classes nest into a template where each lies in one gap
of another. The gaps that remain are slots. The host's text in the slots decides
which element of the template is the article, on every page of the host.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, steps, unused

#: Share of a host's pages that a template token must be on; and pages, at least, to call a text the template's.
SUPPORT, MIN_PAGES = 0.6, 3
#: Share of an element's text that one within it must hold to be the article in its place.
MOST = 0.7
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)>?", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas", "xmp", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = _BLOCK - {"br", "html", "head", "body", "title", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend"}
_HEAD = {"title", "meta", "link", "base", "html", *_RAW}
#: Elements that hold other elements: the article is one of them. Elements that hold text.
_HOLDERS = {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td"}
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption"}
_CONTENT = {"article", "main"}
#: Elements whose text is no article's, wherever they stand.
_OUT = {"head", "title", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "fieldset", "legend", *_RAW}
#: Names that say what else a page puts into slots. They weigh in slots of elements that hold other elements, never in prose, and rule no element that holds most of the article.
_LABELS = set("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice newsletter subscribe sidebar nav navbar navigation menu breadcrumb breadcrumbs related recommended trending share sharing comment comments disqus respond masthead header footer popup modal".split())
_LABELLED = _HOLDERS | {"ul", "ol", "dl", "header"}
PAGE, BLOCK, HOLDER, CONTENT, END, TEXT = range(6)
_COLUMNS = ("token", "kind", "parent", "n", "vector", "total", "place", "mass", "own")


class Block:
    """Text between two block boundaries: its element, how many tokens precede it, and how much of it is link text."""

    __slots__ = ("element", "at", "parts", "linked")

    def __init__(self, element: int, at: int):
        self.element, self.at, self.parts, self.linked = element, at, [], 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Element:
    """A block element: its token, its parent's number, its kind, and whether it has a label or lies in an article or in something labelled."""

    __slots__ = ("token", "parent", "kind", "tag", "label", "content", "shady", "mass", "own")

    def __init__(self, token: int, parent: int, tag: str, label: bool, within: Element | None):
        self.token, self.parent, self.tag, self.label, self.mass, self.own = token, parent, tag, label, 0, 0
        self.content = tag in _CONTENT or within is not None and within.content
        self.shady = label or within is not None and within.shady
        self.kind = CONTENT if tag in _CONTENT else HOLDER if tag in _HOLDERS else BLOCK

    def weight(self) -> int:
        """What a character counts: article elements speak for their text, labels against it."""
        return (32 if self.content else 4) // (4 if self.shady else 1)


class Page:
    """tokens: (token, number of its element, whether it is the element's end); blocks; elements."""

    __slots__ = ("tokens", "blocks", "elements")

    def __init__(self):
        self.tokens: list[tuple[int, int, bool]] = []
        self.blocks: list[Block] = [Block(-1, 0)]
        self.elements: list[Element] = []


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@lru_cache(200_000)
def _inside(parent: int, mark: str) -> int:
    """The token of an element: a hash of its parent's and of its own tag and names."""
    return _hash(f"{parent}/{mark}")


@lru_cache(200_000)
def _end(token: int) -> int:
    return _hash(f"/{token}")


@lru_cache(50_000)
def _names(attributes: str) -> tuple[str, bool, bool]:
    """(the names that tell an element's role, whether one is a label, whether it is hidden)."""
    names, label, hidden = [], False, False
    for hit in _ATTRIBUTE.finditer(attributes):
        kind, value = hit[1].lower(), (hit[2] or "").strip("\"'").lower()
        if kind in ("class", "id", "role"):
            names.append(value)
            label |= any(w in _LABELS for w in re.split(r"[^a-z]+", value))
        elif kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return ".".join(names), label, hidden


def tokenise(html: str) -> Page:
    """Tokens, texts and elements of a page. Unclosed and stray tags are tolerated; what is open at the end ends there. Texts outside any article are left out."""
    page = Page()
    tokens, blocks, elements = page.tokens, page.blocks, page.elements
    stack: list[tuple[str, int, bool, bool]] = []  # tag, its or its parent's element, outside, in a link
    opened: Counter[str] = Counter()
    at, n = 0, len(html)

    def fresh() -> None:
        element = stack[-1][1] if stack else -1
        if blocks[-1].parts:
            blocks.append(Block(element, len(tokens)))
        else:
            blocks[-1].element, blocks[-1].at = element, len(tokens)

    def shut(depth: int) -> None:
        while len(stack) > depth:
            tag, element, *_ = stack.pop()
            opened[tag] -= 1
            if tag in _BLOCK:
                tokens.append((_end(elements[element].token), element, True))
        fresh()

    def say(raw: str) -> None:
        if raw and not (stack and stack[-1][2]):
            text = unescape(raw)
            blocks[-1].parts.append(text)
            if stack and stack[-1][3]:
                blocks[-1].linked += len(text)

    while at < n:
        hit = _TOKEN.search(html, at)
        if hit is None:
            say(html[at:])
            break
        say(html[at : hit.start()])
        at = hit.end()
        tag = (hit[2] or "").lower()
        if not tag:
            continue
        if hit[1]:
            if opened[tag]:
                if tag in _BLOCK:
                    shut(max(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag) if stack[-1][0] != tag else len(stack) - 1)
                elif stack[-1][0] == tag:
                    opened[tag] -= 1
                    stack.pop()
            continue
        if opened["head"] and tag not in _HEAD and tag in _BLOCK:
            shut(next(i for i, x in enumerate(stack) if x[0] == "head"))
        if tag in _CLOSES or tag in _ENDS_P:
            ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    shut(i)
                    if "tr" not in ends and "td" not in ends:
                        break
                elif stack[i][0] in _BLOCK:
                    break
        if tag in _RAW and not hit[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag == "br" or tag == "hr":
            fresh()
            continue
        if tag in _VOID or hit[3].endswith("/"):
            continue
        names, label, hidden = _names(hit[3]) if hit[3] else ("", False, False)
        _, within, out, link = stack[-1] if stack else ("", -1, False, False)
        out = out or tag in _OUT or hidden and tag not in ("html", "body")
        opened[tag] += 1
        if tag not in _BLOCK:
            stack.append((tag, within, out, link or tag == "a"))
            continue
        around = elements[within] if within >= 0 else None
        token = _inside(around.token if around else 0, f"{tag}.{names}" if names else tag)
        elements.append(Element(token, within, tag, label and tag in _LABELLED and tag not in ("html", "body"), around))
        # a header between article and page is the page's
        out = out or tag == "header" and not elements[-1].content
        tokens.append((token, len(elements) - 1, False))
        stack.append((tag, len(elements) - 1, out, link))
        fresh()
    shut(0)
    for block in blocks:
        if block.parts and block.element >= 0:
            own = elements[block.element]
            own.own += max(0, len(block.text()) - block.linked) * own.weight()
    for own in reversed(elements):
        own.mass += own.own
        if own.parent >= 0:
            elements[own.parent].mass += own.mass
    return page


def _row(kind: int, parent: int) -> list[int]:
    return [kind, parent, 0, 0, 0, 0]  # then: occurrences, first place, mass, own mass


def occurrences(html: str) -> dict[int, list[int]]:
    """Each token of a page: kind, parent token, occurrences, first place, mass of the text within, own mass. Token 0 stands for the page."""
    page = tokenise(html)
    out = {0: [PAGE, 0, 1, 0, 0, 0]}
    for place, (token, element, end) in enumerate(page.tokens):
        own = page.elements[element]
        row = out.get(token)
        if row is None:
            parent = own.token if end else page.elements[own.parent].token if own.parent >= 0 else 0
            row = out[token] = _row(END if end else own.kind, parent)
            row[3] = place
        row[2] += 1
        if not end:
            row[4] += own.mass
            row[5] += own.own
    for block in page.blocks:
        if text := block.text():
            own = page.elements[block.element] if block.element >= 0 else None
            path = own.token if own else 0
            mass = max(0, len(text) - block.linked) * (own.weight() if own else 4)
            row = out.setdefault(_hash(f"{path}|{text}"), _row(TEXT, path))
            row[2] += 1
            row[4] += mass
            if not own or own.parent < 0:
                out[0][4] += 0 if own else mass
    out[0][4] += sum(x.mass for x in page.elements if x.parent < 0)
    return out


def gather(pages: Iterable[tuple[object, object, str]]) -> dict[tuple, list[int]]:
    """Rows of (host, token) over (host, page key, html): kind, parent, pages, vector, occurrences, places, mass, own mass.

    The occurrence vector is known by a sum over pages of the hash of page and count.
    """
    out: dict[tuple, list[int]] = {}
    for host, key, html in pages:
        for token, (kind, parent, n, place, mass, own) in occurrences(html).items():
            row = out.get((host, token))
            if row is None:
                row = out[host, token] = [kind, parent, 0, 0, 0, 0, 0, 0]
            row[2] += 1
            row[3] += _hash(f"{key}|{n}") >> 20  # 44 bits: sums stay exact
            row[4] += n
            row[5] += place
            row[6] += mass
            row[7] += own
    return out


class Template:
    """A host's template, from its frequent tokens: rows of _COLUMNS, the page's own row included."""

    def __init__(self, rows: Iterable[tuple]):
        rows = [dict(zip(_COLUMNS, r)) for r in rows]
        self.tags = {r["token"]: r for r in rows if r["kind"] in (BLOCK, HOLDER, CONTENT)}
        found = defaultdict(list)
        for r in rows:
            if r["kind"] not in (PAGE, TEXT):
                found[r["n"], r["vector"]].append(r)
        #: Classes of two tokens or more, each in its one order.
        self.classes = [[r["token"] for r in sorted(own, key=lambda r: (r["place"], r["token"]))] for own in found.values() if len(own) > 1]
        self.rank = {t: (c, k) for c, own in enumerate(self.classes) for k, t in enumerate(own)}
        self.mass = {r["token"]: r["mass"] for r in rows if r["kind"] in (PAGE, BLOCK, HOLDER, CONTENT)}
        texts = [r for r in rows if r["kind"] == TEXT]
        self.texts = {r["token"] for r in texts}
        #: Texts that are nearly all that their slot ever holds.
        self.fixed = {r["token"] for r in texts if r["parent"] in self.tags and 10 * r["mass"] >= 9 * self.tags[r["parent"]]["own"]}
        self.chain = self._chain(texts)

    def _chain(self, texts: list[dict]) -> list[int]:
        """Tokens of the elements around the article, each in the one before; what texts of the template weigh does not count, unless all texts are such."""
        left = dict(self.mass)
        for r in texts:
            at = r["parent"]
            while at in self.tags:
                left[at] -= r["mass"]
                at = self.tags[at]["parent"]
            if 0 in left:
                left[0] -= r["mass"]
        if 10 * left.get(0, 0) < self.mass.get(0, 0):
            left = self.mass
        within = defaultdict(list)
        for t, r in self.tags.items():
            if r["kind"] != BLOCK and r["total"] == r["n"] and t in self.rank:
                within[r["parent"]].append(t)
        out, at = [], 0
        while own := within.get(at):
            best = max(own, key=lambda t: (left[t], t))
            if left[best] < MOST * left.get(at, 0) or out and self.tags[at]["kind"] == CONTENT and self.tags[best]["kind"] != CONTENT:
                break
            out.append(best)
            at = best
        return out

    def valid(self, tokens: list[tuple[int, int, bool]]) -> list[tuple[int, int, int]]:
        """(place, class, rank) of the tokens of a page that make up its template: of classes in order, round by round, each in one gap of another.

        A class that is not in order is told apart into its elements' beginnings and ends.
        """
        own = [(i, *self.rank[t]) for i, (t, _, _) in enumerate(tokens) if t in self.rank]
        seen: dict[int, list[int]] = defaultdict(list)
        for _, c, k in own:
            seen[c].append(k)
        broken = {c for c, ranks in seen.items() if len(ranks) % len(self.classes[c]) or any(k != i % len(self.classes[c]) for i, k in enumerate(ranks))}
        if broken:
            pair = {}
            for i, c, _ in own:
                if c in broken:
                    pair[i] = (("pair", self._element(tokens, i)), int(tokens[i][2]))
            own = [(i, *pair.get(i, (c, k))) for i, c, k in own]
        while True:
            bad = self._misplaced(own)
            if not bad:
                return own
            own = [x for x in own if x[1] not in bad]

    @staticmethod
    def _element(tokens: list[tuple[int, int, bool]], i: int) -> int:
        token, _, end = tokens[i]
        return token if end else _end(token)

    def _misplaced(self, own: list[tuple]) -> set:
        """Classes of which a round overlaps another's, or lies in another gap than the rounds before."""
        stack: list[list] = []
        gaps: dict = {}
        for _, c, k in own:
            size = 2 if isinstance(c, tuple) else len(self.classes[c])
            if k == 0:
                gap = (stack[-1][0], stack[-1][1]) if stack else None
                if gaps.setdefault(c, gap) != gap:
                    return {c}
                stack.append([c, 0])
            elif not stack or stack[-1][0] != c:
                return {stack[-1][0]} if stack else {c}
            else:
                stack[-1][1] = k
            if k == size - 1:
                stack.pop()
        return {stack[-1][0]} if stack else set()


def deduce(pages: Iterable[str]) -> Template:
    """The template of one host's pages, each given once; what templates() finds for a host in the frame."""
    pages = list(dict.fromkeys(pages))
    rows = gather((None, i, x) for i, x in enumerate(pages))
    return Template((t, *r) for (_, t), r in rows.items() if r[2] >= SUPPORT * len(pages) and (r[0] != TEXT or r[2] >= MIN_PAGES))


def main_text(html: str, template: Template) -> str:
    """The main text of a page: blocks in page order joined by newlines.

    The article is the innermost element of the template's chain that is valid
    on this page, stands on it once and holds text. Of its slots those go that
    have a label but not most of its text, and those of no prose that hold the
    same on the host's pages. Where the article is no article or main element,
    prose that stands beside it in the elements around it, and varies, belongs to it.
    Without a template nothing but tags that hold no article's text keeps a text out.
    """
    page = tokenise(html)
    elements = page.elements
    times = Counter(t for t, _, _ in page.tokens)
    ends: dict[int, list[int]] = defaultdict(list)
    for i, _, _ in template.valid(page.tokens):
        ends[page.tokens[i][1]].append(i)
    spans = {elements[e].token: (e, *x) for e, x in ends.items() if len(x) == 2 and times[elements[e].token] == 1}
    chain = [t for t in template.chain if t in spans]
    texts = [(b, x) for b in page.blocks if (x := b.text())]
    fallback = ""
    for depth in range(len(chain), -1, -1):
        token = chain[depth - 1] if depth else 0
        at, start, stop = spans[token] if depth else (-1, -1, len(page.tokens))
        whole = template.mass.get(token, 0) or (elements[at].mass if depth else sum(x.mass for x in elements if x.parent < 0))
        beside = set() if depth and elements[at].content else {spans[t][0] for t in chain[: depth - 1]} | ({-1} if depth else set())
        judged: dict[int, bool] = {at: True}
        out, plain = [], []
        for b, text in texts:
            if start < b.at <= stop:
                plain.append(text)
                if not template.tags or _kept(b.element, elements, judged, template, whole) and not (b.element >= 0 and elements[b.element].tag not in _PROSE and _hash(f"{elements[b.element].token}|{text}") in template.fixed):
                    out.append(text)
            elif beside and _prose(b.element, elements) in beside and _hash(f"{elements[b.element].token if b.element >= 0 else 0}|{text}") not in template.texts:
                out.append(text)
        if out:
            return "\n".join(out)
        fallback = fallback or "\n".join(plain)
    return fallback


def _prose(element: int, elements: list[Element]) -> int:
    """The element around the prose that ``element`` belongs to; -2 if it is none."""
    while element >= 0 and elements[element].tag in _PROSE:
        element = elements[element].parent
    return element if element < 0 or elements[element].kind != BLOCK else -2


def _kept(element: int, elements: list[Element], judged: dict[int, bool], template: Template, whole: int) -> bool:
    """Whether no element from ``element`` out to the article has a label without most of the article's text."""
    way = []
    while element not in judged and element >= 0:
        way.append(element)
        element = elements[element].parent
    good = judged.get(element, True)
    for e in reversed(way):
        own = elements[e]
        good = good and not (own.label and 2 * template.mass.get(own.token, own.mass) < whole)
        judged[e] = good
    return good


def templates(pages: DataFrame, host: str) -> DataFrame:
    """(host, tokens): for each host its template's tokens, an array of structs of _COLUMNS.

    ``pages`` has host and html. Rows of (host, token) are formed in each task and
    added up by Spark. Tokens on fewer than SUPPORT of the host's pages go, and
    texts on fewer than MIN_PAGES. What gathers for a host is its template, whose
    size does not grow with its pages. Copies of a page count once.
    """
    names = [host, *_COLUMNS]
    schema = f"`{host}` string, token long, kind int, parent long, n long, vector long, total long, place long, mass long, own long"
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "html"):
            found = gather(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts))
            rows = [(*key, *row) for key, row in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    each = pages.select(host, F.xxhash64("html").alias("page"), "html").dropDuplicates([host, "page"]).mapInArrow(run, schema)
    sums = [F.sum(c).alias(c) for c in ("n", "vector", "total", "place", "mass", "own")]
    tokens = materialize(each.groupBy(host, "token").agg(F.any_value("kind").alias("kind"), F.any_value("parent").alias("parent"), *sums).filter(f"kind <> {TEXT} or n >= {MIN_PAGES}"))
    sizes = tokens.filter("token = 0").select(host, F.col("n").alias("pages"))
    frequent = tokens.join(sizes, host).filter(F.col("n") >= F.col("pages") * SUPPORT)
    return frequent.groupBy(host).agg(F.collect_list(F.struct(*_COLUMNS)).alias("tokens"))


def extract(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` (url, html, ...) with ``text``: the main text of the whole html, empty if there is none.

    Null html is empty; a null or odd url is a host of its own, the empty one.
    Copies of one html count as one page when templates are deduced. On a host
    of one page the page itself is the template. A column named ``text`` is
    replaced; all others stay, whatever their names.
    """
    base = pages.drop(text)
    inner = unused(base, "template")
    own = base.withColumn(inner, F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))
    # written, so that the join below reads both sides from a shuffle and Spark can split a large host
    found = materialize(templates(own.select(F.col(inner).alias("host"), "html"), "host")).select(F.struct("host", "tokens").alias("found"))
    found = found.withColumnRenamed("found", unused(own, "found"))
    side = found.columns[0]
    joined = own.join(found, own[inner] == found[side]["host"], "left").withColumn(inner, F.col(f"`{side}`")).drop(side)
    schema = T.StructType([*base.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Template] = {}
        for batch, texts in steps(batches, "html"):
            at = batch.schema.get_field_index(inner)
            hosts, tokens = batch.column(at).field(0).to_pylist(), batch.column(at).field(1)
            out = []
            for i, (host, html) in enumerate(zip(hosts, texts)):
                if host not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[host] = Template(tuple(t[c] for c in _COLUMNS) for t in tokens[i].as_py() or ())
                out.append(main_text(html, known[host]))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())], schema.names)

    return joined.mapInArrow(run, schema)
