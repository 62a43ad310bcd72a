"""Main text of web pages by tag-path ratios
(after Wu et al., "Web news extraction via tag path feature fusion", 2013-2016).

Each block of text has a root-to-leaf tag path (inline elements left out). Per page the text length and the punctuation
of a path are divided by its number of blocks; both ratios are smoothed over the page's blocks in order, fused by their
product, and a path whose mean exceeds a share of the deviation from zero is content. The article is the smallest
container that holds nearly all of the content paths' text. All of it is returned, short blocks too, but for subtrees
that the ratios score as boilerplate: no content path, no punctuation, and text that is mostly links. Links within
headings, and the one or two links between the heading and the first content block (who wrote it), are no boilerplate.
Unless the container is an article or main element, blocks around it with content nodes are returned too. Text below
elements that are no article by their meaning (menus, page headers and footers, sidebars, scripts, notices, adverts,
reader comments) never counts and is never returned. A form is one of these unless it wraps nearly all content.

Names (class, id, role) say that an element is no article by words of a list. They don't count on an element that
holds the main article (the article or main element with most content), nor on one that holds much of the content:
nearly all of it, or a fair share if the name only contains such a word (has-sidebar, comments-open) and the main
article isn't elsewhere.

Defined cases: null or empty html, and pages without text, give an empty text. Elements left open are closed by
the end of their parent, of the page, or by the next block as HTML defines it. Repeated pages are extracted one
by one; other columns are ignored. Time and memory grow with the length of a page, however its tags are nested or cut.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Share of the deviation that a content path exceeds, smoothing over neighbours, and share of the content text that a container must hold.
LAMBDA, KERNEL, HOLD = 0.45, (0.25, 0.5, 0.25), 0.9
#: Share of the content text with which an element is kept though its name contains a word of the list.
FAIR = 0.3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style noscript template head title nav footer aside button select option textarea iframe object svg canvas audio video menu dialog datalist map".split())
CONTAINERS = frozenset("html body div section main article center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are left out as a whole if they are boilerplate; items and cells stay with their list or table.
UNITS = frozenset("div section center header ul ol dl table p blockquote figure details".split())
#: Share of links in the text of boilerplate: of a few, and of a list of LINKS or more.
FEW_LINKED, LIST_LINKED, LINKS = 0.9, 0.5, 3
#: A start tag of the key ends open elements of the value, up to the nearest of BOUND.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUND = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd".split())
#: Words of class, id and role that say an element is not the article.
_WORDS = (
    r"(?:ads?|adv|adverts?|advertisements?|advertising|adslot|adbox|banner|sponsor(?:ed)?|promo(?:tion)?s?|menu|navigation|nav|navbar|breadcrumbs?|sidebar|side|aside|footer|header|masthead|topbar|"
    r"cookies?|consent|notices?|alert|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|recommendations|comments?|disqus|replies|respond|"
    r"widget|toolbar|pagination|pager|copyright|legal|skip|complementary|contentinfo)"
)
_NOT_ARTICLE = re.compile(rf"(?:^|[\s_-]){_WORDS}(?:$|[\s_-])", re.IGNORECASE)
#: A name of such words only.
_WHOLLY = re.compile(rf"(?:^|\s){_WORDS}(?:[_-]+{_WORDS})*(?:$|\s)", re.IGNORECASE)
_NEVER_HINTED = frozenset(("html", "body", "main", "article"))
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")


_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*>|[^>]*>)|<[!?/][^>]*>""", re.DOTALL)
_UNENDED = re.compile("<[A-Za-z/!?]")
#: Elements whose content is text up to their end tag.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
_TELLING = re.compile("class|id|role|hidden", re.IGNORECASE)


class _Page:
    """Elements (tag, parent, path, whether it is no article, what its name says) and text nodes (element, block, text, punctuation) of a page.

    A path is a number: that of (the parent's path, tag and name). Open elements are also listed by tag, so what an
    end tag closes is found without a walk through all that is open.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.paths, self.out, self.named = ["#root"], [-1], [0], [False], [0]
        self.holders, self.headed, self.linked = [0], [False], [False]
        self.numbers: dict[tuple[int, str], int] = {}
        self.open, self.by_tag, self.nodes, self.block = [0], {}, [], 0
        at, last = 0, html.rfind(">") + 1  # beyond it no tag ends
        while found := _TOKEN.search(html, at, last):
            if found.start() > at:
                self._text(html[at : found.start()])
            at = found.end()
            if not (tag := found[2]):
                if found[0].startswith("<!--") and not found[0].endswith("-->"):
                    at = len(html)
                continue
            tag = tag.lower()
            if found[1]:
                self._end_tag(tag)
                continue
            self._start_tag(tag, found[3])
            if tag in _RAW:
                end = re.compile(f"</{tag}", re.IGNORECASE).search(html, at)
                at = end.start() if end else len(html)
        if rest := _UNENDED.split(html[at:], maxsplit=1)[0]:  # a tag that the end of the page cuts is dropped
            self._text(rest)

    def _start_tag(self, tag: str, rest: str) -> None:
        if tag not in INLINE:
            self.block += 1
        if tag in VOID:
            return
        if tag in ENDS_P:
            self._end(("p",), ("table", "td", "th", "button", "object"))
        if tag in CLOSES:
            self._end(CLOSES[tag], BOUND[tag])
        top, hints, hidden = self.open[-1], "", False
        if rest and _TELLING.search(rest):
            named = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
            hints, hidden = " ".join(filter(None, map(named.get, ("class", "id", "role")))), "hidden" in named
        within = tag == "header" and any(self.by_tag.get(t) for t in ("article", "main"))
        out = self.out[top] or tag in SKIPPED or hidden or (tag == "header" and not within)
        says = hints and tag not in _NEVER_HINTED and not within and _NOT_ARTICLE.search(hints)
        element, label = len(self.tags), f"{tag}.{hints}" if hints else tag
        self.tags.append(tag)
        self.parents.append(top)
        self.out.append(out)
        self.named.append(2 if tag == "form" else (2 if _WHOLLY.search(hints) else 1) if says else 0)
        self.paths.append(self.numbers.setdefault((self.paths[top], label), len(self.numbers) + 1))
        self.holders.append(self.holders[top] if tag in INLINE else element)
        self.headed.append(self.headed[top] or tag in HEADINGS)
        self.linked.append(self.linked[top] or tag == "a")
        self.by_tag.setdefault(tag, []).append(len(self.open))
        self.open.append(element)

    def _end_tag(self, tag: str) -> None:
        if tag not in INLINE:
            self.block += 1
        if tag not in VOID:
            self._end((tag,), ("table",) if tag in INLINE or tag == "p" else ())

    def _text(self, text: str) -> None:
        if not self.out[self.open[-1]]:
            text = unescape(text) if "&" in text else text
            self.nodes.append((self.open[-1], self.block, text, len(_PUNCTUATION.findall(text))))

    def _end(self, tags, bound):
        """Closes the innermost open element of tags, unless one of bound is within it."""
        place = max((self.by_tag[t][-1] for t in tags if self.by_tag.get(t)), default=0)
        if not place or any(self.by_tag[t][-1] > place for t in bound if self.by_tag.get(t)):
            return
        for e in self.open[place:]:
            self.by_tag[self.tags[e]].pop()
        del self.open[place:]

    def path(self, e: int) -> int:
        """The path of the block around e: inline elements don't count."""
        return self.paths[self.holders[e]]


def _content(page: _Page, nodes: list[tuple[int, int, str, int]]) -> list[bool]:
    """Which nodes are content, by the tag paths of their blocks: length and punctuation per block of a path, each smoothed over the
    page's blocks in order, fused by their product, averaged over the path's blocks and compared with a share of the root mean square."""
    block, last, path, length, marks = [], None, [], [], []
    for e, k, text, n in nodes:
        if k != last:
            last = k
            path.append(page.path(e))
            length.append(0)
            marks.append(0)
        block.append(len(path) - 1)
        length[-1] += len(text)
        marks[-1] += n
    sums: dict[int, list[float]] = {}
    for p, x, y in zip(path, length, marks, strict=True):
        s = sums.setdefault(p, [0, 0, 0, 0])
        s[0] += 1
        s[1] += x
        s[2] += y
    each = [(s[1] / s[0], s[2] / s[0]) for s in map(sums.get, path)]
    before, (near, here, far) = [each[0], *each[:-1]], KERNEL
    for p, a, b, c in zip(path, before, each, [*each[1:], each[-1]], strict=True):
        sums[p][3] += (near * a[0] + here * b[0] + far * c[0]) * (1 + near * a[1] + here * b[1] + far * c[1])
    score = {p: s[3] / s[0] for p, s in sums.items()}
    least = LAMBDA * (sum(score[p] ** 2 for p in path) / len(path)) ** 0.5
    told = [score[p] >= least for p in path]
    return [told[k] for k in block]


def _below(page: _Page, values: list[float]) -> list[float]:
    """The sums of the elements' values over their subtrees, in place."""
    parents = page.parents
    for e in range(len(values) - 1, 0, -1):  # parents come before their children
        values[parents[e]] += values[e]
    return values


def _drop_named(page: _Page) -> None:
    """Marks elements as no article by their names: first names of listed words only and forms, then those that contain a word."""
    for level in (2, 1):
        if level not in page.named:
            continue
        nodes = [x for x in page.nodes if not page.out[x[0]] and not x[2].isspace()]
        if not nodes:
            return
        weight, marks = [0.0] * len(page.tags), [0] * len(page.tags)
        for (e, _, text, n), content in zip(nodes, _content(page, nodes), strict=True):
            weight[e] += len(text) * bool(content)
            marks[e] += n
        weight, marks = _below(page, weight), _below(page, marks) if "form" in page.tags else marks
        below = [False] * len(page.tags)  # a name of listed words only
        for e in range(1, len(page.tags)):
            below[e] = below[page.parents[e]] or (page.named[e] == 2 and page.tags[e] != "form")
        articles = [e for e, tag in enumerate(page.tags) if tag in ("article", "main") and not page.out[e] and weight[e]]
        best = max(articles, key=lambda e: (not below[e], weight[e]), default=0)
        holders, e = set(), best
        while e > 0:
            holders.add(e)
            e = page.parents[e]
        inside = [False] * len(page.tags)
        for e in range(1, len(page.tags)):
            top = page.parents[e]
            inside[e] = inside[top] or e == best
            if page.named[e] == level and e not in holders and not page.out[top]:
                share = FAIR if level == 1 and (inside[e] or not best) else HOLD
                whole = weight[best] if inside[e] else weight[0]
                controls = page.tags[e] == "form" and not marks[e]
                page.out[e] = page.out[e] or controls or not weight[e] >= share * max(whole, 1)
            page.out[e] = page.out[e] or page.out[top]


def _container(page: _Page, weight: list[float], plain: list[float]) -> tuple[int, set[int]]:
    """The smallest element that holds nearly all of the content, and what stands beside it with content of its own."""
    children: dict[int, list[int]] = {}
    for e in range(1, len(page.tags)):
        children.setdefault(page.parents[e], []).append(e)
    at, beside = 0, set()
    while True:
        down = next((c for c in children.get(at, ()) if page.tags[c] in CONTAINERS and weight[c] >= HOLD * weight[at]), None)
        if down is None or page.tags[at] in ("article", "main") or (plain[at] == plain[down] and page.tags[at] not in ("#root", "html", "body")):
            break
        beside.update(c for c in children[at] if c != down and weight[c] and page.tags[c] not in INLINE)
        at = down
    return at, set() if page.tags[at] in ("article", "main") else beside


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by one space."""
    if not html:
        return ""
    page = _Page(html)
    _drop_named(page)
    page.nodes = [x for x in page.nodes if not page.out[x[0]]]
    nodes = [x for x in page.nodes if not x[2].isspace()]
    content = list(map(bool, _content(page, nodes))) if nodes else []
    if not any(content):
        return ""
    n = len(page.tags)
    weight, plain, total, linked, marks = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    first, told = [len(nodes)] * n, set()
    for k, ((e, block, text, m), c) in enumerate(zip(nodes, content, strict=True)):
        size = len(text)
        total[e] += size
        marks[e] += m
        first[e] = min(first[e], k)
        if c:
            weight[e] += size
            told.add(block)
        if not page.headed[e]:
            plain[e] += size
            linked[e] += size * page.linked[e]
    for values in (weight, plain, total, linked, marks):
        _below(page, values)
    at, beside = _container(page, weight, plain)
    inside = {at} | beside
    for e in range(1, n):
        if page.parents[e] in inside:
            inside.add(e)
    links = _below(page, [int(t == "a" and total[e] > 0) for e, t in enumerate(page.tags)]) if linked[0] else []
    for e in range(n - 1, 0, -1):
        first[page.parents[e]] = min(first[page.parents[e]], first[e])
    head = next((k for k, x in enumerate(nodes) if x[0] in inside and page.headed[x[0]]), len(nodes))
    body = next((k for k in range(head + 1, len(nodes)) if content[k] and not page.headed[nodes[k][0]]), 0)

    def boilerplate(e: int) -> bool:
        if weight[e] or marks[e] or not linked[e] or page.tags[e] not in UNITS:
            return False
        signed = head < first[e] < body and links[e] < LINKS
        return not signed and linked[e] >= (LIST_LINKED if links[e] >= LINKS else FEW_LINKED) * total[e]

    dropped: set[int] = set()
    if linked[0]:
        for e in sorted(inside - {at}):
            if page.parents[e] in dropped or boilerplate(e):
                dropped.add(e)
    blocks: dict[int, list[str]] = {}
    for e, block, text, _ in page.nodes:
        if (e in inside and e not in dropped) or (block in told and page.tags[at] not in ("article", "main")):
            blocks.setdefault(block, []).append(text)
    return " ".join(t for x in blocks.values() if (t := " ".join("".join(x).split())))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html")
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
