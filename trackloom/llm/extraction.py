"""HTML main text by tag-path ratios.

A page is a row of text nodes, each with the path of tags from the root to it. Text length and
punctuation are summed per path and divided by the path's nodes: article paths hold long,
punctuated nodes; menu and link paths short bare ones. Both ratios are smoothed along the page,
because content nodes stand together, fused by multiplication, and a path is content where its fused
ratio passes a threshold taken from the page's own spread. The content container is the deepest
element that holds most of the text of content paths; its blocks are the main text, short ones
included, except what lies below a boilerplate element.

Element names, roles, classes and ids mark elements as boilerplate. That is evidence, not a verdict:
a part of a longer name ("no-sidebar") or a form around most of a page's punctuated text says nothing
on that page, nor does any other mark around most of it if nothing else is left.
Articles, and then main elements, outrank what surrounds them only if they hold most of the content.

Pages may be cut off or badly nested: end tags without a start are ignored, missing ones are implied.
Null or empty pages, and pages without text, give an empty text. Repeated rows are extracted once
each. Extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from trackloom.llm.common import chosen, small_batches

SMOOTHING = (0.25, 0.5, 0.25)
#: Share of a standard deviation of the fused ratios that a content path must reach.
LEAST_DEVIATION = 0.5
#: Share of the content text that the container holds at least.
CONTAINER_SHARE = 0.6
#: More than this share of a text is most of it: of the punctuated text that marks cover (``_judge``),
#: and of the content that a region must hold.
MOST_SHARE = 0.5

# Element names and words of the format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|object|svg|math|canvas|textarea|title|select|xmp"
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav header footer aside form menu dialog button head".split())
#: What a start tag ends, up to the nearest of the elements in the second list.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "article": (("p",), ()), "section": (("p",), ()),
}
CONTAINERS = frozenset("article body center details div dl html main ol section table tbody td ul".split())
ENDS_PARAGRAPH = BLOCK - {"body", "html", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}
#: Elements whose name says that they hold the main text, the more specific one first.
REGIONS = ("article", "main")
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "notice alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar share sharing social related recommended "
    "comment comments commentlist disqus respond reply replies reader-comments pagination pager toolbar skip-link copyright disclaimer".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_EVENT = re.compile("""["'>]""")
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW.split("|")}
#: Elements of other languages inside a page: there a slash does close a tag.
FOREIGN = frozenset(("svg", "math"))
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s=>/]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")


@dataclass
class Element:
    """An open or closed element: its name, path, place in the tree, and whether it is boilerplate.

    A path is a number that stands for the path of the parent and the element's own label. ``marks`` are the reasons to call it boilerplate, its own and those of the elements around it.
    """

    name: str
    path: int
    parent: Element | None
    marks: frozenset[tuple[str, str]]
    regions: dict[str, Element]  # the outermost article and the outermost main element around it
    depth: int
    boilerplate: bool = False


@dataclass
class Node:
    """A block's worth of text in one element."""

    element: Element
    block: int
    text: str


def _attributes(text: str) -> dict[str, str]:
    """Attributes by lowercase name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def _element(name: str, attributes: str, parent: Element | None, paths: dict[tuple[int, str], int]) -> Element:
    given = _attributes(attributes) if attributes else {}
    names = [n for kind in given if kind in ("class", "id") for n in given[kind].lower().split()]
    role = given.get("role", "").lower()
    marks = {("element", name)} if name in BOILERPLATE else set()
    if role in BOILERPLATE_ROLES:
        marks.add(("role", role))
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(given.get("style", "")):
        marks.add(("hidden", ""))
    for n in names:
        if n in BOILERPLATE_NAMES:
            marks.add(("name", n))
        else:  # a part of a longer name is a reason of its own: "no-sidebar" says nothing about "sidebar"
            marks.update(("part", part) for part in re.split(r"[-_]+", n) if part in BOILERPLATE_NAMES)
    if name in ("body", "html", "main"):  # "has-sidebar" and the like describe the page, not a part of it
        marks = set()
    label = name if not names else f"{name}.{'.'.join(sorted(names))}"
    path = paths.setdefault((parent.path if parent else -1, label), len(paths))
    # marks and regions are shared with the parent where the element adds none
    inherited = parent.marks if parent else frozenset()
    element = Element(name, path, parent, inherited | marks if marks else inherited, parent.regions if parent else {}, parent.depth + 1 if parent else 0)
    for region in REGIONS:
        if region in (name, role) and region not in element.regions:
            element.regions = {**element.regions, region: element}
    return element


class Ends:
    """Where tags end: at the first ``>`` outside quotes, for any start, after one pass over the page.

    From behind, each quote and ``>`` is told where a tag ends that meets it outside of quotes, within
    double ones, or within single ones.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.places = [m.start() for m in _EVENT.finditer(page)]
        self.outside = [-1] * (len(self.places) + 1)
        double = single = -1
        for i in range(len(self.places) - 1, -1, -1):
            sign, after = page[self.places[i]], self.outside[i + 1]
            if sign == ">":
                self.outside[i] = self.places[i]
            elif sign == '"':
                self.outside[i], double = double, after
            else:
                self.outside[i], single = single, after

    def of(self, at: int) -> int:
        """End of a tag whose name ends at ``at``; an unclosed quote is read as text; -1 if there is no ``>``."""
        end = self.outside[bisect_left(self.places, at)]
        return end if end >= 0 else self.page.find(">", at)


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str, str]]:
    """(begin, end, name, closes, attributes, text) of everything between the text of a page.

    Comments, declarations and elements whose content is no text have no name; CDATA has a text. Every
    character is looked at a bounded number of times.
    """
    ends, at, size = Ends(page), page.find("<"), len(page)

    def upto(mark: str, begin: int) -> int:
        found = page.find(mark, begin)
        return size if found < 0 else found + len(mark)

    while at >= 0:
        following = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = upto("-->", at + 4)
            yield at, end, "", False, "", ""
        elif page[at : at + 9].upper() == "<![CDATA[" and (close := page.find("]]>", at + 9)) >= 0:
            end = close + 3
            yield at, end, "", False, "", page[at + 9 : close]
        elif following in ("!", "?"):
            end = upto(">", at + 2)
            yield at, end, "", False, "", ""
        elif (tag := _NAME.match(page, at + 1)) is not None:
            close = ends.of(tag.end())
            if close < 0:
                return
            name, attributes, end = tag[2].lower(), page[tag.end() : close], close + 1
            if name in _RAW_END and not tag[1]:
                if not (name in FOREIGN and attributes.endswith("/")):
                    last = _RAW_END[name].search(page, end)
                    end = last.end() if last else size
                name, attributes = "", ""
            yield at, end, name, bool(tag[1]), attributes, ""
        else:
            end = at + 1
        at = page.find("<", end)


def parse(page: str) -> list[Node]:
    """Text nodes in page order."""
    paths: dict[tuple[int, str], int] = {}
    root = _element("html", "", None, paths)
    stack, nodes, block = [root], [], 0
    # where elements of each name stand in the stack; the nearest block, and the nearest but paragraphs, up to each place
    places: dict[str, list[int]] = {}
    walls, other_walls = [0], [0]

    def text(raw: str) -> None:
        if raw:
            nodes.append(Node(stack[-1], block, html.unescape(raw)))

    def nearest(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(names: tuple[str, ...], limit: int) -> None:
        """Close the nearest element of these names and all in it, unless that lies before ``limit``."""
        nonlocal block
        at = nearest(names)
        if at and at >= limit:
            block += any(e.name in BLOCK for e in stack[at:])
            for element in stack[at:]:
                places[element.name].pop()
            del stack[at:], walls[at:], other_walls[at:]

    end = 0
    for begin, after, name, closes, attributes, inside in tokens(page):
        text(page[end:begin])
        end = after
        if inside:
            nodes.append(Node(stack[-1], block, inside))
        if not name or name == "html":
            continue
        if name in BLOCK:
            block += 1
        if closes:
            # an inline element does not close the blocks around it
            close((name,), 0 if name in BLOCK else walls[-1])
            continue
        if name == "br":
            nodes.append(Node(stack[-1], block, " "))
        if name in VOID:
            continue
        if name in IMPLIED:
            close(IMPLIED[name][0], nearest(IMPLIED[name][1]))
        elif name in ENDS_PARAGRAPH:
            close(("p",), other_walls[-1])
        if name == "body":
            close(("head",), 0)
        if not attributes.endswith("/"):
            stack.append(_element(name, attributes, stack[-1], paths))
            here = len(stack) - 1
            places.setdefault(name, []).append(here)
            walls.append(here if name in BLOCK else walls[-1])
            other_walls.append(here if name in BLOCK and name != "p" else other_walls[-1])
    text(page[end:])
    _judge(nodes)
    return nodes


def _judge(nodes: list[Node]) -> None:
    """Call elements boilerplate by their marks, unless the page's punctuated text speaks against a mark.

    Weak marks, parts of longer names and forms, fall if they cover most of the text without a strong
    one. Strong marks fall if they cover most of the text and no other text is left.
    """
    sizes: dict[frozenset[tuple[str, str]], int] = {}
    for node in nodes:
        if _PUNCTUATION.search(node.text):
            sizes[node.element.marks] = sizes.get(node.element.marks, 0) + len("".join(node.text.split()))
    strong = {m for marks in sizes for m in marks if m[0] != "part" and m[1] != "form"}

    def most(among: dict[frozenset[tuple[str, str]], int]) -> set[tuple[str, str]]:
        total, covered = sum(among.values()), {}
        for marks, size in among.items():
            for mark in marks:
                covered[mark] = covered.get(mark, 0) + size
        return {mark for mark, size in covered.items() if size > MOST_SHARE * total}

    void = most({marks: size for marks, size in sizes.items() if not marks & strong})
    if not any(marks <= void for marks in sizes):
        void = most(sizes)
    for node in nodes:
        node.element.boilerplate = not node.element.marks <= void


def content_paths(nodes: list[Node]) -> set[int]:
    """Paths whose smoothed and fused ratios pass the page's threshold."""
    sums: dict[int, list[int]] = {}
    for node in nodes:
        found = sums.setdefault(node.element.path, [0, 0, 0])
        words = "".join(node.text.split())
        found[0] += len(words)
        found[1] += len(_PUNCTUATION.findall(words))
        found[2] += 1
    lengths = [sums[n.element.path][0] / sums[n.element.path][2] for n in nodes]
    marks = [(sums[n.element.path][1] + 0.5) / sums[n.element.path][2] for n in nodes]
    fused = [a * b for a, b in zip(_smooth(lengths), _smooth(marks))]
    if not fused:
        return set()
    mean = sum(fused) / len(fused)
    threshold = LEAST_DEVIATION * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    per_path: dict[int, list[float]] = {}
    for node, value in zip(nodes, fused):
        per_path.setdefault(node.element.path, []).append(value)
    return {path for path, values in per_path.items() if sum(values) / len(values) >= threshold}


def _smooth(values: list[float]) -> list[float]:
    before, at, after = SMOOTHING
    last = len(values) - 1
    return [before * values[max(i - 1, 0)] + at * v + after * values[min(i + 1, last)] for i, v in enumerate(values)]


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks in page order, joined by line breaks."""
    nodes = [n for n in parse(page or "") if not n.element.boilerplate]
    filled = [n for n in nodes if not n.text.isspace()]
    content = _content(filled)
    # an article or main element with most of the content outranks what surrounds it
    total = sum(len(n.text) for n in content)
    region = next((r for r in REGIONS if sum(len(n.text) for n in content if r in n.element.regions) > MOST_SHARE * total), None)
    if region:
        content = _content([n for n in filled if region in n.element.regions])
    if region:
        containers = {id(n.element.regions[region]): n.element.regions[region] for n in content}
    else:
        container = _container(content)
        containers = {id(container): container}
    blocks: dict[int, list[str]] = {}
    known = dict.fromkeys(containers, True)
    for node in nodes:
        if _below(node.element, known):
            blocks.setdefault(node.block, []).append(node.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _content(filled: list[Node]) -> list[Node]:
    """The nodes on content paths, or all where no path stands out."""
    paths = content_paths(filled)
    return [n for n in filled if n.element.path in paths] or filled


def _container(content: list[Node]) -> Element | None:
    """The deepest element with most of the content: a paragraph or list item belongs to what is around it."""
    held: dict[int, list] = {}
    for node in content:
        element = node.element
        # every element is reached once, and its own text is counted where it stands
        while element is not None and id(element) not in held:
            held[id(element)] = [element, 0]
            element = element.parent
        held[id(node.element)][1] += len(node.text)
    for element, _ in sorted(held.values(), key=lambda h: -h[0].depth):
        if element.parent is not None:
            held[id(element.parent)][1] += held[id(element)][1]
    total = sum(len(n.text) for n in content)
    deep = [e for e, size in held.values() if size >= CONTAINER_SHARE * total and (e.name in CONTAINERS or e.parent is None)]
    return max(deep, key=lambda e: e.depth, default=None)


def _below(element: Element | None, known: dict[int, bool]) -> bool:
    """Whether an element lies in one of those known to count; what is found on the way is kept."""
    passed = []
    while element is not None and id(element) not in known:
        passed.append(id(element))
        element = element.parent
    found = element is not None and known[id(element)]
    known.update(dict.fromkeys(passed, found))
    return found


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of all pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h if isinstance(h, str) else "") for h in batch["html"]]
            yield pd.DataFrame({
                "page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": list(map(len, texts)),
            })

    small_batches(pages.sparkSession)
    return chosen(pages, "page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
