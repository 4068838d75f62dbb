"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text under one root-to-leaf path of block tags (with their classes; inline
tags don't count). Menus, page headers, footers, asides, forms and parts whose class, id or role says so are no
candidates. Text length without links and punctuation are summed per path and divided by the path's blocks; the two
ratios are fused and smoothed over neighbouring blocks. Paths above the page's threshold are content, as are paragraphs
that aren't links. The article or main element with most of it, or else the least container that holds all of it, is where
the text stands; in it paths under the threshold count as well (headings, cells) unless most of their text is links. It is
always the path that decides, for all of its blocks.

Nulls: null html is an empty page and gives an empty text; ids and urls may be null; repeated rows stay; an empty table
gives an empty result; further columns are ignored. Broken markup is read as far as it goes: an unclosed script or
comment runs to the end, a '<' that begins no tag is text. Nothing is capped, and the time grows with the page's length
however deep, unclosed or unbalanced its markup is: paths are numbers, sums go up them once, and no part is scanned anew.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>=]")
_QUOTE = re.compile(r"=\s*([\"'])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "textarea", "title")}
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，？！¿¡]")

# HTML element names, and the words by which pages name parts that are no article.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_CONTENT = frozenset("head nav footer aside form button fieldset dialog menu select option datalist audio video noscript template svg iframe object canvas math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion banner banners"
    " nav navi navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs sidebar sidebars aside rail footer foot footnav header masthead topbar"
    " comment comments commentlist discussion discuss disqus replies respond responses reactions related recommended recommendations trending popular teaser teasers"
    " share sharing social follow subscribe subscription newsletter signup login signin register cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall"
    " search pagination pager paging toolbar widget widgets copyright legal disclaimer skip hidden complementary contentinfo form dialog tags tagcloud".split()
)
_NO_CONTAINER = HEADINGS | frozenset("p li ul ol blockquote pre dl dd dt td tr th tbody table figcaption".split())
NOT_ITSELF = frozenset("no non not has have with without is".split())
OF_ARTICLE = frozenset("article post entry story content".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",))}


def _is_boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in NO_CONTENT or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if key in ("class", "id", "role"):
            for name_ in value.split():
                said = _WORD.findall(_CAMEL.sub(" ", name_).lower())
                for before, word in zip(["", *said], said, strict=False):
                    # "no-sidebar", "has-comments" tell about the page; a header of the article belongs to it
                    if word in HINTS and before not in NOT_ITSELF and not (word == "header" and (in_article or not OF_ARTICLE.isdisjoint(said))):
                        return True
    return False


class Scanner:
    """Tags of a page from left to right, in time that grows with its length: nothing is looked at anew.

    Quotes count where a value may stand, after '='. Once a tag finds no end that way, quotes don't count any more.
    """

    def __init__(self, page: str):
        self.page = page
        self.quotes = True

    def tag_end(self, at: int) -> int:
        """Where the tag that goes on at ``at`` ends (its '>'), or -1: no tag ends any more."""
        page = self.page
        if not self.quotes:
            return page.find(">", at)
        p = at
        while m := _STOP.search(page, p):
            if m[0] == ">":
                return m.start()
            q = _QUOTE.match(page, m.start())
            if not q:
                p = m.end()
                continue
            close = page.find(q[1], q.end())
            if close < 0:
                break
            p = close + 1
        self.quotes = False
        return page.find(">", at)

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it closes, attributes); comments, declarations and raw text have no name."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("!--", at):
                end = page.find("-->", at + 3)
                end = len(page) if end < 0 else end + 3
                yield start, end, "", False, ""
                at = end
                continue
            closes = page.startswith("/", at)
            m = _NAME.match(page, at + closes)
            if not m and page[at : at + 1] not in ("!", "?", "/"):
                continue
            end = self.tag_end(m.end() if m else at)
            if end < 0:
                return
            end += 1
            name = m[0].lower() if m else ""
            if name in _RAW_END and not closes:
                close = _RAW_END[name].search(page, end)
                close = close.start() if close else len(page)
                end = page.find(">", close) + 1 or len(page)
                name = ""
            yield start, end, name, closes, page[m.end() : end - 1] if name else ""
            at = end


class Paths:
    """Tag paths as numbers: 0 is the empty path, parents have lesser numbers than their children."""

    def __init__(self) -> None:
        self.parent, self.name, self.label, self.depth = [-1], [""], [""], [0]
        self._known: dict[tuple[int, str], int] = {}

    def child(self, parent: int, name: str, label: str) -> int:
        n = self._known.setdefault((parent, label), len(self.parent))
        if n == len(self.parent):
            self.parent.append(parent)
            self.name.append(name)
            self.label.append(label)
            self.depth.append(self.depth[parent] + 1)
        return n

    def inherit(self, own: list) -> list:
        """Whether a path or one above it is marked."""
        for n in range(1, len(own)):
            own[n] = own[n] or own[self.parent[n]]
        return own

    def totals(self, own: list) -> list:
        """The sum over each path and all below it."""
        for n in range(len(own) - 1, 0, -1):
            own[self.parent[n]] += own[n]
        return own


def blocks(page: str) -> tuple[Paths, list[tuple[int, str, int, bool]]]:
    """The page's paths, and (path, text, characters in links, boilerplate) of each block in page order."""
    out: list[tuple[int, str, int, bool]] = []
    paths = Paths()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, path, boilerplate
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack by name
    parts: list[str] = []
    links = in_link = 0

    def close() -> None:
        nonlocal links
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((stack[-1][1], text, min(links, len(text)), stack[-1][2]))
            parts.clear()
        links = 0

    def pop(n: int) -> None:
        close()
        for name, _, _ in stack[n:]:
            opened[name].pop()
        del stack[n:]

    def last(names) -> int:
        return max((opened[x][-1] for x in names if opened[x]), default=0)

    at = 0
    for start, end, name, closes, attributes in Scanner(page).tags():
        if start > at:
            parts.append(page[at:start])
            if in_link:
                links += start - at
        at = end
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closes else 1
            elif name == "br":
                parts.append(" ")
            continue
        in_link = 0
        if closes:
            if k := last((name,)):
                pop(k)
            else:
                close()
            continue
        if name in _CLOSES_P and stack[-1][0] == "p":
            pop(len(stack) - 1)
        elif name in _SIBLINGS:
            ends, within = _SIBLINGS[name]
            # inside the nearest table or list, the outermost of the parts that this one ends
            bound = last(within)
            k = min((opened[e][-1] for e in ends if opened[e] and opened[e][-1] > bound), default=0)
            if k:
                pop(k)
        elif name == "body" and opened["head"]:
            pop(opened["head"][0])
        close()
        if name not in VOID:
            flag = stack[-1][2] or _is_boilerplate(name, attributes, bool(opened["article"] or opened["main"]))
            kind = re.search(r"\bclass\s*=\s*[\"']?([^\"'>]*)", attributes, re.I) if attributes else None
            opened[name].append(len(stack))
            stack.append((name, paths.child(stack[-1][1], name, f"{name}.{'.'.join(kind[1].split())}" if kind else name), flag))
    if at < len(page):
        parts.append(page[at:])
    close()
    return paths, out


def _smooth(x: list[float]) -> list[float]:
    """Gaussian of radius 2 and deviation 1 over neighbours."""
    w = [math.exp(-d * d / 2) for d in range(3)]
    out = []
    for i in range(len(x)):
        near = [(w[abs(j - i)], x[j]) for j in range(max(0, i - 2), min(len(x), i + 3))]
        out.append(sum(a * b for a, b in near) / sum(a for a, _ in near))
    return out


def path_scores(found: list[tuple[int, str, int, bool]]) -> dict[int, float]:
    """Text length and punctuation of each path by its blocks, fused, and smoothed over the blocks' neighbours."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0])
    for path, text, links, _ in found:
        s = sums[path]
        s[0] += 1
        s[1] += len(text) - links
        s[2] += len(_PUNCTUATION.findall(text))
    fused = {p: (length / n) * math.sqrt(1 + marks / n) for p, (n, length, marks) in sums.items()}
    score: dict[int, float] = defaultdict(float)
    for (path, *_), s in zip(found, _smooth([fused[b[0]] for b in found]), strict=True):
        score[path] += math.sqrt(s * fused[path]) / sums[path][0]
    return score


def main_text(page: str | None) -> str:
    paths, found = blocks(page or "")
    found = [b for b in found if not b[3]]
    if not found:
        return ""
    score = path_scores(found)
    mean = sum(score.values()) / len(score)
    spread = math.sqrt(sum((x - mean) ** 2 for x in score.values()) / len(score))
    limit = min(max(score.values()), max(mean, spread))
    # paragraphs that aren't links belong to the text whatever their score
    paragraphs = {path for path, text, links, _ in found if paths.name[path] == "p" and 2 * links <= len(text)}
    content = {p for p, x in score.items() if x >= limit} | paragraphs
    # the article or main element with most of the content, or else the least container of all content
    length = [0] * len(paths.parent)
    for path, text, links, _ in found:
        if path in content:
            length[path] += len(text) - links
    total = sum(length)
    weight, within = paths.totals(length), paths.totals([int(n in content) for n in range(len(paths.parent))])
    bodies = [n for n, x in enumerate(weight) if paths.name[n] in ("article", "main") and 2 * x > total]
    if bodies:
        container = max(bodies, key=lambda n: (weight[n], -paths.depth[n]))
    else:
        container = max((n for n, x in enumerate(weight) if x >= total and within[n] == len(content)), key=lambda n: paths.depth[n])
    while paths.name[container] in _NO_CONTAINER:
        container = paths.parent[container]
    inside = paths.inherit([n == container for n in range(len(paths.parent))])
    # in it, paths under the threshold count as well (headings, lists, cells) unless they are mostly links
    share: dict[int, int] = defaultdict(int)
    for path, text, links, _ in found:
        share[path] += len(text) - 2 * links
    kept = content | {p for p, x in share.items() if x >= 0 or bodies and paths.name[p] == "p"}
    began, keep = False, []
    depth = paths.depth[container]
    of_article = paths.inherit([paths.depth[n] >= depth and not OF_ARTICLE.isdisjoint(_WORD.findall(paths.label[n].lower())) for n in range(len(paths.parent))])
    for path, text, _, _ in found:
        if inside[path]:
            began = True
            if path in kept:
                keep.append(text)
        elif not began and container and paths.name[path] in ("h1", "h2"):
            # the article's title may stand beside its body, or before it in a part of its own
            if paths.parent[path] == paths.parent[container] or of_article[paths.parent[path]]:
                keep.append(text)
    return " ".join(keep)


@common.lean
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            text = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
