"""HTML extraction by tag-path ratios.

A page is read once, from left to right, into blocks, each on its root-to-leaf
tag path; a path is a number whose parent is a smaller one.  For each path the
text length, the punctuation, the linked text and the number of blocks are
summed.  The ratio of a path is its text per block, more with punctuation, less
with links.  Ratios are smoothed over the paths of a container, fused with what
tags and class names on the path make likely, and thresholded against the best;
the blocks on the paths that remain are the main text.

Tags and names only weigh: a path goes or stays by its fused ratio.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements whose content is not markup, up to their end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in "script style xmp textarea iframe noembed title".split()}
#: Elements that show no text.
UNSEEN = frozenset("head noscript template svg select datalist object audio video canvas map math".split())
#: Elements that give others a form only; smoothing looks through them.
FORM = frozenset("ul ol dl li dd table thead tbody tfoot tr td th blockquote figure section details".split())
#: Blocks of prose: they take a share of what surrounds them however high their container.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th blockquote pre figcaption caption summary address".split())
#: What an open element of the key closes when it begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
#: How far a close looks up, by elements and by levels.
SCOPE, LEVELS = frozenset("table ul ol dl article section div body html main td th blockquote".split()), 64
#: How likely a tag makes main text, and words of a class, id or role that do so.
LIKELY = {"article": 4.0, "main": 4.0, "nav": 0.6, "header": 0.002, "footer": 0.001, "aside": 0.001, "form": 0.001, "fieldset": 0.001, "button": 0.001, "menu": 0.001, "dialog": 0.001}
MARKED, HIDDEN_, CONTENT = 0.001, 0.001, 2.0
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|promo\w*|sponsor\w*|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-?header|page-?header|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|comments?|disqus|respon[ds]\w*|reply|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|widget|toolbar|pagination|pager|tags|contentinfo|complementary|dialog|copyright|legal|disclaimer|skip)(?=$|[\s_-])|(?:^|\s)(?:header|top-?bar|banner|form|aside|cc-window)(?=$|\s)",
    re.IGNORECASE,
)
GOOD = re.compile(r"(?:^|[\s_-])(?:content|article|post|entry|story|prose)(?=$|[\s_-])", re.IGNORECASE)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: An attribute up to its value; the value is read by its quote.
ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+)?|[\s/]*+")
BARE = re.compile(r"[^\s>]*")
UNSHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
PUNCTUATION = re.compile(r"[,.;:!?،。，、；：！？…]")
#: Share of the best fused ratio that a path needs; what a block takes from its container, and from further up.
THRESHOLD, NEAR, FAR = 0.12, 0.5, 0.6
#: Links in an article count as text by this share at least when smoothed.
LINKED = 0.6


def attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """The class, id, role, hidden and style of a tag, and where it ends; -1 if it never does.

    ``last`` is the last place of either quote: a value whose quote is not closed
    ends with the tag.
    """
    found: dict[str, str] = {}
    n = len(page)
    while at < n:
        m = ATTR.match(page, at)
        at = m.end()
        if at >= n:
            return found, -1
        name, c = m[1], page[at]
        if name is not None and page[at - 1] == "=" or name is not None and page[m.end(1) : at].rstrip().endswith("="):
            if c in last and at < last[c]:
                end = page.index(c, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                b = BARE.match(page, at)
                value, at = b[0], b.end()
            if (low := name.lower()) in KEPT:
                found.setdefault(low, value)
        elif name is not None:
            if (low := name.lower()) in KEPT:
                found.setdefault(low, "")
        elif c == ">":
            return found, at + 1
    return found, -1


KEPT = frozenset("class id role hidden style aria-hidden".split())


class Paths:
    """The tag paths of a page, tags with their first class: for each its parent, tag, depth, prior, and whether it is seen and in an article."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.names: dict[str, float] = {}
        self.parent, self.tag, self.depth, self.prior, self.seen, self.article = [-1], [""], [0], [1.0], [True], [False]

    def child(self, at: int, tag: str, attrs: dict[str, str]) -> int:
        name = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".strip() if attrs else ""
        hidden = bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(UNSHOWN.search(attrs.get("style", ""))))
        if name and tag not in ("html", "body", "article", "main"):
            if (likely := self.names.get(name)) is None:
                likely = self.names[name] = MARKED if MARKS.search(name) else CONTENT if GOOD.search(name) else 1.0
        else:
            likely = 1.0
        first = attrs["class"].split(None, 1)[:1] if "class" in attrs else []
        label = (at, tag, *first, likely, hidden)
        if (k := self.known.get(label)) is not None:
            return k
        k = self.known[label] = len(self.parent)
        self.parent.append(at)
        self.tag.append(tag)
        self.depth.append(self.depth[at] + 1)
        self.seen.append(self.seen[at] and tag not in UNSEEN)
        inside = self.article[at]
        self.article.append(inside or tag in ("article", "main"))
        p = self.prior[at]
        if tag in LIKELY and not (inside and tag in ("article", "main", "header")):
            p *= LIKELY[tag]
        if hidden:
            p *= HIDDEN_
        if likely < 1 or not inside:
            p *= likely
        self.prior.append(p)
        return k


def blocks(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The paths, and (path, text, linked characters) of each block that is seen, in page order.

    One pass: every search begins where the last one ended, or ends the page.
    """
    paths = Paths()
    tags, stack, open_ = [""], [0], {"": 1}
    out: list[tuple[int, str, int]] = []
    buffer: list[str] = []
    linked = links = at = 0
    n, last = len(page), {q: page.rfind(q) for q in "\"'"}

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((stack[-1], text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def close(i: int) -> None:
        for t in tags[i:]:
            open_[t] -= 1
        del tags[i:], stack[i:]

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a and paths.seen[stack[-1]]:
            buffer.append(x := page[a:b])
            linked += len(x.strip()) * (links > 0)

    while at < n:
        k = page.find("<", at)
        if k < 0:
            break
        c = page[k + 1 : k + 2]
        if c in ("!", "?"):
            text(at, k)
            if page.startswith("<!--", k):
                end = k + 4 if page.startswith(">", k + 4) else page.find("-->", k + 2)
                size = 1 if page.startswith(">", k + 4) else 3
            else:
                end, size = page.find(">", k), 1
            at = n if end < 0 else end + size
            continue
        begin = k + 2 if c == "/" else k + 1
        m = NAME.match(page, begin)
        if not m:  # not a tag
            text(at, k + 1)
            at = k + 1
            continue
        text(at, k)
        tag = m[0].lower()
        attrs, at = attributes(page, m.end(), last)
        if at < 0:  # the page ends within a tag
            at = n
            break
        if c != "/" and tag in RAW:
            if tag == "textarea" or tag == "title":
                flush()
            m = RAW[tag].search(page, at)
            at = n if not m else page.find(">", m.end()) + 1 or n
            continue
        if tag in INLINE:
            links = max(0, links + (-1 if c == "/" else 1)) if tag == "a" else links
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        flush()
        if c == "/":
            if open_.get(tag, 0):
                i = len(tags) - 1
                while tags[i] != tag:
                    i -= 1
                close(i)
                links = 0
            continue
        if tag in VOID or tag in ("svg", "math") and page[at - 2] == "/":
            continue
        links = 0
        also = CLOSES.get(tag, ())
        if open_.get("p", 0) or any(open_.get(t, 0) for t in also):
            for i in range(len(tags) - 1, max(0, len(tags) - LEVELS), -1):
                if tags[i] == "p" or tags[i] in also:
                    close(i)
                elif tags[i] in SCOPE:
                    break
        stack.append(paths.child(stack[-1], tag, attrs))
        tags.append(tag)
        open_[tag] = open_.get(tag, 0) + 1
    text(at, n)
    flush()
    return paths, out


def fused(paths: Paths, found: list[tuple[int, str, int]], use: bool = True) -> dict[int, float]:
    """The smoothed and fused ratio of each path with text.  Without ``use`` every path has the same ratio."""
    sums: dict[int, list[float]] = {}
    for path, text, linked in found:
        s = sums.setdefault(path, [0.0, 0.0, 0.0, 0.0])
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += linked
        s[3] += 1
    held = [0.0] * len(paths.parent)  # by path: the best ratio below it
    ratio, share = {}, {}
    for path, (length, marks, linked, n) in sums.items():
        free = share[path] = max(0.0, 1 - linked / length) if use else 1.0
        # text per block, more for many marks, and a little for how much there is
        ratio[path] = length / n * (1 + math.log1p(marks / n)) * free**2 * math.log(2 + length) if use else 1.0
        held[path] = ratio[path]
    for path in range(len(held) - 1, 0, -1):  # children have larger numbers
        up = paths.parent[path]
        held[up] = max(held[up], held[path])
    out = {}
    for path, r in ratio.items():
        near, weight = 0.0, NEAR
        prose, up = paths.tag[path] in PROSE, path
        for _ in range(12):
            up = paths.parent[up]
            if up <= 0 or not paths.article[up] and paths.depth[up] < 3 and not prose:
                break
            near = max(near, weight * held[up])
            if paths.tag[up] not in FORM:
                weight, prose = weight * FAR, False
            if weight < THRESHOLD:
                break
        s = max(share[path], LINKED) if paths.article[path] else share[path]
        out[path] = max(r, near * s**2) * paths.prior[path]
    return out


def extract(page: str | None, use: bool = True) -> str:
    """The main text of a page: its blocks joined by line ends; empty if there is none."""
    paths, found = blocks(page or "")
    if not found:
        return ""
    score = fused(paths, found, use)
    least = THRESHOLD * max(score.values())
    return "\n".join(text for path, text, _ in found if score[path] >= least and score[path] > 0)


def main_text(pages: DataFrame, source: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The keys, ``text`` and ``n_chars`` of each row.

    Null and empty pages, and pages without text, give an empty text; equal rows
    equal texts; paths whose ratios tie stay or go together; a page's time and
    memory grow with its length only, however it is nested or cut; other columns
    are not read.
    """
    kinds = dict(pages.dtypes)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = [extract(x) for x in batch.column(len(keys)).to_pylist()]
            return {k: batch.column(i) for i, k in enumerate(keys)} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

        return work

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text string, n_chars long"
    return arrow_map(pages.select(*keys, source), make, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
