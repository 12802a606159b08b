"""Main text of web pages by template deduction from equivalence classes of tokens.

Tokens of a page are its tags and text nodes, each with the path of the elements around it. Tokens of a host with the same
occurrence vector (how often on which page) form a class. Classes that most pages have, whose tokens come in one order and
which lie inside one another, make up the host's template; what lies between its tokens are the slots. The text is that
of the slots; the elements only tell which slots are the article's. Inside the article a text is the template's only if it
occurs just as the page's skeleton does (its outermost element), on a host with enough pages: editions of one article keep what
they share. Where no slot is left (a page all of whose text other pages have), the elements decide alone.

Occurrence vectors are never gathered: two sums over hashes of (page, count) stand for a vector, so a host that holds a
third of all pages is added up before the shuffle like any other.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitframe.llm.common import map_partition
from hitframe.session import written

#: A template token is on at least this share of a host's pages and on so many pages.
SUPPORT, LEAST_PAGES = 0.5, 3
#: A text inside the article is the template's only on hosts with so many pages.
LEAST_INSIDE = 5
#: Sums of so many tokens are held before they are passed on.
HELD = 200_000

#: Elements whose content is no text (fixed values).
RAW = "script style title textarea noscript template iframe object svg math select option button audio video canvas datalist".split()
#: Elements that enclose blocks, and those that only end one (fixed values).
BOXES = frozenset(
    "html body head nav header footer aside form article main section div ul ol dl table thead tbody tfoot figure details dialog fieldset menu blockquote".split()
)
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption pre br hr figcaption address summary legend hgroup center".split())
#: Elements, roles, and whole names of class or id that mark what isn't the article (fixed values). Other than by the elements of
#: ``SURE``, a box with most of the page's slot text is never set apart.
SURE = frozenset("head nav footer aside menu header".split())
APART = frozenset("head nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WORDS = frozenset(
    "nav navbar navigation menu sidebar footer ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay share sharing social related recommended comment comments disqus reply replies "
    "newsletter subscribe subscription breadcrumb breadcrumbs pagination pager widget masthead toolbar login signup search topbar skip header site-header page-header".split()
)
MAIN = frozenset("article main".split())

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Box:
    """An element that encloses blocks. ``path`` is a hash of the names from the outermost element on, of one length at any depth."""

    name: str
    parent: int
    path: str
    apart: bool
    main: bool
    inside_main: bool = False
    holds_main: bool = False


@dataclass
class Page:
    """Tokens of a page: (path and tag or text, number of the enclosing box, text or None, whether a block ends before it)."""

    boxes: list[Box] = field(default_factory=lambda: [Box("", -1, "", False, False)])
    tokens: list[tuple[str, int, str | None, bool]] = field(default_factory=list)


def marks(attributes: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}


def is_apart(name: str, known: dict[str, str], in_main: bool) -> bool:
    """The element's name, role, class or id says that it isn't part of the article."""
    if name in ("html", "body"):
        return False
    if name in APART or known.get("role", "").lower() in ROLES or name == "header" and not in_main:
        return True
    return any(one.lower() in WORDS for value in (known.get("class", ""), known.get("id", "")) for one in value.split())


def parse(source: str) -> Page:
    """Tokens of a page. End tags that are missing or have no start do no harm; what is cut off at the end is kept."""
    page, at, now, ends = Page(), 0, 0, True
    open_names: Counter = Counter()

    def text(piece: str):
        nonlocal ends
        if piece:
            plain = html.unescape(piece)
            page.tokens.append((f"{page.boxes[now].path}|{' '.join(plain.split())}", now, plain, ends))
            ends = False

    for m in PIECE.finditer(source):
        text(source[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if name in BREAKS:
            ends = True
        elif name in BOXES:
            ends = True
            if m[2]:
                if open_names[name]:  # closes all that is open inside it too
                    while page.boxes[now].name != name:
                        open_names[page.boxes[now].name] -= 1
                        now = page.boxes[now].parent
                    page.tokens.append((f"{page.boxes[now].path}</", now, None, True))
                    open_names[name] -= 1
                    now = page.boxes[now].parent
            else:
                known, outer = marks(m[4]), page.boxes[now]
                main = name in MAIN or known.get("role", "").lower() == "main"
                inside = main or outer.inside_main
                label = f"{name}.{known.get('class', '')}#{known.get('id', '')}"
                path = f"{number(f'{outer.path}/{label}'):x}"
                page.boxes.append(Box(name, now, path, is_apart(name, known, inside), main, inside))
                k, now = now, len(page.boxes) - 1
                open_names[name] += 1
                page.tokens.append((f"{path}<", now, None, True))
                while main and k >= 0 and not page.boxes[k].holds_main:
                    page.boxes[k].holds_main, k = True, page.boxes[k].parent
    text(source[at:])
    return page


def number(token: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(token) - (1 << 63)


def vectors(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Partial sums (host, token, xor, sum, pages, place) from (page_id, host, html)."""
    held: dict[tuple[str, int], list[int]] = {}
    for page_id, host, source in rows:
        order: dict[int, int] = {}
        counts: Counter = Counter()
        for k, (token, *_) in enumerate(parse(source).tokens):
            t = number(token)
            counts[t] += 1
            order.setdefault(t, k)
        for t, n in counts.items():
            h = number(f"{page_id}:{n}")
            own = held.setdefault((host, t), [0, 0, 0, 0])
            own[0] ^= h
            own[1] += h & 0xFFFFFFFF
            own[2] += 1
            own[3] += order[t]
        if len(held) > HELD:
            yield from ((*k, *v) for k, v in held.items())
            held = {}
    yield from ((*k, *v) for k, v in held.items())


def templates(pages: DataFrame, support: float = SUPPORT, least: int = LEAST_PAGES) -> DataFrame:
    """host, ``of`` (its pages), ``template``: its tokens with class number, in their order within the class.

    A host's tokens that are on half of its pages are at most twice as many as an average page of it has. What is joined by
    host is written first (it is small beside the pages): adaptive execution splits a host's rows only in joins of tables
    that are not grouped by host themselves.
    """
    sums = map_partition(pages.select("page_id", "host", "html"), vectors, "host string, token long, x long, s long, pages long, place long")
    per_token = sums.groupBy("host", "token").agg(F.bit_xor("x").alias("x"), F.sum("s").alias("s"), F.sum("pages").alias("pages"), F.sum("place").alias("place"))
    hosts = written(pages.groupBy("host").agg(F.count("*").alias("of")), "hosts")
    frequent = per_token.join(hosts, "host").where((F.col("pages") >= least) & (F.col("pages") >= support * F.col("of")))
    classes = written(frequent.withColumn("class", F.xxhash64("x", "s", "pages")), "classes")
    token = F.struct("class", (F.col("place") / F.col("pages")).alias("place"), "token")
    return written(classes.groupBy("host").agg(F.max("of").alias("of"), F.sort_array(F.collect_list(token)).alias("template")), "templates")


def valid_places(numbers: list[int], template: list[tuple[int, int]]) -> set[int]:
    """Places of the page's tokens that belong to valid classes of ``template`` (class, token; in order).

    A class is valid on the page if its tokens come as whole rounds in their order, and if all of it lies in one and the same
    slot of every class that encloses it (of each round, where that repeats).
    """
    of = dict((t, c) for c, t in template)
    order: dict[int, list[int]] = {}
    for c, t in template:
        order.setdefault(c, []).append(t)
    places: dict[int, list[int]] = {}
    for k, t in enumerate(numbers):
        if t in of:
            places.setdefault(of[t], []).append(k)
    ordered = []
    for c, own in places.items():
        rounds, rest = divmod(len(own), len(order[c]))
        if not rest and [numbers[k] for k in own] == order[c] * rounds:
            ordered.append((own, len(order[c])))
    kept: list[tuple[list[int], int]] = []
    for own, size in sorted(ordered, key=lambda p: (p[0][0] - p[0][-1], p[0])):  # widest first
        if all(outer[0] > own[-1] or outer[-1] < own[0] or len({bisect(outer, k) % n for k in own}) == 1 for outer, n in kept):
            kept.append((own, size))
    return {k for own, _ in kept for k in own}


def main_text(source: str, template: list[tuple[int, int]], inside: bool = True) -> str:
    """Text of the slots of a page, outside what is set apart from the article; blocks joined by one space.

    ``inside`` tells whether texts of the template may lie inside the article.
    """
    page = parse(source)
    numbers = [number(t[0]) for t in page.tokens] if template else []
    fixed = valid_places(numbers, template)
    held = [0] * len(page.boxes)  # characters of slot text
    for k, (_, box, text, _) in enumerate(page.tokens):
        if text is not None and k not in fixed:
            held[box] += len(text.strip())
    for i in range(len(held) - 1, 0, -1):  # a box comes after those around it
        held[page.boxes[i].parent] += held[i]
    apart = []
    for b, n in zip(page.boxes, held):
        own = b.apart and not b.holds_main and (b.name in SURE or 2 * n <= held[0])
        apart.append(own or b.parent >= 0 and apart[b.parent])
    has_main = any(b.main and not out for b, out in zip(page.boxes, apart))
    read = [k for k, (_, box, text, _) in enumerate(page.tokens) if text is not None and not apart[box] and (page.boxes[box].inside_main or not has_main)]
    shared = fixed
    if fixed and has_main:
        classes = {t: c for c, t in template}
        skeleton = next((classes.get(n) for n, t in zip(numbers, page.tokens) if t[2] is None), None)
        shared = {k for k in fixed if inside and skeleton is not None and classes[numbers[k]] == skeleton}
    if any(k not in shared and page.tokens[k][2].strip() for k in read):
        read = [k for k in read if k not in shared or not page.tokens[k][2].strip()]
    blocks, wanted = [""], set(read)
    for k, (_, _, text, ends) in enumerate(page.tokens):
        if ends:
            blocks.append("")
        if k in wanted:
            blocks[-1] += text
    return " ".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null html is empty; an empty page or one without article text has an empty text. Pages whose url is null or has no host
    share the empty host. Hosts with fewer than ``LEAST_PAGES`` pages have no template, and their pages are read by their elements
    alone. On a host of at least ``LEAST_INSIDE`` pages, a heading or sentence that every article has once is the template's.
    Repeated rows each get their row; other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def make(read):
        for page_id, url, source, of, template in read:
            text = main_text(source, [(t["class"], t["token"]) for t in template or ()], (of or 0) >= LEAST_INSIDE)
            yield page_id, url, text, len(text)

    known = rows.join(templates(rows), "host", "left").select("page_id", "url", "html", "of", "template")
    return map_partition(known, make, "page_id long, url string, text string, n_chars long")
