"""Main text of pages by nearest-URL page differencing.

Pages of a host are put in the order of their URL's path and query; each is compared with the four nearest different
pages before and after it there. Text lines are aligned by their longest common subsequence, and how many of those
neighbours share a line says whether it is template: one is enough for a line that markup puts outside the text, and for
one of which markup says nothing and that is no sentence; half of them for a sentence, three quarters for a line inside
a marked article, whose passages may repeat for other reasons. Markup is the later check: it also takes the lines outside the text that no neighbour shares.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_in_python


RAW = frozenset("script style noscript template svg iframe object math canvas title textarea".split())
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
BOILERPLATE = frozenset("nav footer aside form head dialog menu select button header".split())
CONTENT = frozenset("article main".split())
OUT_NAME = re.compile(r"(?:^|[-_ ])(?:nav|navbar|navigation|menu|sidebar|side|footer|header|masthead|banner|ads?|advert|adverts|advertisement|sponsor|sponsored|promo|promotion|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|comments?|reply|replies|respond|disqus|breadcrumbs?|pagination|pager|widget|toolbar|search|complementary|contentinfo|paywall)(?:$|[-_ ])", re.I)
IN_NAME = re.compile(r"(?:^|[-_ ])(?:article|articlebody|article-body|post-content|post-body|entry-content|entry|story|story-body|main|main-content|content-body)(?:$|[-_ ])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FREE, INSIDE, OUTSIDE, LINK, PROSE = 0, 1, 2, 3, 4  # LINK: inside, and mostly the text of links; PROSE: free, and a sentence
SENTENCE = re.compile(r"(?:\S+ ){4}.*[.!?…。][\"'”»)]*\Z", re.S)


def zone_of(tag: str, attributes: str, parent: int) -> int:
    """OUTSIDE stays so for all below it; a header inside the article belongs to it."""
    if parent == OUTSIDE:
        return OUTSIDE
    names = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    said = " ".join(names.get(k, "") for k in ("class", "id", "role"))
    if HIDDEN.search(names.get("style", "")):
        return OUTSIDE
    if tag in CONTENT and not OUT_NAME.search(said):
        return INSIDE
    if tag == "body" or tag == "html":
        return parent
    if tag in BOILERPLATE and not (tag == "header" and parent == INSIDE):
        return OUTSIDE
    if OUT_NAME.search(said) and not (parent == INSIDE and re.search(r"header", said, re.I) and tag not in ("nav", "aside")):
        return OUTSIDE
    if names.get("itemprop", "").lower() == "articlebody" or IN_NAME.search(said):
        return INSIDE
    return parent


class Scanner:
    """The tags of a page, each found in time linear in what it skips; what is never closed reaches to the page's end."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Where ``what`` next stands, -1 if nowhere; a vain search is made once."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` has its ``>``; a quote that isn't closed is a character like any other."""
        page = self.page
        while True:
            at = PLAIN.match(page, at).end()
            if at == len(page) or page[at] == ">":
                return at
            close = self.find(page[at], at + 1)
            at = close + 1 if close > 0 else at + 1

    def tags(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, slash, name, attributes) in page order; the name of comments, scripts and the like is empty."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                close = self.find("-->", start + 4)
                at = close + 3 if close >= 0 else len(page)
                yield start, at, "", "", ""
                continue
            if page[start + 1 : start + 2] in ("!", "?"):
                close = self.find(">", start)
                at = close + 1 if close >= 0 else len(page)
                yield start, at, "", "", ""
                continue
            named = NAME.match(page, start + 1)
            if not named:
                at = start + 1
                continue
            end, name = self.tag_end(named.end()), named[2].lower()
            at = min(end + 1, len(page))
            if not named[1] and name in RAW:
                close = None if f"</{name}" in self.missing else RAW_END[name].search(page, at)
                if close is None:
                    self.missing.add(f"</{name}")
                at = close.end() if close else len(page)
                yield start, at, "", "", ""
            else:
                yield start, at, named[1], name, page[named.end() : end]


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """(zone, line) for each block of text in page order; references decoded, white space single."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    zone, at, linked = FREE, 0, 0
    if not page:
        return out

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = SPACE.sub(" ", entities.unescape(raw)).strip()
            if text:
                kind = LINK if zone == INSIDE and 2 * linked > len(raw.strip()) else PROSE if zone == FREE and SENTENCE.match(text) else zone
                out.append((kind, text))
            parts.clear()
        linked = 0

    def text_until(end: int) -> None:
        nonlocal linked
        if end > at:
            parts.append(page[at:end])
            if any(name == "a" for name, _ in stack[-4:]):
                linked += end - at

    for start, end, slash, tag, attributes in Scanner(page).tags():
        text_until(start)
        at = end
        if not tag:
            continue
        if slash:
            if not opened[tag]:
                if tag == "p" or tag not in INLINE:
                    flush()
                continue
            found = len(stack) - 1
            while stack[found][0] != tag:  # what is passed is closed too, so all searches together are linear
                found -= 1
            below = stack[found - 1][1] if found else FREE
            if tag not in INLINE or below != zone:
                flush()
            for name, _ in stack[found:]:
                opened[name] -= 1
            del stack[found:]
            zone = below
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            closes = CLOSES.get(tag, ("p",))
            while stack and (stack[-1][0] in closes or stack[-1][0] in INLINE and any(s[0] in closes for s in stack[-4:])):
                opened[stack.pop()[0]] -= 1
            zone = stack[-1][1] if stack else FREE
        new = zone_of(tag, attributes, zone)
        if new != zone:
            flush()
        stack.append((tag, new))
        opened[tag] += 1
        zone = new
    text_until(len(page))
    flush()
    return out


def lcs_row(own: list[int], other: list[int]) -> int:
    """Bit k is zero where the longest common subsequence of own[: k + 1] and ``other`` is longer than that of own[:k]."""
    masks: dict[int, int] = {}
    for k, h in enumerate(own):
        masks[h] = masks.get(h, 0) | 1 << k
    v = full = (1 << len(own)) - 1
    for h in other:
        if h in masks:
            u = v & masks[h]
            v = ((v + u) | (v - u)) & full
    return v


def lcs_places(own: list[int], other: list[int], cells: int) -> list[int]:
    """Places in ``own`` of a longest common subsequence, bit-parallel; beyond ``cells`` in halves, so memory stays linear."""
    ahead = 0
    while ahead < min(len(own), len(other)) and own[ahead] == other[ahead]:
        ahead += 1
    own, other = own[ahead:], other[ahead:]
    after = 0
    while after < min(len(own), len(other)) and own[-1 - after] == other[-1 - after]:
        after += 1
    tail = list(range(ahead + len(own) - after, ahead + len(own)))
    own, other = own[: len(own) - after], other[: len(other) - after]
    if not own or not other:
        return list(range(ahead)) + tail
    if len(own) * len(other) > cells and len(other) > 1:
        half, n = len(other) // 2, len(own)
        grown = lambda v: np.concatenate(([0], np.cumsum(1 - np.unpackbits(np.frombuffer(v.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n].astype(np.int64))))
        first, last = grown(lcs_row(own, other[:half])), grown(lcs_row(own[::-1], other[half:][::-1]))
        cut = int((first + last[::-1]).argmax())
        middle = lcs_places(own[:cut], other[:half], cells) + [cut + k for k in lcs_places(own[cut:], other[half:], cells)]
    else:
        masks: dict[int, int] = {}
        for k, h in enumerate(own):
            masks[h] = masks.get(h, 0) | 1 << k
        v = full = (1 << len(own)) - 1
        rows = [full]
        for h in other:
            u = v & masks.get(h, 0)
            v = ((v + u) | (v - u)) & full
            rows.append(v)
        middle, j, bit = [], len(other), len(own) - 1
        while bit >= 0 and j > 0:
            if rows[j] >> bit & 1:  # a one: this line adds nothing to the longest match
                bit -= 1
            elif not rows[j - 1] >> bit & 1:  # already matched by an earlier line of the other page
                j -= 1
            else:
                middle.append(bit)
                bit, j = bit - 1, j - 1
        middle.reverse()
    return list(range(ahead)) + [ahead + k for k in middle] + tail


def shared_lines(own: list[int], other: list[int], cells: int = 1 << 24) -> set[int]:
    """Positions in ``own`` of a longest common subsequence with ``other``."""
    common = set(own) & set(other)
    if not common:
        return set()
    places = [k for k, h in enumerate(own) if h in common]
    return {places[k] for k in lcs_places([own[k] for k in places], [h for h in other if h in common], cells)}


def template_of(zones: bytes, hashes: list[int], neighbours: list[list[int]]) -> set[int]:
    """Positions of the lines that enough of the neighbours share; without a neighbour there is no evidence."""
    counts = Counter(k for other in neighbours for k in shared_lines(hashes, other))
    n = len(neighbours)
    needed = {OUTSIDE: 1, FREE: 1, LINK: 1, PROSE: max(1, -(-n // 2)), INSIDE: max(3, -(-3 * n // 4))}
    return {k for k, c in counts.items() if c >= needed[zones[k]]}


def main_text(zones: bytes, lines: list[str], template: set[int]) -> str:
    """The page's lines less its template and less what markup puts outside the text."""
    inside = any(z in (INSIDE, LINK) for z in zones)
    wanted = (INSIDE, LINK) if inside else (FREE, PROSE)
    return " ".join(x for k, (z, x) in enumerate(zip(zones, lines, strict=True)) if k not in template and z in wanted)


@dataclass
class Parsed:
    own: bool
    page_id: int | None
    url: str | None
    host: str
    zones: bytes
    lines: pa.Scalar
    hashes: list[int]


def neighbours_of(rows: deque[Parsed], k: int, reach: int, each_side: int = 4) -> list[list[int]]:
    """The lines of the nearest pages of its host to each side of the page at ``k`` that differ from it and from each other."""
    out = []
    for step in (-1, 1):
        own: list[list[int]] = []
        for j in range(k + step, k + step * (reach + 1), step):
            if not 0 <= j < len(rows) or rows[j].host != rows[k].host or len(own) == each_side:
                break
            if rows[j].hashes != rows[k].hashes and rows[j].hashes not in own:
                own.append(rows[j].hashes)
        out += own
    return [h for h in out if h]


def differenced(rows: Iterator[Parsed], reach: int) -> Iterator[tuple[Parsed, str, int]]:
    """(page, text, lines that differencing took) of the own rows of a sorted range, with a window of ``reach`` pages to each side."""
    window: deque[Parsed] = deque()
    k = 0

    def one() -> Iterator[tuple[Parsed, str, int]]:
        page = window[k]
        if page.own:
            template = template_of(page.zones, page.hashes, neighbours_of(window, k, reach))
            yield page, main_text(page.zones, page.lines.as_py() or [], template), len(template)

    for row in rows:
        window.append(row)
        if len(window) - k > reach:
            yield from one()
            k += 1
            if k > reach:
                window.popleft()
                k -= 1
    while k < len(window):
        yield from one()
        k += 1


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", part_pages: int = 2048, most_parts: int = 20_000, reach: int = 64) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) for every row; ``n_template`` counts the lines that differencing took.

    All pages are put in the order of host, path, query and page_id and cut into ranges of about ``part_pages``, more
    where that would be over ``most_parts`` ranges, along keys from a hashed sample. A page looks for different
    neighbours among the ``reach`` pages to each side of it. As many first and last pages of a range are also sent to the
    range beside it, so every page meets its true neighbours and no host is worked off by one task, and a range is read
    through a window of that size. Null or empty html gives an empty text; pages with a null URL are neighbours of each
    other; repeated rows are returned each; other columns are ignored; an empty table gives an empty table.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, path, query = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\??([^#]*)", 1)
    order = ["host", "path", "query", "id", "link"]
    keyed = rows.select("page_id", "url", host.alias("host"), path.alias("path"), query.alias("query"), F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), F.coalesce("url", F.lit("")).alias("link"), "html")
    keys = keyed.select(*order)
    total = rows.count()
    parts = max(1, min(most_parts, total // part_pages))
    share = min(1.0, 20 * parts / max(total, 1))
    drawn = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64(F.lit(5), "id", "link"), F.lit(1_000_000)) < int(share * 1_000_000)).collect()) if parts > 1 else []  # about 20 keys a range
    cuts = sorted({drawn[k * len(drawn) // parts] for k in range(1, parts)}) if drawn else []
    bounds = rows.sparkSession.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect.bisect_right(bounds.value, key) for key in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["part", *order])

    first, last = {}, {}  # of each range, the key that ``reach`` pages reach to from its start and from its end
    if cuts:
        placed = keys.mapInArrow(place, "part int, host string, path string, query string, id long, link string")
        for into, way in ((first, [F.asc(c) for c in order]), (last, [F.desc(c) for c in order])):
            near_end = placed.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*way))).where(F.col("k") <= reach)
            found = near_end.groupBy("part").agg(F.max_by(F.struct(*order), "k").alias("key")).collect()  # a row for each range
            into.update({r.part: tuple(r.key) for r in found})
    ends = rows.sparkSession.sparkContext.broadcast((first, last))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in (b.slice(k, 512) for b in batches for k in range(0, len(b), 512)):
            zones, lines, hashes, take, at, own = [], [], [], [], [], []
            keys_of = zip(*(batch.column(c).to_pylist() for c in order), strict=True)
            for k, (page, key) in enumerate(zip(batch.column("html"), keys_of, strict=True)):
                got = lines_of(page.as_py())
                zones.append(bytes(z for z, _ in got))
                lines.append([t for _, t in got])
                hashes.append([xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for _, t in got])
                part = bisect.bisect_right(bounds.value, key)
                sent = [part]
                if bounds.value and key <= ends.value[0][part]:
                    sent.append(part - 1)
                if bounds.value and key >= ends.value[1][part]:
                    sent.append(part + 1)
                for to in sent:
                    take.append(k), at.append(to), own.append(to == part)
            whole = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", *order)), pa.array(zones, pa.binary()), pa.array(lines, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], names=["page_id", "url", *order, "zones", "lines", "hashes"])
            sent_rows = whole.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own, pa.bool_()), *sent_rows.columns], names=["part", "own", *whole.schema.names])

    parsed = map_in_python(keyed, parse, "part int, own boolean, page_id long, url string, host string, path string, query string, id long, link string, zones binary, lines array<string>, hashes array<long>")
    ordered = parsed.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", *order)

    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple[int, Parsed]]:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    some = batch.slice(at, 256)
                    part, own, page_id, url, host, zones, hashes = (some.column(c).to_pylist() for c in ("part", "own", "page_id", "url", "host", "zones", "hashes"))
                    for row in zip(part, own, page_id, url, host, zones, some.column("lines"), hashes, strict=True):
                        yield row[0], Parsed(*row[1:])

        done: list[tuple] = []
        names, types = ["page_id", "url", "text", "n_template"], [pa.int64(), pa.string(), pa.string(), pa.int64()]

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 4
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
            done.clear()
            return made

        size = 0
        for _, rows in groupby(rows_of(), key=lambda r: r[0]):
            for page, text, n in differenced((r for _, r in rows), reach):
                done.append((page.page_id, page.url, text, n))
                size += len(text)
                if size > 4 << 20:
                    yield out()
                    size = 0
        yield out()

    out = map_in_python(ordered.select("part", "own", "page_id", "url", "host", "zones", "lines", "hashes"), subtract, "page_id long, url string, text string, n_template long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")
