"""Main text of web pages by nearest-URL page differencing.

A page is cut into blocks of text in page order. Pages are sorted by host and
path. A page's partner is the nearest page of the host, before or after it, that
is not a copy: the one that shares more leading path segments (then letters).
The blocks of both are aligned by longest common subsequence and shared ones are
taken out: they are the site's, not the page's.

The markup settles what differencing alone gets wrong. Paragraphs, headings and
items inside `article` or `main` that are not links alone are the page's own
words even where a neighbour has the same sentence; elements that are menus,
headers, footers, sidebars, notices, adverts, forms or comments by tag, role or
class never count. Inside `article` or `main` only whole class and id names say
so, or, on boxes, names that are made of such words alone (`comment-list`,
`ad-slot`, but not `related-work`); elsewhere their parts do too. A page without a partner is its `article` or
`main` where it has one. Pages that share nine tenths of their letters both ways
are copies of one article.

Scale: host, path and a hash of the text are range-partitioned, a few ids at the
borders of ranges reach the driver (six rows for each range at most), and the HTML is
shuffled once to its range. The last page before a range goes to it too, with
the last ones before that with another text, and with another path and text, and
likewise after it, so the partner does not hang on the ranges, but for copies
that differ a little in text and in path and fill a whole range. A host may span
any number of ranges. A worker holds the copies next to each other, no more.

Nulls and edges: null HTML is an empty page, a null or relative URL has no
partner, equal URLs are ordered by page_id, repeated rows are rows, a missing
end tag ends with its parent, extra columns are ignored, an empty table gives
an empty table.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

COPY_SHARE = 0.9
#: Bits of alignment table held at once; larger ones are split in halves.
TABLE_BITS = 1 << 28

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "audio", "video"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_OWN = {"article", "main"}
_SLUGGED = set("h1 h2 h3 h4 h5 h6 p".split())
_PROSE = _SLUGGED | set("blockquote pre li dt dd td th caption figcaption".split())
_DROPPED = set("head nav footer aside form button select menu dialog fieldset option".split())
_ROLES = set("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
_CLASSES = set(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments "
    "disqus respond share sharing social related recommended widget popup modal overlay pagination pager toolbar login signup search skip".split())
#: Inside article or main, a name made of these alone, one of the first kind at least, says what an element is: comment-list, ad-slot.
_KINDS = set("ad ads advert adverts advertisement comment comments disqus newsletter promo promoted related reply replies respond share sharing sponsor sponsored subscribe".split())
_PARTS = set("area articles bar block body box button buttons container content count form header inner item items links list main outer panel post posts section slot "
             "stories thread threads title top unit widget wrap wrapper zone".split())
_BOXES = set("aside dl div ol section ul".split())
_CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = set("article main section div td th li body table ul ol form nav aside header footer blockquote".split())


def _says_kind(name: str) -> bool:
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return any(x in _KINDS for x in parts) and all(x in _KINDS or x in _PARTS for x in parts)


def _unwanted(tag: str, attributes: str, inside_own: bool) -> bool:
    if tag in _DROPPED or tag == "header" and not inside_own:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    names = set(found.get("class", "").split())
    if tag not in _SLUGGED:
        names.add(found.get("id", "").strip())
    if inside_own and tag in _BOXES and any(_says_kind(name) for name in names):
        return True
    if tag == "article" or not inside_own:
        names = {x for name in names for x in re.split(r"[^a-z0-9]+", name)}
    if tag == "article":
        return bool(names & {"comment", "comments"})
    return (bool(names & _CLASSES) or found.get("role") in _ROLES or found.get("aria-hidden") == "true" or "hidden" in found
            or bool(re.search(r"(?:^|\s)hidden(?:[\s/]|$)", _ATTRIBUTE.sub(" ", attributes), re.I)) or "display:none" in found.get("style", "").replace(" ", ""))


def blocks(page: str | None) -> list[tuple[str, int, bool]]:
    """(text, 1 within article or main and 2 in prose there, within an unwanted element) of each block in page order."""
    page, out, words, at, plain = page or "", [], [], 0, False
    top = (None, False, 0, False, False)
    stack: list[tuple[str, bool, int, bool, bool]] = []  # tag, own, unwanted (1 for a form alone), prose, link

    def add(raw: str) -> None:
        nonlocal plain
        words.append(html.unescape(raw))
        plain = plain or not (stack and stack[-1][4]) and not raw.isspace() and bool(raw)

    def flush() -> None:
        nonlocal plain
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            _, own, bad, prose, _ = stack[-1] if stack else top
            out.append((text, own + (own and prose and plain), bad > 0))
        plain = False

    while m := _MARKUP.search(page, at):
        if m.start() > at:
            add(page[at: m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in _INLINE and not m[3]:
            if not m[1]:
                stack.append((tag, *(stack[-1] if stack else top)[1:]))
            elif stack and stack[-1][0] == tag:
                stack.pop()
            continue
        if tag == "br":
            words.append(" ")
            continue
        if m[1]:  # an end tag closes its element and what is open inside
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                if tag not in _INLINE:
                    flush()
                del stack[k:]
            continue
        if tag not in _INLINE:
            flush()
        if tag in _RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            continue
        closing = {"p"} if tag in _CLOSES_P else _SAME.get(tag, set())
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closing:
                    del stack[i:]
                    break
                if stack[i][0] in _FENCE:
                    break
        _, own, bad, prose, link = stack[-1] if stack else top
        drop = _unwanted(tag, m[3], own)
        if tag in _INLINE and drop:
            flush()
        if drop:
            bad = max(bad, 1 if tag == "form" else 2)
        elif tag == "main" or tag == "article" and bad == 1:
            bad = 0
        stack.append((tag, own or tag in _OWN and not drop, bad, tag in _PROSE or tag in _INLINE and prose, link or tag == "a"))
    add(page[at:])
    flush()
    return out


def _bits(a: list[int], b: list[int]) -> Iterator[int]:
    """After each of `a`: zero bits mark where the common subsequence with a prefix of `b` grows."""
    full, mask = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        mask[x] = mask.get(x, 0) | 1 << j
    v = full
    for x in a:
        u = v & mask.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(v: int, n: int) -> np.ndarray:
    raw = np.frombuffer(v.to_bytes(-(-n // 8), "little"), np.uint8)
    return np.append(0, np.cumsum(1 - np.unpackbits(raw, bitorder="little", count=n).astype(np.int64)))


def _common(a: list[int], b: list[int]) -> list[int]:
    """Places in `a` of a longest common subsequence."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        for v in _bits(a[:half], b):
            pass
        for w in _bits(a[:half - 1:-1], b[::-1]):
            pass
        cut = int(np.argmax(_lengths(v, len(b)) + _lengths(w, len(b))[::-1]))
        return _common(a[:half], b[:cut]) + [half + i for i in _common(a[half:], b[cut:])]
    full, rows, out, j = (1 << len(b)) - 1, list(_bits(a, b)), [], len(b)
    for i in range(len(a) - 1, -1, -1):
        low = (1 << j) - 1
        grown = (full ^ rows[i]) & low
        before = (full ^ rows[i - 1]) & low if i else 0
        if grown.bit_count() > before.bit_count():
            # the match of a[i]: the last place where its row grows and the row before does not reach as far
            j = grown.bit_length() - 1
            out.append(i)
    return out[::-1]


def shared_lines(a: list, b: list) -> list[bool]:
    """Which of a's lines lie on a longest common subsequence of a and b."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    there = set(b[start: len(b) - end])
    mine = [i for i in range(start, len(a) - end) if a[i] in there]
    here = {a[i] for i in mine}
    out = [i < start or i >= len(a) - end for i in range(len(a))]
    for k in _common([a[i] for i in mine], [x for x in b[start: len(b) - end] if x in here]):
        out[mine[k]] = True
    return out


def are_copies(a: list[tuple[str, int, bool]], b: list[tuple[str, int, bool]]) -> bool:
    """Whether two pages share nine tenths of their wanted letters both ways."""
    x, y = ([t for t, _, bad in p if not bad] for p in (a, b))
    if x == y:
        return True
    least, there = COPY_SHARE * max(sum(map(len, x)), sum(map(len, y))), set(y)
    if min(sum(map(len, x)), sum(map(len, y))) < least or sum(len(t) for t in x if t in there) < least:
        return False
    return sum(len(t) for t, s in zip(x, shared_lines(x, y), strict=True) if s) >= least


def main_text(page: list[tuple[str, int, bool]], partner: list[tuple[str, int, bool]] | None) -> tuple[str, int]:
    """The page's main text, and the number of blocks deleted as shared with its partner."""
    wanted = [not bad for _, _, bad in page]
    if not partner or are_copies(page, partner):
        if any(own and w for (_, own, _), w in zip(page, wanted, strict=True)):
            wanted = [w and own > 0 for (_, own, _), w in zip(page, wanted, strict=True)]
        return " ".join(t for (t, _, _), w in zip(page, wanted, strict=True) if w), 0
    shared = shared_lines([t for t, _, _ in page], [t for t, _, _ in partner])
    gone = [s and w and own < 2 for s, w, (_, own, _) in zip(shared, wanted, page, strict=True)]
    return " ".join(t for (t, _, _), w, g in zip(page, wanted, gone, strict=True) if w and not g), sum(gone)


def _nearness(a: str, b: str) -> tuple[int, int]:
    x, y = a.split("/"), b.split("/")
    return tuple(next((i for i, (p, q) in enumerate(zip(m, n)) if p != q), min(len(m), len(n))) for m, n in ((x, y), (a, b)))  # noqa: B905


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range's first and last row, and from both ends the next one with another text, and with another path and text."""
    first, last = [], []  # rows by how they differ: not at all, in text, in path and text

    def differ(a: tuple, b: tuple) -> list[bool]:
        return [True, a[3] != b[3], a[3] != b[3] and a[1] != b[1]]

    now, text, other = None, None, None  # the last row, the last one with another text, with another path and text
    by_path = [None, None]  # of the path before this one: its last row, and its last row with another text than that
    for batch in batches:
        for row in zip(*(batch[x].to_pylist() for x in ("host", "path", "id", "sign")), strict=True):
            if not first:
                first = [row, None, None]
            for k, d in enumerate(differ(row, first[0])):
                if d and first[k] is None:
                    first[k] = row
            if now and now[:2] != row[:2]:
                by_path = [now, text]
            if now and now[3] != row[3]:
                text = now
            now = row
            other = next((x for x in by_path if x and x[3] != row[3]), other if other and other[3] != row[3] else None)
    if now:
        last = [now, text, other]
        rows = [x for x in (*first, *last) if x]
        yield pa.record_batch([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["host", "path", "id", "sign"])


def _guests(firsts: list[tuple], marks: list[tuple]) -> dict[tuple, list[int]]:
    """Rows (host, path, id, sign) at borders that other ranges need too: (host, path, id) -> ranges."""
    out: dict[tuple, list[int]] = {}
    at = [bisect_right(firsts, m[:3]) - 1 for m in marks]
    for part in range(len(firsts)):
        before, after = range(bisect_left(at, part) - 1, -1, -1), range(bisect_right(at, part), len(marks))
        for ks in (before, after):
            near, kinds = marks[ks[0]] if ks else None, set()
            for m in (marks[k] for k in ks):
                if m[0] != near[0] or len(kinds) == 3:
                    break
                mine = {0} | ({1} if m[3] != near[3] else set()) | ({2} if m[3] != near[3] and m[1] != near[1] else set())
                if mine - kinds:
                    kinds |= mine
                    if part not in out.setdefault(m[:3], []):
                        out[m[:3]].append(part)
    return out


def _dealt(firsts: list[tuple], guests: dict[tuple, list[int]]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, to, guest = [], [], []
            for i, key in enumerate(zip(batch["host"].to_pylist(), batch["path"].to_pylist(), (x if x is not None else -1 for x in batch["page_id"].to_pylist()), strict=True)):
                own = max(0, bisect_right(firsts, key) - 1)
                for part, is_guest in ((own, False), *((x, True) for x in guests.get(key, ()) if x != own)):
                    rows.append(i)
                    to.append(part)
                    guest.append(is_guest)
            for s in range(0, len(rows), 2000):
                part = batch.take(pa.array(rows[s: s + 2000]))
                yield pa.record_batch([*part.columns, pa.array(to[s: s + 2000], pa.int32()), pa.array(guest[s: s + 2000])], [*part.schema.names, "range", "guest"])
    return emit


def _partnered(pages: Iterator[dict]) -> Iterator[tuple[dict, dict | None]]:
    """Each page with the nearest one of its host, before or after it, that is not a copy."""
    last, waiting = None, []

    def settled(p: dict, after: dict | None) -> tuple[dict, dict | None]:
        sides = [x for x in (p["before"], after) if x]
        return p, max(sides, key=lambda x: _nearness(x["path"], p["path"])) if sides else None  # the earlier of equals

    for now in pages:
        same = last is not None and last["range"] == now["range"] and last["host"] == now["host"] and bool(now["host"])
        if not same:
            yield from (settled(p, None) for p in waiting)
            waiting, now["before"] = [], None
        else:
            before = last
            while before and are_copies(now["blocks"], before["blocks"]):
                if now["blocks"] == before["blocks"]:
                    now["blocks"] = before["blocks"]
                before = before["before"]
            now["before"] = before
            if before and before["before"] and before["before"]["before"]:
                before["before"]["before"]["before"] = None  # no chain through the whole host
            if before is last:
                still = [are_copies(p["blocks"], now["blocks"]) for p in waiting]
                yield from (settled(p, now) for p, s in zip(waiting, still, strict=True) if not s)
                waiting = [p for p, s in zip(waiting, still, strict=True) if s]
        waiting.append(now)
        last = now
    yield from (settled(p, None) for p in waiting)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pages():
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                for r in batch.slice(s, 64).to_pylist():
                    yield r | {"blocks": blocks(r.pop("html"))}

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                               ["page_id", "url", "text", "n_chars", "partner_id", "n_deleted"])

    out, same = [], (None, None, None)  # copies next to each other have one result
    for now, partner in _partnered(pages()):
        if now["guest"]:
            continue
        other = partner["blocks"] if partner else None
        if now["blocks"] is not same[0] or other is not same[1]:
            same = (now["blocks"], other, main_text(now["blocks"], other))
        text, deleted = same[2]
        out.append((now["page_id"], now["url"], text, len(text), partner["page_id"] if partner else None, deleted))
        if len(out) >= 500:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per row of (page_id, url, html): page_id, url, text, n_chars, partner_id, n_deleted."""
    c.bounded_batches(pages.sparkSession)
    address = c.or_empty("url")
    host = F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(address, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    source = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"))
    order = ["host", "path", "page_id"]
    n = 4 * c.width(pages.sparkSession)
    words = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    narrow = source.select("host", "path", F.coalesce("page_id", F.lit(-1)).alias("id"), F.xxhash64(words).alias("sign"))
    marks = narrow.repartitionByRange(n, "host", "path", "id").sortWithinPartitions("host", "path", "id").mapInArrow(
        c.task(_borders), "host string, path string, id long, sign long").withColumn("range", F.spark_partition_id()).collect()  # six rows for each range at most
    least: dict[int, tuple] = {}
    for r in marks:
        least[r["range"]] = min(least.get(r["range"], tuple(r)[:3]), tuple(r)[:3])
    firsts = sorted(least.values())
    dealt = source.mapInArrow(c.task(_dealt(firsts, _guests(firsts, sorted({tuple(r)[:4] for r in marks})))),
                              "page_id long, url string, html string, host string, path string, range int, guest boolean")
    ordered = dealt.repartition(c.width(pages.sparkSession), "range").sortWithinPartitions("range", *order)
    return ordered.mapInArrow(c.task(_extracted), "page_id long, url string, text string, n_chars long, partner_id long, n_deleted long")
