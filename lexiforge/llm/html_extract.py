"""Main text of web pages: nearest-URL page differencing on top of the page's own marks.

A page is read into text lines, one per block, each with what its markup says:
*main* (inside ``article`` or ``main``), *aside* (inside navigation, footers,
adverts, forms, comments and the like) or *open*. Pages are paired by URL: in
path order within each host the nearest page is the neighbour with the longer
common path. Their lines are aligned by longest common subsequence (of repeated
lines the k-th matches the k-th), and shared lines are the template. The text is
the main lines where the page marks any, since a passage that two articles
quote belongs to both; elsewhere the open lines that are not shared.

Only line hashes are shuffled for the pairing; a hot host is cut into ranges by
``ordered_index``; a task holds one page and its two neighbours at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lexiforge.llm.common import NULL_ID, sized_slices
from lexiforge.llm.url_reputation import host_path
from lexiforge.operators.ordering import ordered_index
from lexiforge.session import stored

MAIN, ASIDE, OPEN = "m", "a", "o"

# ---- fixed values: what HTML elements and common class names mean ------------------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = set("script style title textarea noscript template iframe xmp noembed noframes".split())
BLOCKS = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
             "table tbody td tfoot th thead tr ul".split())
ASIDE_TAGS = set("head nav footer aside form button select option dialog menu svg canvas object audio video map search".split())
MAIN_TAGS = {"article", "main"}
#: Words of class, id and role attributes.
ASIDE_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu menubar "
                  "breadcrumb breadcrumbs footer contentinfo sidebar aside complementary notice notices alert cookie cookies consent "
                  "popup modal comment comments respond reply replies discussion disqus".split())
#: The same, but for the head of an article itself.
HEADER_WORDS = {"header", "masthead", "banner"}
#: Closed by the next one of the same kind, up to the list or table that holds them.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
            "option": {"option"}}
BUT_P = BLOCKS - {"p"}
HOLDERS = set("ul ol dl table menu select".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
                 r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.DOTALL)  # the second form: odd quotes
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _mark(tag: str, attributes: str, inside: str) -> str:
    """What an element says about its content, inside one that says ``inside``."""
    if inside == ASIDE or tag in ASIDE_TAGS or (tag == "header" and inside == OPEN):
        return ASIDE
    if attributes and tag not in ("html", "body"):
        for name, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values)
            words = {w.lower() for w in WORDS.findall(value)}
            if name.lower() == "hidden" or words & ASIDE_WORDS or (inside == OPEN and words & HEADER_WORDS):
                return ASIDE
            if name.lower() == "role" and value.lower() == "main":
                return MAIN
    return MAIN if tag in MAIN_TAGS else inside


def page_lines(html: str) -> list[tuple[str, str]]:
    """(mark, text) of every block with text, in page order; white space is one blank, character references are decoded."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements and their marks
    is_open: Counter = Counter()
    parts: list[str] = []
    mark = line_mark = OPEN

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            out.append((line_mark, text))
        parts.clear()

    def pop_through(at: int):
        for t, _ in stack[at:]:
            is_open[t] -= 1
        del stack[at:]

    at, pos = 0, 0
    while True:
        m = TAG.search(html, pos)
        end = m.start() if m else len(html)
        if end > at:
            if mark != line_mark:  # an inline element that is marked on its own
                flush()
                line_mark = mark
            parts.append(unescape(html[at:end]))
        if not m:
            break
        at = pos = m.end()
        closing, tag, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            if is_open[tag] > 0:
                pop_through(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        elif tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, pos)
            at = pos = end.start() if end else len(html)
        elif tag not in VOID:
            if tag in BLOCKS and is_open["p"]:
                _close(stack, is_open, {"p"}, BUT_P, pop_through)
            if tag in SIBLINGS:
                _close(stack, is_open, SIBLINGS[tag], HOLDERS, pop_through)
            if not attributes.rstrip().endswith("/") or tag in BLOCKS:
                stack.append((tag, _mark(tag, attributes, stack[-1][1] if stack else OPEN)))
                is_open[tag] += 1
        mark = stack[-1][1] if stack else OPEN
        if not parts:
            line_mark = mark
    flush()
    return out


def _close(stack, is_open, tags: set, stop: set, pop_through) -> None:
    """Close the outermost of ``tags`` that is open above the last of ``stop``."""
    if not any(is_open[t] for t in tags):
        return
    found = None
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in tags:
            found = i
        elif stack[i][0] in stop:
            break
    if found is not None:
        pop_through(found)


def shared_lines(own: np.ndarray, other: np.ndarray) -> list[int]:
    """Positions in ``own`` of a longest common subsequence, where the k-th of equal lines matches the k-th: n log n steps."""
    seen, place = Counter(), {}
    for j, h in enumerate(other.tolist()):
        place[h, seen[h]] = j
        seen[h] += 1
    seen = Counter()
    ends: list[int] = []      # least last position in ``other`` of an increasing sequence of each length
    last: list[int] = []      # its line of ``own``
    before: dict[int, int] = {}
    for i, h in enumerate(own.tolist()):
        j = place.get((h, seen[h]))
        seen[h] += 1
        if j is None:
            continue
        k = bisect_left(ends, j)
        before[i] = last[k - 1] if k else -1
        ends[k:k + 1], last[k:k + 1] = [j], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def kept_text(lines: list[tuple[str, str]], shared: list[int]) -> str:
    """Main lines, or the open lines that are not shared where the page marks none."""
    if any(m == MAIN for m, _ in lines):
        return "\n".join(t for m, t in lines if m == MAIN)
    template = set(shared)
    return "\n".join(t for k, (m, t) in enumerate(lines) if m == OPEN and k not in template)


def _line_hashes(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in sized_slices(b, "html", 4_000_000):
            texts = [[xxh64_intdigest(t) for _, t in page_lines(h)] for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "host", "path", "k1", "k2")),
                                              pa.array([np.array(t, "<u8").tobytes() for t in texts], pa.binary())],
                                             ["page_id", "host", "path", "k1", "k2", "lines"])


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _align(batches) -> Iterator[pa.RecordBatch]:
    """Each page against the nearer of its neighbours whose lines differ from its own."""
    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        for near in b.column("near"):
            near = {r["step"]: r for r in near.as_py()}
            own = near.get(0)
            if own is None:
                continue
            others = [r for step, r in sorted(near.items()) if step and r["lines"] != own["lines"]]
            best = max(others, key=lambda r: _common_prefix(own["path"], r["path"]), default=None)
            lines = np.frombuffer(own["lines"], "<u8")
            shared = shared_lines(lines, np.frombuffer(best["lines"], "<u8")) if best else []
            for c, v in zip(out, (own["k1"], own["k2"], best["page_id"] if best else None, len(lines), len(shared),
                                  np.array(shared, "<u4").tobytes())):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                         ["d1", "d2", "nearest_page_id", "n_lines", "n_shared", "shared"])


def _extract(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in sized_slices(b, "html", 4_000_000):
            texts = [kept_text(page_lines(h), np.frombuffer(s or b"", "<u4").tolist())
                     for h, s in zip(part.column("html").to_pylist(), part.column("shared").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), *(part.column(c) for c in ("nearest_page_id", "n_lines", "n_shared"))],
                ["page_id", "url", "text", "n_chars", "nearest_page_id", "n_lines", "n_shared"])


def template_lines(pages: DataFrame) -> DataFrame:
    """``d1, d2`` (of a distinct page)``, nearest_page_id, n_lines, n_shared, shared`` (numbers of the shared lines).

    ``pages``: ``page_id, url, html, host, path, k1, k2`` without nulls but in ``url``.
    """
    hashes = pages.select("page_id", "host", "path", "k1", "k2", "html").mapInArrow(
        _line_hashes, "page_id long, host string, path string, k1 long, k2 long, lines binary")
    distinct = hashes.groupBy("host", "path", "k1", "k2").agg(F.min("page_id").alias("page_id"), F.first("lines").alias("lines"))
    placed = ordered_index(distinct, ["host"], ["path", "k1", "k2"], out="at")
    # every page goes to its own place and to those of its two neighbours: at most three rows meet
    sent = placed.withColumn("step", F.explode(F.array(*[F.lit(s) for s in (-1, 0, 1)])))
    near = sent.groupBy("host", (F.col("at") - F.col("step")).alias("place")).agg(
        F.collect_list(F.struct("step", "page_id", "path", "k1", "k2", "lines")).alias("near"))
    return near.select("near").mapInArrow(
        _align, "d1 long, d2 long, nearest_page_id long, n_lines long, n_shared long, shared binary")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, nearest_page_id, n_lines, n_shared`` for every row of ``pages``.

    ``text`` is empty where a page has none (null and empty HTML too). ``n_lines``
    counts the page's blocks with text, ``n_shared`` those that it shares with
    ``nearest_page_id``: of its two neighbours by path within the host the one of
    longer common path (the earlier on ties), leaving out pages whose lines are all
    the same; null if there is none. Pages without a host (null URL) are a host of
    their own. Equal rows are one page for the pairing and get a row each; a null
    identifier stays null. An empty table gives no rows.
    """
    url, html = F.col(f"`{url_col}`").cast("string"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    host, path = host_path(url)
    named = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), host.alias("host"),
                         path.alias("path"), F.xxhash64(url, html).alias("k1"), F.xxhash64(F.lit(1), html, url).alias("k2"))
    template = stored(template_lines(named.withColumn("page_id", F.coalesce("page_id", F.lit(NULL_ID)))), "template-lines")
    same = (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2"))
    both = named.select("page_id", "url", "html", "k1", "k2").join(template, same, "left").select(
        "page_id", "url", "html", "nearest_page_id", "n_lines", "n_shared", "shared")
    out = both.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, nearest_page_id long, n_lines long, n_shared long")
    return out.withColumn("nearest_page_id", F.when(F.col("nearest_page_id") != NULL_ID, F.col("nearest_page_id")))
