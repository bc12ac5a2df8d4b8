"""Main text of web pages: blocks from the markup, and differencing with the page of the nearest URL on the host."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialize, small_batches
from .url_filters import host_of, path_of

#: Comments, declarations and elements whose content is no text; then any tag.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|template|noscript|iframe|svg|textarea|title|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.I | re.S,
)
#: Elements that begin and end a block.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never main text.
_ASIDE = frozenset("nav header footer aside form menu dialog head button fieldset".split())
#: Elements that mark the main text.
_MAIN = frozenset(("article", "main"))
#: Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark what isn't main text, and words that may stand beside them in one name. A name with
#: any other word, such as social-history or post-notice, says nothing; the nearest page decides on its lines.
_SIDE_WORDS = re.compile(
    r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|side|header|masthead|footer|comments?|replies|disqus|"
    r"cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|search|toolbar|"
    r"pagination|pager|skip|complementary|contentinfo|navigation",
    re.I,
)
_BESIDE = frozenset(
    "site page main top bottom left right global primary secondary sub mobile desktop sticky fixed inner outer bar box list item items wrap wrapper container block blocks area "
    "section group links link button buttons form overlay panel column col row content slot unit policy posts articles stories icons media js has no with layout".split()
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[-_\s]+")
_SPACE = re.compile(r"\s+")


def _side_words(names: str) -> list[str]:
    """The words of class names that mark what isn't main text: of those names only that consist of such words and of
    words that may stand beside them."""
    out = []
    for name in names.split():
        parts = [w for w in _PARTS.split(name) if w]
        marks = [w for w in parts if _SIDE_WORDS.fullmatch(w)]
        if marks and all(w in marks or w.lower() in _BESIDE or w.isdigit() for w in parts):
            out += marks
    return out


@dataclass(frozen=True)
class Page:
    """Text blocks in page order; whether each is in an element that marks main text, and whether in one that is never
    main text."""

    lines: tuple[str, ...]
    main: tuple[bool, ...]
    side: tuple[bool, ...]


def parse(html: str | None) -> Page:
    """The blocks of a page. Character references are decoded and white space becomes one space; null is an empty page.
    Unclosed elements end with the one around them.

    What is left out by its class, id or role alone, like a layout "has-sidebar", may hold the main text: an article or
    main in it that isn't within main text already begins it again, but for an article whose own names say otherwise.
    A header within main text is that text's own."""
    html = html or ""
    lines: list[str] = []
    main: list[bool] = []
    side: list[bool] = []
    text: tuple[list[str], list[str]] = ([], [])  # of the block, and of what is left out within it
    stack: list[tuple[str, int, bool]] = []  # element, within what is left out (1: by its names alone), within main text
    opened: Counter = Counter()  # by name how often it is on the stack, so that a stray end tag isn't looked for
    out, inside = 0, False

    def end_block() -> None:
        for aside, parts in enumerate(text):
            if parts:
                line = _SPACE.sub(" ", unescape("".join(parts))).strip()
                parts.clear()
                if line:
                    lines.append(line)
                    main.append(inside and not aside)
                    side.append(bool(aside))

    at = 0
    for m in _MARKUP.finditer(html):
        if m.start() > at:
            text[out > 0].append(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in _BLOCKS:
            end_block()
        elif name == "br":
            text[out > 0].append(" ")
        if m[2]:
            if opened[name]:
                while (last := stack.pop()[0]) != name:
                    opened[last] -= 1
                opened[name] -= 1
                out, inside = stack[-1][1:] if stack else (0, False)
        elif name not in _VOID and not m[4].rstrip().endswith("/"):
            if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                stack.pop()  # its end tag is left out
                opened[name] -= 1
                out, inside = stack[-1][1:] if stack else (0, False)
            named = name not in ("html", "body") and any(
                word for a, b, c in _NAMES.findall(m[4]) for word in _side_words(a or b or c) if not (inside and word.lower() == "header")
            )
            if name not in _MAIN:
                out = max(out, 2 if name in _ASIDE and not (inside and name == "header") else int(named))
            elif out == 1 and not inside and not (named and name == "article"):
                out = 0
            inside = inside or name in _MAIN
            stack.append((name, out, inside))
            opened[name] += 1
    text[out > 0].append(html[at:])
    end_block()
    return Page(tuple(lines), tuple(main), tuple(side))


def common_lines(a: tuple, b: tuple) -> list[int]:
    """The places in a of a longest common subsequence of two lists of lines. Common beginnings and ends are cut off, and
    lines of one side only are left out. Of what remains, rows of the table are whole numbers of len(a) bits, so that
    long pages take len(b) steps over bits and not len(a) * len(b). Only every so many rows are kept, the square root of
    their number, and those between are made again on the way back: 200,000 lines a side need some 40 MB."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    there, here = set(b[low : len(b) - high]), set(a[low : len(a) - high])
    places = [i for i in range(low, len(a) - high) if a[i] in there]
    across = [line for line in b[low : len(b) - high] if line in here]
    where: dict[object, list[int]] = {}
    for k, i in enumerate(places):
        where.setdefault(a[i], []).append(k)
    n, every = len(places), (1 << len(places)) - 1

    def hits(line: object) -> int:
        found = where[line]
        if len(found) == 1:
            return 1 << found[0]
        bits = bytearray((n + 7) // 8)
        for k in found:
            bits[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(bits, "little")

    def after(row: int, line: object) -> int:
        hit = hits(line) & row
        return ((row + hit) | (row - hit)) & every

    step = max(1, math.isqrt(len(across)))
    row, saved = every, [every]
    for j, line in enumerate(across, start=1):
        row = after(row, line)
        if j % step == 0:
            saved.append(row)
    # A zero bit is a place of a at which the length of the common subsequence grows.
    out: list[int] = []
    i, j = n - 1, len(across)
    for block in range(len(across) // step if len(across) % step else len(across) // step - 1, -1, -1):
        rows = [saved[block]]
        for line in across[block * step : j]:
            rows.append(after(rows[-1], line))
        first = block * step
        while i >= 0 and j > first:
            if rows[j - first] >> i & 1:
                i -= 1
            elif not rows[j - 1 - first] >> i & 1:
                j -= 1
            else:
                out.append(places[i])
                i -= 1
                j -= 1
        j = min(j, first)
    return [*range(low), *out[::-1], *range(len(a) - high, len(a))]


def nearest(path: str, before: str | None, after: str | None) -> int:
    """-1 or 1 for the neighbour in path order that shares the longer beginning, 0 without neighbours."""
    alike = [-1 if p is None else next((k for k, (x, y) in enumerate(zip(path, p, strict=False)) if x != y), min(len(path), len(p))) for p in (before, after)]
    return 0 if max(alike) < 0 else -1 if alike[0] >= alike[1] else 1


def kept_lines(page: Page, shared: Collection[int]) -> list[int]:
    """The lines that a page's main text consists of: those that it doesn't share with its nearest page and that no
    element marks as something else. An article may quote what another page of the host quotes, or be a copy of it, so
    shared lines that the page itself marks as main text are restored."""
    return [k for k in range(len(page.lines)) if page.main[k] or not (page.side[k] or k in shared)]


def main_text(page: Page, shared: Collection[int]) -> str:
    return "\n\n".join(page.lines[k] for k in kept_lines(page, shared))


_DIGEST = "k1 bigint, k2 bigint"
_ROW = f"{_DIGEST}, host string, path string, lines array<bigint>"


def digests(pages: DataFrame) -> DataFrame:
    """pages (url, html) with a digest of both of 128 bits as k1 and k2."""
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    return pages.withColumns({"k1": F.xxhash64(url, html), "k2": F.xxhash64(F.lit("k2"), html, url)})


def outlines(pages: DataFrame) -> DataFrame:
    """k1, k2, host, path and lines (a digest of each line) of every different page that has a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [[xxh64_intdigest(x) - (1 << 63) for x in parse(html.as_py()).lines] for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "host", "path")), pa.array(lines, pa.list_(pa.int64()))], names=["k1", "k2", "host", "path", "lines"])

    url = F.col("url").cast("string")
    rows = digests(pages).select("k1", "k2", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, _ROW).filter("size(lines) > 0").dropDuplicates(["k1", "k2"])


def shared_lines(rows: DataFrame) -> DataFrame:
    """k1, k2 and shared (the numbers of the lines in a longest common subsequence with the nearest page) of outlines.

    Outlines are put in order of host, path and digest by ranges, so that a host of any size is spread over tasks. A
    page's nearest one is that neighbour on its host whose path begins most like its own. Pages in a row that have the
    same lines, such as mirrors, are one page here: their neighbours are the next pages that differ. A task settles all
    its pages but for the first and the last run of these; of each task's outer runs, at most four, the driver finds out
    from digests which are neighbours across the borders, so the result doesn't depend on where these lie.
    """
    spark = rows.sparkSession
    order = ["host", "path", "k1", "k2"]
    fields = f"part int, run int, kind string, {_ROW}, first_path string, shared array<int>"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []

        def record(kind: str, i: int, row: tuple, first_path: str | None = None, shared: list[int] | None = None) -> None:
            k1, k2, host, path, lines = row
            out.append((part, i, kind, k1, k2, host, path, None if kind == "done" else lines, first_path, shared))

        def edge(i: int, same: list[tuple]) -> None:
            record("edge", i, same[-1], same[0][3])

        def opened(i: int, same: list[tuple]) -> None:
            for row in same:
                record("open", i, row)

        def settled(i: int, before: list[tuple] | None, same: list[tuple], after: list[tuple]) -> None:
            finish = shares(*((x[at][2] == same[0][2] and (x[at][3], x[at][4])) or None for x, at in ((before, -1), (after, 0))))
            for row in same:
                record("done", i, row, shared=finish(row[3], row[4]))

        def flush() -> Iterator[pa.RecordBatch]:
            schema = {"kind": pa.string(), "host": pa.string(), "path": pa.string(), "first_path": pa.string(), "lines": pa.list_(pa.int64()), "shared": pa.list_(pa.int32()), "k1": pa.int64(), "k2": pa.int64()}
            for at in range(0, len(out), 4096):
                part_of = out[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part_of], schema.get(n, pa.int32())) for c, n in enumerate(names)], names=names)
            out.clear()

        runs: list[list[tuple]] = []  # the last three
        i = -1

        def close() -> None:
            """The newest run has all its rows."""
            if i in (0, 1):
                edge(i, runs[-1])
            if i == 0:
                opened(0, runs[-1])
            if i >= 2:
                settled(i - 1, *runs)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "host", "path", "lines")), strict=True):
                row = (*row[:4], tuple(row[4]))
                if runs and runs[-1][0][2] == row[2] and runs[-1][0][4] == row[4]:
                    runs[-1].append((*row[:4], runs[-1][0][4]))
                    continue
                if runs:
                    close()
                runs, i = [*runs[-2:], [row]], i + 1
            if len(out) > 4096:
                yield from flush()
        if runs:
            close()
            if i >= 1:
                opened(i, runs[-1])
            for k in (i - 1, i):
                if k > 1:
                    edge(k, runs[k - i - 1])
        yield from flush()

    passed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, fields), "page-runs")
    edges = passed.filter("kind = 'edge'")
    known = edges.select("part", "run", "host", "path", "first_path", F.md5(F.to_json("lines")).alias("digest")).orderBy("part", "run").collect()
    near = []  # part, run, and for each side part and run of the neighbour
    for n, own in enumerate(known):
        found: list[int | None] = []
        for step in (-1, 1):
            k = n + step
            while 0 <= k < len(known) and known[k].host == own.host and known[k].digest == own.digest:
                k += step
            found += [known[k].part, known[k].run] if 0 <= k < len(known) and known[k].host == own.host else [None, None]
        near.append((own.part, own.run, *found))
    table = spark.createDataFrame(near, "part int, run int, bp int, br int, ap int, ar int")
    before = edges.select(F.col("part").alias("bp"), F.col("run").alias("br"), F.col("path").alias("before"), F.col("lines").alias("before_lines"))
    after = edges.select(F.col("part").alias("ap"), F.col("run").alias("ar"), F.col("first_path").alias("after"), F.col("lines").alias("after_lines"))
    opened = passed.filter("kind = 'open'").join(table, ["part", "run"]).join(before, ["bp", "br"], "left").join(after, ["ap", "ar"], "left")

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("path", "lines", "before", "before_lines", "after", "after_lines"))
            known, finish, shared = None, None, []
            for path, lines, *ends in zip(*cols, strict=True):
                if ends != known:
                    known, finish = ends, shares(*((ends[k], tuple(ends[k + 1])) if ends[k + 1] is not None else None for k in (0, 2)))
                shared.append(finish(path, tuple(lines)))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(shared, pa.list_(pa.int32()))], names=["k1", "k2", "shared"])

    opened = opened.select("k1", "k2", "path", "lines", "before", "before_lines", "after", "after_lines").mapInArrow(border, f"{_DIGEST}, shared array<int>")
    return passed.filter("kind = 'done'").select("k1", "k2", "shared").unionByName(opened)


def shares(before: tuple | None, after: tuple | None):
    """A function that gives the lines which a page (path, lines) shares with the nearer of two (path, lines)."""
    seen: dict[tuple, list[int]] = {}

    def finish(path: str, lines: tuple) -> list[int]:
        side = nearest(path, *(x[0] if x else None for x in (before, after)))
        key = (side, lines)
        if key not in seen:
            seen.clear()  # rows in a row have the same lines
            seen[key] = common_lines(lines, (before if side < 0 else after)[1]) if side else []
        return seen[key]

    return finish


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_lines, n_shared, n_restored for each row of pages; other columns aren't
    read.

    Every page's lines are compared with those of the nearest page of its host that differs (`shared_lines`): n_shared of
    its n_lines are also there, and are deleted, but for n_restored that the page marks as its main text. Only digests of
    lines are put in order; the numbers of shared lines are joined back to the pages by a digest of url and html. Null
    pages give an empty text, null urls count as one host without a name. Repeated rows are one page, and give repeated
    rows.
    """
    small_batches(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    shared = shared_lines(outlines(pages))
    url, html = F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    rows = digests(pages).select("page_id", url, html, "k1", "k2").join(shared, ["k1", "k2"], "left").select("page_id", "url", "html", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for html, same in zip(batch.column("html"), batch.column("shared").to_pylist(), strict=True):
                page, same = parse(html.as_py()), set(same or ())
                texts.append(main_text(page, same))
                counts.append((len(texts[-1]), len(page.lines), len(same), sum(page.main[k] for k in same)))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), *numbers], names=["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_restored"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint, n_lines bigint, n_shared bigint, n_restored bigint")
