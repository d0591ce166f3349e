"""Main text of web pages by nearest-URL page differencing.

A page is read into lines: the text of its blocks in page order, each with the containers it stands in.
Within each host, pages are ordered by URL path; a page's partner is the one of its two neighbours that
shares the longer path prefix, of those whose lines differ from its own (a copy tells nothing). The line
sequences of the partners are aligned by a longest common subsequence, and lines in it are deleted as
furniture of the site.

Two checks follow, since differencing alone can't tell an article that a site shows twice from a menu, nor
see a menu whose words differ on every page. (1) Where a page marks its article (article, main), a deleted
line inside it is restored, and what stands outside goes; elsewhere differencing decides alone. (2) Lines
in containers that are never main text (nav, header, footer, aside, forms, scripts, and elements whose
class, id or role names a sidebar, notice, advert, comment thread ...) go.

A page is parsed once; its lines are packed and held. Ordering and pairing move only host, path and 32-bit
line hashes. Rows get global numbers by a range sort and are paired in blocks of ``BLOCK`` rows, each with
its two bordering rows, so a hot host is spread over many tasks. Packed pages move only if they may have
shared lines (a bitmap of fixed size tells).

Defined results: a null html is an empty page, with empty text; a null or odd url forms the host ''; a
host with one page has no partner, and only the checks apply; equal rows each come out; other columns are
ignored. Parsing takes time in proportion to a page's length, whatever its nesting; alignment up to the
product of the partners' shared lines, in bounded memory: beyond ``CELLS`` it divides the longer page, which
may choose another of several subsequences of the same length.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.cluster import bitmap, held, maybe_in
from tidemill.llm.sharding import numbered

BLOCK, CELLS = 512, 1 << 22

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"\s+")

RAW = frozenset(["script", "style", "template", "noscript", "iframe", "object", "svg", "math", "textarea", "noframes", "noembed", "xmp"])
HIDDEN = frozenset(["head", "title", "select", "datalist", "canvas", "audio", "video", "map"])
FURNITURE = frozenset(["nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "search"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend option".split()
)
#: Names in class, id or role of containers that hold no main text.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menus?|breadcrumbs?|sidebars?|side|widgets?|footers?|header|masthead|comments?|replies|reply|respond|disqus|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search\w*|share|sharing|social|related|recommend\w*|pager|pagination|copyright|toolbar|skip|complementary|contentinfo|navigation|hidden)(?:$|[\s_-])",
    re.I,
)


@dataclass
class Line:
    text: str
    inside: bool
    furniture: bool


class Stack:
    """Open elements, with counts of what holds for the current place; each operation takes amortized constant time."""

    def __init__(self) -> None:
        self.open: list[tuple[str, tuple[bool, bool, bool]]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.furniture = self.article = self.hidden = 0

    def push(self, tag: str, furniture: bool, article: bool, hidden: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, (furniture, article, hidden)))
        self.furniture, self.article, self.hidden = self.furniture + furniture, self.article + article, self.hidden + hidden

    def close(self, index: int) -> None:
        """Closes the element at the index and all inside it."""
        while len(self.open) > index:
            tag, (furniture, article, hidden) = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.furniture, self.article, self.hidden = self.furniture - furniture, self.article - article, self.hidden - hidden

    def last(self, tag: str) -> int | None:
        found = self.places.get(tag)
        return found[-1] if found else None


#: Blocks that a block's start tag closes, if one of them is the innermost open block.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}


def lines_of(page: str) -> list[Line]:
    """Blocks of a page in order."""
    stack = Stack()
    out: list[Line] = []
    buffer: list[str] = []
    page = page.replace("\x00", "\ufffd")

    def flush() -> None:
        if buffer:
            text = SPACES.sub(" ", "".join(buffer)).strip()
            buffer.clear()
            if text:
                out.append(Line(text, stack.article > 0, stack.furniture > 0))

    def put(text: str) -> None:
        if text and not stack.hidden:
            buffer.append(entities.unescape(text) if "&" in text else text)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                put(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if m[1]:
            if block:
                flush()
            elif tag == "br":
                put(" ")
            index = stack.last(tag)
            # an inline element's end doesn't reach out of a block
            if index is not None and (block or not stack.blocks or stack.blocks[-1] < index):
                stack.close(index)
            continue
        single = m[3].endswith("/")
        if tag in RAW:
            if not (single and tag in ("svg", "math")):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            put(" ")
            continue
        if tag in ("br", "wbr"):
            put(" " if tag == "br" else "")
            continue
        if block:
            flush()
            shut = CLOSES.get(tag, ("p",))
            while stack.blocks and stack.open[stack.blocks[-1]][0] in shut:
                stack.close(stack.blocks[-1])
        if tag in VOID or single and not block:
            continue
        named, gone = False, tag in HIDDEN
        if m[3] and not m[3].isspace():
            found = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[3])}
            words = " ".join(found.get(x, "") for x in ("class", "id", "role"))
            named = bool(words.strip()) and tag not in ("body", "html", "article", "main") and bool(NAMES.search(words))
            gone = gone or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        header = tag == "header" and not stack.article
        stack.push(tag, tag in FURNITURE or named or header, tag in ("article", "main"), gone)
    flush()
    return out


def _next_row(row: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The lengths of common subsequences with one line more, from those without it and where the line occurs."""
    out = row.copy()
    out[1:] = np.maximum(out[1:], np.where(same, row[:-1] + 1, 0))
    return np.maximum.accumulate(out)


def common(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Which of a's lines are in a longest common subsequence of a and b."""
    hit = np.zeros(len(a), bool)
    lo, i, j = 0, len(a), len(b)
    while lo < min(i, j) and a[lo] == b[lo]:
        hit[lo] = True
        lo += 1
    while i > lo and j > lo and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
        hit[i] = True
    # lines that the other page lacks can't take part
    ia, jb = lo + np.flatnonzero(np.isin(a[lo:i], b[lo:j])), lo + np.flatnonzero(np.isin(b[lo:j], a[lo:i]))
    x, y = a[ia], b[jb]
    if not len(x) or not len(y):
        return hit
    if len(x) == 1 or len(x) * len(y) <= cells:
        table = [np.zeros(len(y) + 1, np.int32)]
        for line in x:
            table.append(_next_row(table[-1], y == line))
        p, q = len(x), len(y)
        while p and q:
            if table[p][q] == table[p - 1][q]:
                p -= 1
            elif table[p][q] == table[p][q - 1]:
                q -= 1
            else:
                hit[ia[p - 1]] = True
                p, q = p - 1, q - 1
        return hit
    # long pages: divided by the middle of a (Hirschberg), in memory of one row
    half = len(x) // 2

    def lengths(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        row = np.zeros(len(v) + 1, np.int32)
        for line in u:
            row = _next_row(row, v == line)
        return row

    cut = int(np.argmax(lengths(x[:half], y) + lengths(x[half:][::-1], y[::-1])[::-1]))
    hit[ia[:half]] = common(x[:half], y[:cut], cells)
    hit[ia[half:]] = common(x[half:], y[cut:], cells)
    return hit


def address(url: str | None) -> tuple[str, str]:
    """Host and path; the path without query, fragment and closing slash."""
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", re.split(r"[?#]", url or "", maxsplit=1)[0].rstrip("/")
    return m[1].lower(), unquote(m[2]).rstrip("/")


def _line_hashes(lines: list[Line]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(x.text.encode("utf-8", "replace")) for x in lines], np.uint32).view(np.int32)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, path, line hashes, and packed all lines that can be in the text: [number, text, restored if shared]."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        hosts, paths, hashes, packed = [], [], [], []
        for url, page in zip(b.column("url").to_pylist(), b.column("page").to_pylist(), strict=True):
            host, path = address(url)
            found = lines_of(page or "")
            article = any(x.inside for x in found)
            hosts.append(host)
            paths.append(path)
            hashes.append(_line_hashes(found).tobytes())
            left = [(i, x.text, x.inside) for i, x in enumerate(found) if keep(x, False, article)]
            packed.append(pack.compress(json.dumps(left, ensure_ascii=False).encode("utf-8", "replace")))
        arrays = [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), *(b.column(c) for c in ("i", "url", "k", "h", "kh")), pa.array(hashes, pa.binary()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["host", "path", "i", "url", "k", "h", "kh", "lines", "z"])


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            for p, q in zip(x, y, strict=False):
                if p != q:
                    break
                n += 1
            break
        n += 1000
    return n


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and number; for every row of a block, which lines its partner shares."""

    def run(rows: list[dict]) -> pa.RecordBatch | None:
        k, h, gone = [], [], []
        for i, r in enumerate(rows):
            if not r["own"]:
                continue
            near = [rows[x] for x in (i - 1, i + 1) if 0 <= x < len(rows) and rows[x]["host"] == r["host"] and rows[x]["lines"] != r["lines"]]
            if not near:
                continue
            partner = max(near, key=lambda x: _prefix(r["path"], x["path"]))
            hit = np.flatnonzero(common(np.frombuffer(r["lines"], np.int32), np.frombuffer(partner["lines"], np.int32)))
            if len(hit):
                k.append(r["k"])
                h.append(r["h"])
                gone.append(hit.astype(np.int32).tobytes())
        if not k:
            return None
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(h, pa.int64()), pa.array(gone, pa.binary())], names=["k", "h", "gone"])

    rows: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if rows and rows[-1]["block"] != r["block"]:
                if (out := run(rows)) is not None:
                    yield out
                rows = []
            rows.append(r)
    if rows and (out := run(rows)) is not None:
        yield out


def keep(line: Line, shared: bool, has_article: bool) -> bool:
    return not line.furniture and (line.inside if has_article else not shared)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        texts, counts = [], []
        for z, gone in zip(b.column("z").to_pylist(), b.column("gone").to_pylist(), strict=True):
            shared = set(np.frombuffer(gone, np.int32).tolist()) if gone else ()
            texts.append("\n\n".join(text for i, text, restored in json.loads(unpack.decompress(z)) if restored or i not in shared))
            counts.append(len(texts[-1]))
        yield pa.RecordBatch.from_arrays([b.column("i"), b.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["i", "url", "text", "n"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` for every row."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    base = pages.select(
        F.col(id_col).alias("i"),
        F.col(url_col).alias("url"),
        F.xxhash64(F.col(id_col), F.col(url_col)).alias("k"),
        F.xxhash64(F.coalesce(F.col(html_col), F.lit(""))).alias("h"),
        F.col(html_col).alias("page"),
    ).withColumn("kh", F.xxhash64("k", "h"))
    parsed = held(base.mapInArrow(_parsed, f"host string, path string, i {kind}, url string, k long, h long, kh long, lines binary, z binary"))
    rows, _ = numbered(parsed.select("host", "path", "k", "h", "lines"), ["host", "path", "k", "h"], "g")
    own = (F.col("g") / BLOCK).cast("long")
    side = F.when(F.col("g") % BLOCK == 0, own - 1).when(F.col("g") % BLOCK == BLOCK - 1, own + 1)
    dealt = rows.withColumn("block", F.explode(F.array_compact(F.array(own, side)))).withColumn("own", F.col("block") == own)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(parts, "block").sortWithinPartitions("block", "g")
    gone = held(dealt.mapInArrow(_shared, "k long, h long, gone binary").groupBy("k", "h").agg(F.max("gone").alias("gone")))
    unsure = maybe_in(spark, bitmap(gone.select(F.xxhash64("k", "h").alias("kh")), "kh"))(F.col("kh"))
    alone = parsed.where(~unsure).select("i", "url", "z", F.lit(None).cast("binary").alias("gone"))
    some = parsed.where(unsure).join(gone.hint("shuffle_merge"), ["k", "h"], "left").select("i", "url", "z", "gone")
    out = alone.unionByName(some).mapInArrow(_extract, f"i {kind}, url string, text string, n long")
    return out.select(F.col("i").alias(id_col), F.col("url").alias(url_col), F.col("text"), F.col("n").alias("n_chars"))
