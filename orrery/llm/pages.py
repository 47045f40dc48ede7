"""Operator 3: main text of web pages, by differences to the nearest page, guarded by structure.

A page is read into lines, one a block, each with where it stands. Lines in menus, headers, footers, sidebars,
notices, adverts, forms and reader comments go. Then every page is aligned, line by line, with the pages nearest to it
by URL path on the same host, which in order of path stand right before and behind it: no other page shares more of
its path. Lines are aligned by longest common subsequence; shared lines are the site's, not the page's, and go:

* where a page has no article or main element, all of them;
* inside such an element, those at its two ends that both neighbours share (a strip the site puts above or below every
  article). Shared lines further in stay: pages of one host may well quote the same passage.

A neighbour with the same lines tells nothing, nor does one that shares more than half of a marked text: a copy.

Pages are dealt by range of (host, path), so a large host spreads over many tasks and neighbours still meet.
"""

from __future__ import annotations

import bisect
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Skipped up to the end tag, without one nothing but the tag is; one of the same kind may stand inside.
SKIPPED = "noscript|template|textarea|iframe|svg"
INLINE_NAMES = "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img"
#: What a select holds; anything else ends it.
CHOICES = "option|optgroup|hr|legend|" + INLINE_NAMES.replace(" ", "|")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(script|style)\b[^>]*?(?:/>|>(?:.*?)(?:</\1\s*>|\Z))"
    rf"|<({SKIPPED})\b[^>]*?(?:/>|>(?:(?!<\2\b).|<\2\b(?:(?!<\2\b).)*?</\2\s*>)*?</\2\s*>)"
    rf"|<select\b[^>]*>(?:[^<]++|</?(?:{CHOICES})\b[^>]*>|<!--.*?-->|<(?![/a-zA-Z!]))*+(?:</select\s*>)?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = "math semantics annotation mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle mpadded mphantom menclose msub msup msubsup munder mover munderover"
INLINE = frozenset(f"{INLINE_NAMES} {MATH}".split())
#: What can stand in a head; any other element, or text, begins the body.
HEAD = frozenset("title meta link base basefont bgsound script style noscript template noframes".split())
#: Elements that are never main text.
ASIDE = frozenset("nav footer aside form button menu dialog label fieldset".split())
#: These close an open element of the same kind.
ALONE = frozenset("p li dt dd tr td th option".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|banner|promo\w*|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|cookies?|consent|gdpr|notice|notification|alert"
    r"|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|teaser|comments?|replies|reply|respond|disqus|widget|toolbar|pagination|pager|search|skip)(?:$|[\s\d_-])",
    re.I,
)
#: Class names that say something of a page or a list, not that this block is furniture.
STATE = re.compile(r"(?:no|not|has|with|without|is|js)[-_]\S*|search[-_]results?", re.I)
#: The page itself, and what is marked as its text: no class name sets these aside.
WHOLE = frozenset("html body main article".split())
HEAD_HINT = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|branding)(?:$|[\s\d_-])", re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


def set_aside(name: str, attributes: str, in_main: bool) -> bool:
    if name in ASIDE or name == "header" and not in_main:
        return True
    if not attributes or attributes.isspace():
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id") and name not in WHOLE:
            said = " ".join(x for x in value.split() if not STATE.fullmatch(x))
            if HINT.search(said) or not in_main and HEAD_HINT.search(said):
                return True
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def lines(page: str) -> list[tuple[str, bool]]:
    """(text, in an article or main element) of each block that is not set aside, in page order."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, set aside, in main
    held: list[str] = []
    aside, main, at = False, False, 0

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, main))
            held.clear()

    for m in TOKEN.finditer(page):
        if m.start() > at:
            if stack and stack[-1][0] == "head" and not page[at : m.start()].isspace():
                stack.pop()
                aside, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if not aside:
                held.append(page[at : m.start()])
        at = m.end()
        name = m[4]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            if not aside:
                held.append(" ")
            continue
        if name not in INLINE:
            flush()
        if m[3]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name not in HEAD and (k := next((k for k, x in enumerate(stack[:3]) if x[0] == "head"), None)) is not None:
                del stack[k:]
            if name in ALONE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            if name not in VOID and not m[5].endswith("/"):
                was_aside, was_main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                now = was_aside or name == "head" or set_aside(name, m[5], was_main)
                if now != was_aside:
                    flush()
                stack.append((name, now, was_main or name in ("article", "main")))
        aside, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    if at < len(page) and (not aside or stack[-1][0] == "head"):
        held.append(page[at:])
    flush()
    return out


#: Up to this many bits the rows of an alignment are kept; longer pages are halved until they fit.
TABLE_BITS = 1 << 24


def rows_of(a: list[int], b: list[int]):
    """Yields, behind each line of a, the row of the table of common lengths with b: bit j is cleared where the length
    grows from b[:j] to b[:j + 1]. A line that b lacks leaves the row as it is."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    v = full = (1 << len(b)) - 1
    for x in a:
        if at := where.get(x):
            if len(at) < 8:
                m = 0
                for j in at:
                    m |= 1 << j
            else:
                bits = np.zeros(len(b), np.uint8)
                bits[at] = 1
                m = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            u = v & m
            v = ((v + u) | (v - u)) & full
        yield v


def lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of a with b[:j], for every j."""
    v = (1 << len(b)) - 1
    for v in rows_of(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def traced(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence, from the kept rows of the table."""
    rows, full, found, j = list(rows_of(a, b)), (1 << len(b)) - 1, [], len(b)
    for i in range(len(a) - 1, -1, -1):
        # the length for a[:i+1], b[:j] is the number of cleared bits below j
        low = (1 << j) - 1
        above = rows[i - 1] if i else full
        if (~above & low).bit_count() == (~rows[i] & low).bit_count():
            continue
        while j and (~rows[i] & ((1 << (j - 1)) - 1)).bit_count() == (~rows[i] & ((1 << j) - 1)).bit_count():
            j -= 1
        found.append(i)
        j -= 1
    return found


def shared(a: list[str], b: list[str], table_bits: int | None = None) -> set[int]:
    """Places in a of a longest common subsequence with b. Memory is linear in the lines: a long alignment is cut where
    the lengths of its two halves, one from the front and one from the back, add up to the most."""
    most = TABLE_BITS if table_bits is None else table_bits
    number: dict[str, int] = {}
    in_b = set(b)
    at_a = [i for i, x in enumerate(a) if x in in_b]  # a line that one of them lacks is no part of it
    xs = [number.setdefault(a[i], len(number)) for i in at_a]
    ys = [number[y] for y in b if y in number]
    found: set[int] = set()
    todo = [(0, len(xs), 0, len(ys))]
    while todo:
        i, k, j, n = todo.pop()
        while i < k and j < n and xs[i] == ys[j]:
            found.add(at_a[i])
            i, j = i + 1, j + 1
        while i < k and j < n and xs[k - 1] == ys[n - 1]:
            k, n = k - 1, n - 1
            found.add(at_a[k])
        if i == k or j == n:
            continue
        if k - i == 1 or (k - i) * (n - j) <= most:
            found.update(at_a[i + x] for x in traced(xs[i:k], ys[j:n]))
            continue
        m = (i + k) // 2
        front, back = lengths(xs[i:m], ys[j:n]), lengths(xs[m:k][::-1], ys[j:n][::-1])
        c = j + int((front + back[::-1]).argmax())
        todo += [(i, m, j, c), (m, k, c, n)]
    return found


def main_text(own: list[tuple[str, bool]], neighbours: list[list[tuple[str, bool]]]) -> str:
    """The lines that are left, joined; neighbours: the nearest pages of the same host, two at most."""
    marked = any(inside for _, inside in own)
    texts = [t for t, inside in own if inside or not marked]
    with_lines = []
    for other in neighbours:
        its_mark = any(inside for _, inside in other)
        theirs = [t for t, inside in other if inside or not its_mark]
        if theirs == texts:
            continue
        alike = shared(texts, theirs)
        if not marked or 2 * len(alike) <= len(texts):
            with_lines.append(alike)
    if not marked:
        drop = set().union(*with_lines)
    else:
        drop, both = set(), set.intersection(*with_lines) if len(with_lines) == 2 else set()
        for order in (range(len(texts)), range(len(texts) - 1, -1, -1)):
            for i in order:
                if i not in both:
                    break
                drop.add(i)
    return " ".join(t for i, t in enumerate(texts) if i not in drop)


def order_key(host: str | None, path: str | None, page_id: int | None) -> tuple:
    """Orders as Spark does: strings by their bytes, null first."""
    return (host or "").encode(), (path or "").encode(), page_id is not None, page_id or 0


def chunk_bounds(places: DataFrame, n: int) -> list[tuple[tuple, tuple]]:
    """First and last key of each of about n chunks of the pages in order, from the urls alone."""
    dealt = places.repartitionByRange(n, "host", "path", "page_id").withColumn("chunk", F.spark_partition_id())
    ends = dealt.groupBy("chunk").agg(*(f(F.struct("host", "path", F.col("page_id").isNotNull().alias("has"), "page_id")).alias(k) for k, f in (("a", F.min), ("b", F.max))))
    key = lambda r: order_key(r.host, r.path, r.page_id)
    return sorted((key(r.a), key(r.b)) for r in ends.collect())  # two keys a chunk


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null html is empty, and so is its text. A null url stands on a host of its own kind. Rows that repeat are
    neighbours of each other and, being equal, tell each other nothing. Very long pages are read whole and aligned in
    memory linear in their lines; an empty table gives no row. Only page_id, url and html are read. Pages are cut into chunks in order of host and path; the last page of a chunk also goes to
    the next, and the first to the one before, so every page meets both neighbours wherever the cuts lie.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    url = F.coalesce(F.col("url"), F.lit(""))
    place = [F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:www\.)?([^/?#]*)", 1)).alias("host"), F.regexp_extract(url, r"^(?:[a-zA-Z]+://[^/?#]*)?([^?#]*)", 1).alias("path")]
    id_field = pages.select("page_id").schema[0]
    n = common.parts(spark, 1)
    bounds = chunk_bounds(pages.select("page_id", *place), n)
    keys = common.dealt_keys(n)
    firsts, lasts = [a for a, _ in bounds], {b: i for i, (_, b) in enumerate(bounds)}
    starts = {a: i for i, a in enumerate(firsts)}

    def deal(batches):
        for batch in common.slices(batches, 8 << 20):
            at, chunk, own = [], [], []
            for r, k in enumerate(map(order_key, *(batch.column(c).to_pylist() for c in ("host", "path", "page_id")))):
                c = bisect.bisect_right(firsts, k) - 1
                to = [(c, True)]
                if k in lasts and c + 1 < len(firsts):
                    to.append((c + 1, False))
                if k in starts and c:
                    to.append((c - 1, False))
                for x, mine in to:
                    at.append(r)
                    chunk.append(int(keys[x % n]))
                    own.append(mine)
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(own), *some.columns], ["chunk", "own", *some.schema.names])

    def run(batches):
        rows: list = []
        out: dict = {"page_id": [], "url": [], "text": [], "n_chars": []}

        def done(row, neighbours):
            if row[4]:
                text = main_text(row[3], [x[3] for x in neighbours if x[2] == row[2]])
                for k, x in zip(out, (row[0], row[1], text, len(text)), strict=True):
                    out[k].append(x)

        def batch_of():
            b = pa.RecordBatch.from_arrays([pa.array(out["page_id"], id_type), pa.array(out["url"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["n_chars"], pa.int64())], [*out])
            for x in out.values():
                x.clear()
            return b

        id_type = pa.int64()
        for batch in common.slices(batches, 4 << 20):
            id_type = batch.column("page_id").type
            for i, u, h, page, mine in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "html", "own")), strict=True):
                rows.append((i, u, h, lines(page), mine))
                if len(rows) == 2:
                    done(rows[0], [rows[1]])
                elif len(rows) == 3:
                    done(rows[1], [rows[0], rows[2]])
                    del rows[0]
            if out["page_id"]:
                yield batch_of()
        if rows:
            done(rows[-1], rows[:-1])
            yield batch_of()

    src = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), *place)
    schema = "chunk int, own boolean, page_id " + id_field.dataType.simpleString() + ", url string, html string, host string, path string"
    sorted_ = src.mapInArrow(common.tidied(deal), schema).repartition(n, "chunk").sortWithinPartitions("chunk", "host", "path", "page_id", "url")
    result = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return sorted_.select("page_id", "url", "host", "html", "own").mapInArrow(common.tidied(run), result)


def query(spark, sf_dir: str) -> DataFrame:
    """op3_pages over the whole pages table."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
