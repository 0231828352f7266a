"""Main text of web pages: structure first, then differencing against the page with the nearest URL.

A page is cut into blocks (lines) of text in page order. What stands in menus, headers, footers,
asides, forms, scripts and in elements that name themselves advert, notice, comments and the like is
left out as it is read. Blocks inside an ``article``, ``main`` or an element named like one are certain
to be text.

Pages of a host are then laid out by URL path, and each page is held against the neighbour whose path
shares the longest prefix: their uncertain blocks are aligned by longest common subsequence, and the
shared ones deleted, however many they are: they are the host's template. Certain blocks are not
deleted, since articles of one host do share lines (quotations, licence lines).

A neighbour that is the same page under another URL tells nothing about the template; the next nearest
is taken then. It is the same page if what the two share beyond a third page's lines outweighs by far
what they don't share (``same_page``). Up to ``NEAR`` runs of equal pages are looked at on each side.

One range shuffle by (host, path) puts neighbours together and splits a large host by path; pages of
a host are compared along the sorted stream, so no group is ever held whole. A pass over the keys alone
finds the bounds beforehand, and the rows beside a bound are sent to both of its sides, so that results
don't depend on where the bounds are.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import in_arrow

#: Elements whose start or end does not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; it ends at their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that hold no main text.
DROP = frozenset("nav header footer aside form button select option menu dialog noscript template head script style textarea title xmp iframe noembed noframes object embed applet audio video canvas svg math map datalist fieldset".split())
#: Words of a class, id or role that mark such an element.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login "
    "popup modal overlay paywall comment comments disqus reply replies respond sidebar aside related recommended recommendations share sharing social breadcrumb breadcrumbs nav navbar navigation menu "
    "topbar footer header masthead toolbar pagination pager widget widgets skip contentinfo complementary search searchbox form".split()
)
#: Beginnings of such words that are written together with others.
DROP_STARTS = ("comment", "cookie", "advert", "sponsor", "newsletter", "breadcrumb", "sidebar", "navbar", "dropdown")
#: Classes and ids, as a whole, of elements that hold the text as ``article`` does.
CONTENT_NAMES = frozenset("article article-body article-content post-content post-body entry-content story story-body main-content page-content content main".split())
#: Elements that such words don't apply to, as they hold the page or the text itself.
NEVER_BY_WORD = frozenset("html body main article p h1".split())
#: What an open ``p`` ends before.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME_ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_TAG_END = re.compile(r"[\s/]*>")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_SPACE = re.compile(r"\s+")
#: Two pages are the same one if what they share beyond a third page's lines has so many times the characters of the rest.
SAME_PAGE = 10
#: Runs of equal pages on either side of a page among which its neighbour is looked for.
NEAR = 8
#: Rows that a range of the layout has at least, unless the number of partitions is given.
LEAST_ROWS = 256
#: Bits of the table that ``lcs`` keeps at once; longer lists are halved first.
LCS_BITS = 1 << 28


def _attributes(html: str, at: int) -> tuple[dict[str, str], int, bool]:
    """The attributes from ``at``, where the tag ends, and whether it ends at all."""
    found: dict[str, str] = {}
    while not (end := _TAG_END.match(html, at)):
        m = _ATTR.match(html, at)
        if not m or m.end() == at:
            return found, len(html), False
        value = m[2] or ""
        found.setdefault(m[1].lower(), value[1:-1] if value[:1] in ("'", '"') and len(value) > 1 else value)
        at = m.end()
    return found, end.end(), True


def _is_dropped(name: str, attrs: dict[str, str]) -> bool:
    if name in DROP:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if name in NEVER_BY_WORD:
        return False
    named = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
    return bool(named) and any((x := w.lower()) in DROP_WORDS or x.startswith(DROP_STARTS) for w in _WORDS.findall(named))


def _is_content(name: str, attrs: dict[str, str]) -> bool:
    if name in ("article", "main") or attrs.get("role", "").lower() in ("main", "article"):
        return True
    return name in ("div", "section", "td") and not CONTENT_NAMES.isdisjoint(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split())


def blocks(html: str) -> list[tuple[str, bool]]:
    """``(text, certain)`` of each block outside dropped elements, in page order.

    Malformed pages are read as far as they go: unclosed elements end with their parent or the page,
    stray end tags are ignored, and an unfinished tag or comment hides the rest.
    """
    out: list[tuple[str, bool]] = []
    piece: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, certain
    ends: dict[str, int] = {}  # of each open name, how many

    def flush():
        if piece:
            text = _SPACE.sub(" ", unescape("".join(piece))).strip()
            if text:
                out.append((text, bool(stack) and stack[-1][2]))
            piece.clear()

    def pop_to(k: int):
        if any(name not in INLINE for name, _, _ in stack[k:]):
            flush()
        for name, _, _ in stack[k:]:
            ends[name] -= 1
        del stack[k:]

    def close(name: str, stops: tuple[str, ...] = ()):
        if ends.get(name):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    return pop_to(k)
                if stack[k][0] in stops:
                    return None
        return None

    at, n, lower = 0, len(html), None
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not (stack and stack[-1][1]):
            piece.append(html[at:lt])
        if lt >= n:
            break
        m = _NAME.match(html, lt + 1)
        if not m:
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif html[lt + 1 : lt + 2] in ("!", "?", "/") and lt + 1 < n:
                end = html.find(">", lt + 1)
                at = n if end < 0 else end + 1
            else:
                if not (stack and stack[-1][1]):
                    piece.append("<")
                at = lt + 1
            continue
        name = m[1].lower()
        attrs, at, _ = _attributes(html, m.end())
        if html[lt + 1] == "/":
            if name not in INLINE:
                flush()
            close(name)
            continue
        if name in RAW:
            if lower is None:
                lower = html.lower()
                if len(lower) != n:  # some letters grow in lower case
                    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in html)
            end = lower.find(f"</{name}", at)
            if end < 0:
                break
            gt = html.find(">", end)
            at = n if gt < 0 else gt + 1
            continue
        if name not in INLINE:
            flush()
        if name in ENDS_P:
            close("p", ("article", "div", "section", "td", "li", "blockquote", "button"))
        if name in _SAME_ENDS:
            close(name, _SAME_ENDS[name])
        if name in VOID:
            if name == "br":
                piece.append(" ")
            continue
        dropped, certain = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        dropped = dropped or _is_dropped(name, attrs)
        certain = certain or not dropped and _is_content(name, attrs)
        stack.append((name, dropped, certain))
        ends[name] = ends.get(name, 0) + 1
    flush()
    return out


def lcs(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, exact at every size.

    What begins and what ends both alike is matched first. Between them a row of the table is one
    integer with a bit for each line of ``b``; tables of more than ``LCS_BITS`` are halved (Hirschberg).
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = {*range(lo), *range(len(a) - hi, len(a))}
    inner_b = b[lo : len(b) - hi]
    both = {*a[lo : len(a) - hi]} & {*inner_b}
    x = [i for i in range(lo, len(a) - hi) if a[i] in both]
    y = [t for t in inner_b if t in both]
    parts = [(0, len(x), 0, len(y))]
    while parts:
        p, q, r, s = parts.pop()
        if p == q or r == s:
            continue
        if q - p == 1 or (q - p) * (s - r) <= LCS_BITS:
            rows = [*_lcs_rows([a[i] for i in x[p:q]], y[r:s])]
            i, j = q - p, s - r
            while i and j:
                if rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                    continue
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    found.add(x[p + i])
                    j -= 1
            continue
        mid = (p + q) // 2
        for first in _lcs_rows([a[i] for i in x[p:mid]], y[r:s]):
            pass
        for last in _lcs_rows([a[i] for i in x[mid:q]][::-1], y[r:s][::-1]):
            pass
        n = s - r  # the bits that are 0 count matches
        before = [0, *accumulate(1 - int(c) for c in reversed(f"{first:0{n}b}"))]
        after = [0, *accumulate(1 - int(c) for c in reversed(f"{last:0{n}b}"))]
        cut = max(range(n + 1), key=lambda k: before[k] + after[n - k])
        parts += [(p, mid, r, r + cut), (mid, q, r + cut, s)]
    return found


def _lcs_rows(a: list[str], b: list[str]):
    """After each line of ``a``: an integer whose bit ``j`` is 0 where line ``j`` of ``b`` makes the subsequence longer."""
    places: dict[str, int] = {}
    for line in {*a}:
        places[line] = 0
    marks = {t: bytearray((len(b) + 7) // 8) for t in places}
    for j, t in enumerate(b):
        if t in marks:
            marks[t][j >> 3] |= 1 << (j & 7)
    places = {t: int.from_bytes(m, "little") for t, m in marks.items()}
    mask = row = (1 << len(b)) - 1
    for t in a:
        u = row & places[t]
        row = ((row + u) | (row - u)) & mask
        yield row


Blocks = list[tuple[str, bool]]


def same_page(page: Blocks, other: Blocks, others: list[Blocks]) -> bool:
    """Whether ``other`` is ``page`` under another URL. Lines that a third page has too (the one of
    ``others`` that has the fewest of them) say nothing; the rest of what is shared has to have ``SAME_PAGE`` times
    the characters of what is not."""
    if page == other:
        return True
    a, b = [t for t, _ in page], [t for t, _ in other]
    shared = [a[i] for i in lcs(a, b)]
    weight = sum(map(len, shared))
    rest = sum(map(len, a)) + sum(map(len, b)) - 2 * weight
    if rest * SAME_PAGE > weight:
        return False
    third = [{t for t, _ in o} for o in others if o != page and o != other]
    return rest * SAME_PAGE <= max((sum(len(t) for t in shared if t not in o) for o in third), default=weight)


def difference(page: Blocks, others: list[Blocks]) -> list[str]:
    """The page's blocks without the uncertain ones that it shares with another page: the first of
    ``others``, nearest first, that isn't the same page. If there is none, nothing is deleted."""
    if all(certain for _, certain in page):
        return [text for text, _ in page]
    others = [o for o in others if o]
    other = next((o for o in others if not same_page(page, o, others)), None)
    if other is None:
        return [text for text, _ in page]
    at = [i for i, (_, certain) in enumerate(page) if not certain]
    shared = {at[k] for k in lcs([page[i][0] for i in at], [text for text, certain in other if not certain])}
    return [text for i, (text, _) in enumerate(page) if i not in shared]


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _ranges(keyed: DataFrame, partitions: int | None) -> tuple[list[tuple], list[tuple]]:
    """Bounds of key ranges, and ``(*key, range)`` of rows that a range needs besides its own: the
    nearest ``NEAR`` runs of equal pages, and one more that may go on in it, on either side and of the same host."""
    n = partitions or int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def edges(batches):
        """Of a partition: its rows, its first runs by their first rows, and its last runs by their last rows."""
        n_rows, first, last = 0, [], deque(maxlen=NEAR + 1)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n_rows += 1
                if last and (last[-1][0], last[-1][3]) == (row[0], row[3]):
                    last[-1] = row
                    continue
                last.append(row)
                if len(first) <= NEAR:
                    first.append(row)
        if n_rows:
            rows = [(n_rows, side, *row) for side, part in enumerate((first, last)) for row in part]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["n", "side", *KEYS])

    laid = keyed.repartitionByRange(n, *KEYS).sortWithinPartitions(*KEYS)
    found = in_arrow(laid, edges, "n long, side int, host string, path string, key string, hash long").withColumn("part", F.spark_partition_id()).collect()
    key = lambda r: (r.host, r.path, r.key, r.hash)
    parts = [[*rows] for _, rows in groupby(sorted(found, key=lambda r: r.part), key=lambda r: r.part)]
    firsts = [[key(r) for r in rows if r.side == 0] for rows in parts]
    lasts = [[key(r) for r in rows if r.side == 1] for rows in parts]
    starts, size = [], None
    for k, rows in enumerate(parts):
        if size is None or partitions or size >= LEAST_ROWS:
            starts, size = [*starts, k], 0
        size += rows[0].n
    extra = []
    for target, at in enumerate(starts):
        end = starts[target + 1] if target + 1 < len(starts) else len(parts)
        for row, beyond in ((firsts[at][0], (r for k in range(at - 1, -1, -1) for r in reversed(lasts[k]))), (lasts[end - 1][-1], (r for k in range(end, len(parts)) for r in firsts[k]))):
            runs, before = 0, None
            for r in beyond:
                if r[0] != row[0] or runs > NEAR:
                    break
                if r[3] != before:
                    runs, before = runs + 1, r[3]
                    extra.append((*r, target))
    return [firsts[k][0] for k in starts[1:]], extra


#: What pages are laid out by; ``key`` is the id as a string and ``hash`` that of the page.
KEYS = ("host", "path", "key", "hash")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", partitions: int | None = None) -> DataFrame:
    """One row per page: ``id, url, text``; ``text`` is empty if nothing is left.

    Null or empty pages have empty texts. A null URL, or one without a host, has the host ``''``.
    A page that is alone on its host, or among ``NEAR`` runs of copies of itself on both sides, keeps
    all that structure leaves. Repeated rows are each returned. Pages are read whole. ``partitions`` says how
    many ranges the layout has; texts don't depend on it.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    scheme = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
    has_host = url.rlike(scheme)
    host = F.when(has_host, F.lower(F.regexp_extract(url, scheme + r"(?:[^/?#@]*@)?([^/?#]*)", 1))).otherwise("")
    path = F.when(has_host, F.regexp_extract(url, scheme + r"[^/?#]*([^?#]*)", 1)).otherwise(url)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), host.alias("host"), path.alias("path"), key.alias("key"), F.xxhash64(html).alias("hash"))
    id_type = rows.schema["id"].dataType.simpleString()
    bounds, extra = _ranges(rows.select(*KEYS), partitions)

    def compare(batches):
        """Each run of equal pages against the runs before and after it; a run waits for those that follow."""
        before, waiting, kind = deque(maxlen=NEAR), deque(), None  # runs: place, hash, blocks, first and last path, pages that are asked for

        def done(run):
            """The texts of a run's pages, and the run is past."""
            around = [(r, r["last"]) for r in reversed(before) if r["place"] == run["place"]]
            after = [(r, r["first"]) for r, _ in zip(waiting, range(NEAR), strict=False) if r["place"] == run["place"]]
            texts: dict[tuple, str] = {}
            for id_, url, path in run["own"]:
                if all(certain for _, certain in run["blocks"]):
                    order = ()
                else:
                    near = sorted([*enumerate(around), *enumerate(after)], key=lambda x: (-_common(x[1][1], path), x[0]))
                    order = tuple(r["n"] for _, (r, _) in near)
                if order not in texts:
                    by = {r["n"]: r["blocks"] for r, _ in (*around, *after)}
                    texts[order] = " ".join(difference(run["blocks"], [by[n] for n in order]))
                yield id_, url, texts[order]
            run["own"] = ()
            before.append(run)

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], ["id", "url", "text"])

        n = 0
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(at, 256).to_pylist():
                    place = (row["range"], row["host"])
                    if not waiting or (waiting[-1]["place"], waiting[-1]["hash"]) != (place, row["hash"]):
                        while waiting and (len(waiting) > NEAR or waiting[0]["place"] != place):
                            out += done(waiting.popleft())
                        n += 1
                        waiting.append({"n": n, "place": place, "hash": row["hash"], "blocks": blocks(row["html"]), "first": row["path"], "own": []})
                    waiting[-1]["last"] = row["path"]
                    if row["own"]:
                        waiting[-1]["own"].append((row["id"], row["url"], row["path"]))
                yield batch_of(out)
        out = []
        while waiting:
            out += done(waiting.popleft())
            if len(out) >= 256:
                yield batch_of(out)
                out = []
        if kind is not None:
            yield batch_of(out)

    at_range = F.lit(0)
    if bounds:
        listed = F.array(*(F.struct(*(F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(KEYS, b, strict=True))) for b in bounds))
        at_range = F.size(F.filter(listed, lambda b: b <= F.struct(*KEYS)))
    rows = rows.withColumn("range", at_range)
    if extra:
        beside = pages.sparkSession.createDataFrame(extra, "host string, path string, key string, hash long, range int").distinct().groupBy(*KEYS).agg(F.collect_list("range").alias("also"))
        every = F.concat(F.array(F.col("range")), F.coalesce("also", F.array().cast("array<int>")))
        rows = rows.join(F.broadcast(beside), [*KEYS], "left").select("id", "url", "html", *KEYS, F.posexplode(every).alias("pos", "range")).withColumn("own", F.col("pos") == 0)
    else:
        rows = rows.withColumn("own", F.lit(True))
    rows = rows.select("id", "url", "html", "own", "range", *KEYS)
    # a partition for each range: fewer would be as large as adaptive execution makes them
    laid = rows.repartitionByRange(len(bounds) + 1, "range")
    return in_arrow(laid.sortWithinPartitions("range", *KEYS), compare, f"id {id_type}, url string, text string")
