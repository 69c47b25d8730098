"""Main text of pages by equivalence-class template deduction.

Same-host pages come from a few templates, whose tokens (tags and fixed texts, each with its place as its role, see
``html_scan``) occur as often as one another on every page. The deduction:

1. each page is scanned once into its sequence of token roles, a small table;
2. a role's occurrence vector over its host's pages is summed up as two 64-bit XOR sums of hash(page, count), beside the
   numbers of pages and occurrences. The sums are merged within tasks and then by a plain aggregate, so a host of any size
   never meets in one task;
3. roles with equal vectors form a class; large and frequent ones (``CLASS_SIZE`` roles, on half of the host's pages) are
   candidates. A second pass over the role sequences tests them: a class is ordered if its tokens come in one order on
   all pages, and nested in another if each of its cycles lies in one gap of the other's, the same one everywhere. Classes
   that are not ordered, or cross another one, are invalid;
4. valid classes nest into the host's template. Its slots are the gaps between template tokens; the main slot is the
   gap inside the deepest container element that holds ``MAIN_SHARE`` of the text outside the parts beside the article
   (menus, headers, footers, asides, forms, notices, adverts, comments, by element, landmark role and class words);
5. each page's blocks within the main slot, less blocks made of template text only, are its text.

Hosts of fewer than ``MIN_PAGES`` pages show no template: there, and on pages without the host's container, the slot is the
article or main element, or else the page. A page more than half of whose text is template text is a copy of other
pages rather than a frame: it keeps that text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmart.llm.common import mix, stored
from rankmart.llm.html_scan import CONTAINER, Scanner, block_text
from rankmart.operators.skew import salted_join

MIN_PAGES = 5
CLASS_SIZE = 3
TAG_SHARE = 0.5     # of the host's pages, for a class of the template
TEXT_SHARE = 0.8    # of the host's pages, for a fixed text
MAIN_SHARE = 0.75   # of the host's text outside the parts beside the article
BROADCAST_BYTES = 8 << 20

OPEN, BOX, TEXT, OTHER = range(4)  # kinds of token: start tag, start tag of a container, text, end tag


def host_of(url: Column) -> Column:
    """The URL's host, lower-cased; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_tokens(page: str, scanner: Scanner) -> tuple[list, list, list, int]:
    """Roles, kinds and text chars of a page's tokens (a container's: the text in it that isn't beside the article); all such text."""
    roles, blocks, _ = scanner.scan(page)
    total = 0
    for around, pieces in blocks:
        kept = [p for p in pieces if p[0] is None or not p[0].out()]
        n = len(block_text(kept)) if kept else 0
        if n:
            total += n
            e = around
            while e is not None:
                e.chars += n
                e = e.parent
    kinds, chars = [], []
    for _, e, n in roles:
        if e is None:
            kinds.append(TEXT if n else OTHER)
            chars.append(n)
        else:
            # below an article or main element there is no further descent
            box = e.name in CONTAINER and not e.out() and not (e.parent is not None and e.parent.main)
            kinds.append(BOX if box else OPEN)
            chars.append(e.chars)
    return [r for r, _, _ in roles], kinds, chars, total


def sequences(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page, host, roles, kinds, chars, total): each page's tokens, in order, as binary arrays."""
    rows = pages.select(F.monotonically_increasing_id().alias("page"), host_of(F.col(url)).alias("host"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            out = [page_tokens(x.as_py(), scanner) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page"), b.column("host"), pa.array([np.array(o[0], "<u8").tobytes() for o in out], pa.binary()),
                 pa.array([np.array(o[1], "u1").tobytes() for o in out], pa.binary()),
                 pa.array([np.array(o[2], "<u4").tobytes() for o in out], pa.binary()), pa.array([o[3] for o in out], pa.int64())],
                names=["page", "host", "roles", "kinds", "chars", "total"])

    return rows.mapInArrow(work, "page long, host string, roles binary, kinds binary, chars binary, total long")


VECTORS = "host string, role long, n_pages long, n_occ long, x long, y long, chars long, kind int, place int"


def _joined(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows' arrays, one after the other, and their sizes."""
    parts = [np.frombuffer(x.as_py(), dtype) for x in column]
    return (np.concatenate(parts) if parts else np.empty(0, dtype)), np.array([len(p) for p in parts], dtype=np.int64)


def vectors(sequenced: DataFrame) -> DataFrame:
    """Occurrence vectors of every (host, role), as counts and two XOR sums of hash(page, count)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, size = _joined(b.column("roles"), "<u8")
            if not len(roles):
                continue
            kinds, _ = _joined(b.column("kinds"), "u1")
            chars, _ = _joined(b.column("chars"), "<u4")
            hosts, of = np.unique(np.array(b.column("host").to_pylist(), dtype=object).astype(str), return_inverse=True)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(roles)) - np.repeat(np.cumsum(size) - size, size)
            by = np.lexsort((row, roles, of[row]))
            row, role, kind, char, place = row[by], roles[by], kinds[by], chars[by], place[by]
            host = of[row]
            new = np.concatenate(([True], (role[1:] != role[:-1]) | (host[1:] != host[:-1])))
            page_new = new | np.concatenate(([True], row[1:] != row[:-1]))
            at = np.flatnonzero(page_new)  # a (role, page) each
            count = np.diff(np.append(at, len(row))).astype(np.uint64)
            key = b.column("page").to_numpy()[row[at]].astype(np.uint64)
            with np.errstate(over="ignore"):
                x = mix(mix(key) + count * np.uint64(0x9E3779B97F4A7C15))
                y = mix(x ^ mix(key + np.uint64(0x632BE59BD9B4E019)))
            first = np.flatnonzero(new)
            group = np.searchsorted(at, first)
            total = lambda v: np.add.reduceat(v.astype(np.int64), first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts[host[first]].tolist(), pa.string()), pa.array(role[first].view(np.int64)),
                 pa.array(np.diff(np.append(group, len(at)))), pa.array(total(np.ones(len(row)))),
                 pa.array(np.bitwise_xor.reduceat(x, group).view(np.int64)), pa.array(np.bitwise_xor.reduceat(y, group).view(np.int64)),
                 pa.array(total(char)), pa.array(kind[first].astype(np.int32)), pa.array(np.minimum.reduceat(place, first).astype(np.int32))],
                names=[f.split()[0] for f in VECTORS.split(", ")])

    sums = sequenced.select("page", "host", "roles", "kinds", "chars").mapInArrow(work, VECTORS)
    return sums.groupBy("host", "role").agg(
        F.sum("n_pages").alias("n_pages"), F.sum("n_occ").alias("n_occ"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
        F.sum("chars").alias("chars"), F.min("kind").alias("kind"), F.min("place").alias("place"))


def candidates(vector: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per host its frequent, large classes: (host, pages, total, tokens: array of (role, class, n_pages, n_occ, chars, kind)).

    Each token is on half of the host's pages or more, so a host has at most twice as many as a mean page."""
    often = vector.filter("n_pages > 1").join(hosts.filter(F.col("pages") >= MIN_PAGES), "host").filter(F.col("n_pages") >= F.col("pages") * TAG_SHARE)
    same = ["host", "n_pages", "n_occ", "x", "y"]
    classes = often.groupBy(*same).agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("place"), F.min("role").alias("lead")).filter(F.col("size") >= CLASS_SIZE)
    token = F.struct(F.col("c.place").alias("class_place"), F.col("c.lead").alias("class"), F.col("o.place").alias("place"), "role", F.col("o.n_pages").alias("n_pages"),
                     F.col("o.n_occ").alias("n_occ"), "chars", "kind")
    on = [F.col(f"o.{c}") == F.col(f"c.{c}") for c in same]
    rows = often.alias("o").join(classes.alias("c"), on).select(F.col("o.host").alias("host"), "pages", "total", token.alias("t"))
    return rows.groupBy("host", "pages", "total").agg(F.array_sort(F.collect_list("t")).alias("tokens"))


def sequence_test(roles: np.ndarray, of: dict[int, int], sizes: list[int]) -> tuple[list, list]:
    """Of one page: (class, order or None) of each class on it, and (class, other, gap or -1) of each two.

    ``of`` maps roles to classes and ``sizes`` are the classes' numbers of roles."""
    spots = [(i, of[r]) for i, r in enumerate(roles) if r in of]
    places = defaultdict(list)
    for i, c in spots:
        places[c].append(i)
    orders, gaps, cycles = [], [], {}
    for c, at in places.items():
        k = sizes[c]
        seq = [roles[i] for i in at]
        good = len(seq) % k == 0 and len(set(seq[:k])) == k and all(seq[i:i + k] == seq[:k] for i in range(k, len(seq), k))
        orders.append((c, hash(tuple(seq[:k])) if good else None))
        if good:
            cycles[c] = np.array(at).reshape(-1, k)
    for c, mine in cycles.items():
        for d, other in cycles.items():
            if c == d or sizes[d] < 2:
                continue
            gap = np.searchsorted(other.ravel(), mine)
            inside = gap % sizes[d]
            nested = (gap == gap[:, :1]).all() and inside.flat[0] > 0 and (inside == inside.flat[0]).all()
            gaps.append((c, d, int(inside.flat[0]) if nested else -1))
    return orders, gaps


TESTED = "host string, class int, other int, low long, high long"


def _test_classes(sequenced: DataFrame, found: DataFrame) -> DataFrame:
    """(host, class, other, low, high) over all pages; other -1 is the class's own order. low = high >= 0: holds on all pages."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known, seen, low = {}, {}, {}
            for host, raw, tokens, index in zip(b.column("host").to_pylist(), b.column("roles"), b.column("tokens"), b.column("index")):
                if host not in known:
                    of = dict(zip(tokens.as_py(), index.as_py()))
                    sizes = np.bincount(list(of.values())).tolist()
                    known[host] = (of, sizes, np.fromiter(of, np.int64))
                of, sizes, members = known[host]
                roles = np.frombuffer(raw.as_py(), "<i8")
                roles = roles[np.isin(roles, members)]
                at = (host, roles.tobytes())
                if at in seen:
                    continue
                seen[at] = True
                orders, gaps = sequence_test(roles.tolist(), of, sizes)
                for c, order in orders:
                    order = -1 if order is None else order & 0x7FFFFFFFFFFFFFFF
                    a, z = low.get((host, c, -1), (order, order))
                    low[host, c, -1] = (min(a, order), max(z, order))
                for c, d, gap in gaps:
                    a, z = low.get((host, c, d), (gap, gap))
                    low[host, c, d] = (min(a, gap), max(z, gap))
            cols = list(zip(*[(*k, *v) for k, v in low.items()])) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                                             names=[f.split()[0] for f in TESTED.split(", ")])

    rows = with_host(sequenced.select("page", "host", "roles"), found.select("host", F.col("tokens.role").alias("tokens"), "index"), "page", "inner")
    tested = rows.select("host", "roles", "tokens", "index").mapInArrow(work, TESTED)
    return tested.groupBy("host", "class", "other").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def with_host(rows: DataFrame, per_host: DataFrame, salt_by: str, how: str) -> DataFrame:
    """``rows`` with their host's row: broadcast if all hosts' rows are small (measured), else a join that deals out hot hosts."""
    names = [c for c in per_host.columns if c != "host"]
    bytes_ = F.sum(F.length(F.to_json(F.struct(*per_host.columns))))
    if (per_host.agg(bytes_).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(per_host), "host", how)
    return salted_join(rows, per_host.withColumnRenamed("host", "_host"), "host", "_host", how, salt_by=[salt_by]).drop("_host").select(*rows.columns, *names)


TEMPLATE = "host string, pages long, container long, fixed array<long>, classes array<struct<parent:int,gap:int,support:long,roles:array<long>>>"


def nest(classes: int, tested: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, int]]:
    """(parent, gap) of each valid class (-1, 0 for outermost ones) from (class, other, low, high) rows.

    Valid are the ordered classes that are nested in another ordered class, and the outermost one; a class that lies now in
    one gap and now in another, or crosses the others, is none.
    """
    ordered = {c for c, d, a, z in tested if d == -1 and a == z >= 0}
    inside = {(c, d): a for c, d, a, z in tested if d >= 0 and a == z > 0}
    above = {c: [d for d in ordered if (c, d) in inside] for c in sorted(ordered) if c < classes}
    out = {}
    for c, ups in above.items():
        if c and not ups and (c, 0) not in inside:
            continue  # outside the outermost class and not part of it
        # the parent is nested in all the others
        parent = max(ups, key=lambda d: (len(above.get(d, ())), -d), default=-1)
        out[c] = (parent, inside.get((c, parent), 0))
    return out


def templates(sequenced: DataFrame) -> DataFrame:
    """Per host of ``MIN_PAGES`` pages: its container's role, the roles of its fixed texts, its valid classes as a tree."""
    hosts = sequenced.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("total").alias("total"))
    found = candidates(vectors(sequenced), hosts)
    # a class is known by its lead role; classes are numbered by their first place on a page
    lead = F.array_distinct(F.transform("tokens", lambda t: F.struct(t["class_place"], t["class"])))
    found = found.withColumn("leads", F.transform(lead, lambda t: t["class"]))
    found = found.withColumn("index", F.transform("tokens", lambda t: (F.array_position(F.col("leads"), t["class"]) - 1).cast("int")))
    found = stored(found.drop("leads"), "template-candidates")
    tested = _test_classes(sequenced, found).groupBy("host").agg(F.collect_list(F.struct("class", "other", "low", "high")).alias("tested"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_template(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("host", pa.string()), ("pages", pa.int64()), ("container", pa.int64()), ("fixed", pa.list_(pa.int64())),
                ("classes", pa.list_(pa.struct([("parent", pa.int32()), ("gap", pa.int32()), ("support", pa.int64()), ("roles", pa.list_(pa.int64()))])))]))

    return found.join(tested, "host").select("host", "pages", "total", "tokens", "index", "tested").mapInArrow(work, TEMPLATE)


def _template(row: dict) -> dict:
    tokens, index = row["tokens"], row["index"]
    valid = nest(max(index) + 1, [(t["class"], t["other"], t["low"], t["high"]) for t in row["tested"]])
    mine = [(t, c) for t, c in zip(tokens, index) if c in valid]
    fixed = [t["role"] for t, _ in mine if t["kind"] == TEXT and t["n_pages"] >= TEXT_SHARE * row["pages"]]
    # once on every page that has it, with most of the host's text: such containers lie in one another, the last one is the innermost
    boxes = [t for t, _ in mine if t["kind"] == BOX and t["n_occ"] == t["n_pages"] and t["chars"] >= MAIN_SHARE * row["total"] > 0]
    container = max(boxes, key=lambda t: t["place"], default=None)
    classes = [{"parent": p, "gap": g, "support": next(t["n_pages"] for t, k in mine if k == c), "roles": [t["role"] for t, k in mine if k == c]}
               for c, (p, g) in sorted(valid.items())]
    return {"host": row["host"], "pages": row["pages"], "container": container and container["role"], "fixed": fixed, "classes": classes}


def main_text(page: str, container: int | None, fixed: frozenset, scanner: Scanner) -> tuple[str, int]:
    """The page's text in its main slot, and the number of template blocks left out."""
    _, blocks, elements = scanner.scan(page)
    signed = lambda r: r - (1 << 64) if r >> 63 else r
    box = container is not None and next((e for e in elements if signed(e.path) == container and not e.out()), None)
    regions = any(e.main and not e.out() for e in elements)
    kept, frame = [], []
    title = True  # a heading before the container is the article's
    for around, pieces in blocks:
        pieces = [p for p in pieces if p[0] is None or not p[0].out()]
        text = block_text(pieces) if pieces else ""
        if not text:
            continue
        up, inside = around, False
        while box and up is not None and not inside:
            inside, up = up is box, up.parent
        if not box:
            inside = around is not None and around.main or not regions
        heading = not inside and title and around is not None and around.name == "h1"
        if inside or heading:
            title = title and not inside
            kept.append(text)
            frame.append(not heading and all(signed(p[2]) in fixed for p in pieces if p[2]))
    framed = sum(len(t) for t, f in zip(kept, frame) if f)
    if 2 * framed > sum(map(len, kept)):
        frame = [False] * len(kept)
    return "\n".join(t for t, f in zip(kept, frame) if not f), sum(frame)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars, n_template_blocks of every page row.

    Null or empty html gives an empty text; pages without a host are one group; repeated rows stay and count as pages of
    their own; other columns are ignored; no rows give no rows. Character references are decoded, white space in a block is one space,
    blocks come in page order, one a line.
    """
    per_host = stored(templates(stored(sequences(pages, url, html), "page-tokens")), "templates")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = with_host(rows, per_host.select("host", "container", "fixed"), "key", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            known, out = {}, []
            for host, page, container, fixed in zip(b.column("host").to_pylist(), b.column("html"), b.column("container"), b.column("fixed")):
                if host not in known:
                    known[host] = (container.as_py(), frozenset(fixed.as_py() or ()))
                out.append(main_text(page.as_py(), *known[host], scanner))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("url"), pa.array([t for t, _ in out], pa.string()), pa.array([len(t) for t, _ in out], pa.int64()),
                 pa.array([n for _, n in out], pa.int64())], names=["key", "url", "text", "n_chars", "n_template_blocks"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.select("key", "url", "host", "html", "container", "fixed").mapInArrow(
        work, f"key {kinds['key']}, url {kinds['url']}, text string, n_chars long, n_template_blocks long")
    return out.withColumnRenamed("key", key)
