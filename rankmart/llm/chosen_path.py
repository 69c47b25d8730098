"""Jaccard join of word n-gram sets by chosen paths, and the near-duplicate classes that follow from it.

Sets are embedded as ``COORDS`` min-hash coordinates: each is one sampled token of the set, and two sets share
it with the probability of their similarity. A run starts with all sets in one bucket; a bucket picks
``BRANCHES`` coordinates by a hash of its own path and sends each set to one child per coordinate, named by the
token found there. Buckets are compared by brute force in blocks of ``CHUNK`` sets, so that no group is ever gathered whole;
a block gives a set one row for each chunk of its bucket, a split one for each branch, so only buckets of more than ``BRANCHES``
chunks (``whole_limit``) are split again, unless they no longer shrink (their sets are alike). Before such a large bucket is split or compared, all its sets are compared
with one of them, its pivot: those that agree with it somewhat (``PIVOT``) are tied to it, and those that
agree well (``LEAVE``) leave the bucket. As the share of different tokens is a distance, what is
similar to a set that left is at most a little farther from the pivot, so it is tied to the pivot, too, and no link is lost;
a group of near copies costs a row or two for each of its sets and run, however large it is. Runs repeat until the chance to miss a pair at the
threshold is under 1 - ``RECALL``.

Compared sets whose coordinates agree well enough are tied together; texts tied directly or by a chain are then
compared exactly, n-gram set against n-gram set, again in blocks. Neither step ever writes out pairs: a block
returns each of its texts once, with its number of links and the first text it is connected to.

Identical texts are one node (only counted, never expanded). Null text counts as empty; texts without words
have no n-grams and no links; texts of 1..n-1 words are one n-gram. Null or repeated keys and repeated rows are
kept as rows of the result. An empty table gives an empty result. Classes are named by their smallest key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmart.llm.common import free_name, mix, pieces, span_hashes, stored, temporary, text_buffer, whole_text, word_spans

WORDS = 5
THRESHOLD = (4, 5)   # similarity as a fraction, so that 0.8 is compared exactly
COORDS = 64
BRANCHES = 5         # with two runs the least buckets per set for the recall below
CHUNK = 512          # sets of a brute-force block of signatures
TEXT_CHUNK = 512     # texts of a block of exact comparisons
CHUNK_BYTES = 2 << 20  # bytes of these texts, about
PIECE_BYTES = 2 << 20  # text that is hashed at once, a text being the least
RECALL = 0.99999
SHRINK = 0.5         # a child this large beside its parent is not split any more
AGREE = 0.55         # share of coordinates; 5 standard deviations below the threshold
PIVOT = 0.40         # share of coordinates for a tie to the pivot
LEAVE = 0.84         # share of coordinates to leave with the pivot: distance 0.26 at two deviations, 0.46 with the threshold's 0.2
MAX_DEPTH = 30
MAX_ROUNDS = 100
BROADCAST_ROWS = 20_000
BROADCAST_KEYS = 300_000  # rows of digests and keys, about 100 bytes each, that go to the texts; beyond, the texts are shuffled


def runs_needed(recall: float = RECALL, depth: int = 6) -> int:
    """Runs until a pair at the threshold, taken two standard deviations unlucky in its coordinates, is met."""
    p = THRESHOLD[0] / THRESHOLD[1]
    p -= 2 * math.sqrt(p * (1 - p) / COORDS)
    miss = 0.0
    for _ in range(depth):
        miss = (1 - p * (1 - miss)) ** BRANCHES
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def whole_limit() -> int:
    """Sets of the largest bucket that is compared and not split: its blocks have no more rows than its children would have."""
    return BRANCHES * CHUNK


def shingles(column, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word n-grams (A-Z folded) of each text, and the texts' offsets among them."""
    data, offsets = text_buffer(column)
    starts, ends = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h), dtype=np.uint64)
        for k in range(words):  # a short text's single n-gram takes the words there are
            shifted = np.zeros_like(h)
            shifted[:max(len(h) - k, 0)] = h[k:]
            inside = np.arange(len(h)) + k < np.repeat(first[1:], n)
            total += np.where(inside, mix(shifted + np.uint64(k)), np.uint64(0)) * np.uint64(2 * k + 1)
        total = mix(total)
    whole = np.arange(len(h)) + words <= np.repeat(first[1:], n)
    head = np.zeros(len(h), dtype=bool)
    head[first[:-1][n > 0]] = True
    keep = whole | (head & (np.repeat(n, n) < words))
    count = np.concatenate(([0], np.cumsum(keep)))
    return total[keep], count[first]


_KEYS = mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Min-hash coordinates (32 bits) of each non-empty set; rows in order of the non-empty sets."""
    heads = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(heads), COORDS), dtype=np.uint32)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(heads):  # slices of some hundred thousand hashes stay in cache
            hi = max(lo + 1, int(np.searchsorted(heads, heads[lo] + 100_000)))
            stop = heads[hi] if hi < len(heads) else len(hashes)
            own, at = hashes[heads[lo]:stop], heads[lo:hi] - heads[lo]
            for k in range(COORDS):
                out[lo:hi, k] = np.minimum.reduceat(((own ^ _KEYS[k]) * _KEYS[COORDS + k]) >> np.uint64(32), at)
            lo = hi
    return out


def _children(path: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (bucket path, set): row index and path of its children."""
    rows, paths = [], []
    with np.errstate(over="ignore"):
        for j in range(BRANCHES):
            pick = (mix(path + np.uint64(j + 1)) >> np.uint64(33)) % np.uint64(COORDS)
            token = sig[np.arange(len(sig)), pick.astype(np.int64)].astype(np.uint64)
            paths.append(mix(mix(path + np.uint64(101 * (j + 1))) ^ (token * np.uint64(0x9E3779B97F4A7C15) + pick)))
            rows.append(np.arange(len(sig)))
    rows, paths = np.concatenate(rows), np.concatenate(paths)
    _, first = np.unique(np.stack([rows.astype(np.uint64), paths]), axis=1, return_index=True) if len(rows) else (None, [])
    return rows[first], paths[first]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, COORDS)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of 0..n-1 by the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by ``keys``, with each row's group number."""
    held: pa.Table | None = None

    def number(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            values = t.column(k).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.cumsum(change)

    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        groups = number(held)
        cut = int(np.searchsorted(groups, groups[-1]))  # the last group may go on in the next batch
        if cut:
            yield held.slice(0, cut), groups[:cut]
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held, number(held)


def _blocks(rows: DataFrame, size: str, chunk: int, spread, weight: str | None = None) -> DataFrame:
    """Each member of a group once per pair of chunks it takes part in: columns i <= j and own chunk c. ``weight``: bytes of the group."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col(size) / chunk)).cast("int")
    if weight:
        chunks = F.greatest(chunks, F.least(F.col(size), F.ceil(F.col(weight) / CHUNK_BYTES)).cast("int"))
    rows = rows.withColumn("n_chunks", chunks).withColumn("c", F.pmod(spread, F.col("n_chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    return rows.withColumns({"i": F.least("c", "other"), "j": F.greatest("c", "other")}).drop("n_chunks", "other", size, *([weight] if weight else []))


def _stars(edges: DataFrame) -> DataFrame:
    """Distinct edges (a > b) that connect what ``edges`` (a, b) do: every a keeps the smallest node it is tied to, and hands that to the others.

    The members of a group name the same few nodes again and again, so about one edge a member is left of their ties. No node is
    gathered: an a has as many rows as blocks and buckets it was in."""
    edges = stored(edges.where("a != b").distinct(), "edges")
    low = F.least("a", F.min("b").over(Window.partitionBy("a"))).alias("low")
    own = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("low")).select("a", F.col("low").alias("b"))
    handed = edges.select(F.col("b").alias("a"), low).select("a", F.col("low").alias("b"))
    both = own.unionByName(handed).where("a != b")
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (a > b) are stars: every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    per_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return per_node.where("down > 1 OR down = 1 AND up = 1").isEmpty()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): root is the smallest node connected.

    Rounds of the large-star and small-star steps: every node hands its neighbours the smallest node it knows. Stored
    after each round; the rounds end when the edges are stars (their number grows with the log of the longest chain).
    """
    e = stored(_stars(edges), name)
    for _ in range(MAX_ROUNDS):
        if _settled(e):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("k"), F.least("a", "low").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low2, F.col("a") == F.col("k"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        e = stored(small.where("a != b").distinct(), name)
    else:
        raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _signature_rows(texts: DataFrame) -> DataFrame:
    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t", PIECE_BYTES):
            hashes, offsets = shingles(b.column("t"))
            sig = signatures(hashes, offsets)
            raw = np.ascontiguousarray(sig.astype("<u4")).tobytes()
            has = pa.array(np.diff(offsets) > 0)
            width = 4 * COORDS
            yield pa.RecordBatch.from_arrays([b.column("h").filter(has), pa.array(
                [raw[i:i + width] for i in range(0, len(raw), width)], pa.binary())], names=["h", "sig"])

    return texts.mapInArrow(embed, "h string, sig binary")


def candidate_ties(sigs: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets met in one bucket with agreeing coordinates."""
    spark = sigs.sparkSession
    runs = runs_needed()

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each set's first buckets, one round of children for every run."""
        for b in batches:
            sig, h = _matrix(b.column("sig")), b.column("h")
            got = [_children(np.full(len(sig), mix(np.array([r + 1], np.uint64))[0]), sig) for r in range(runs)]
            at, path = (np.concatenate(x) for x in zip(*got))
            yield pa.RecordBatch.from_arrays([h.take(pa.array(at)), pa.array(path.astype(np.int64)), pa.array(np.full(len(at), 1 << 62), pa.int64())],
                                             names=["h", "path", "parent"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of large buckets: ties to the pivot (p), the children of sets that stay, or the sets themselves where the bucket
        is not split any more (whole)."""
        for b in batches:
            sig, h, p = _matrix(b.column("sig")), b.column("h"), b.column("pivot")
            agree = (sig == _matrix(b.column("pivot_sig"))).mean(axis=1)
            other = np.array(h.to_pylist(), dtype=object) != np.array(p.to_pylist(), dtype=object)
            whole, path, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("whole", "path", "n"))
            tied = np.flatnonzero((agree >= PIVOT) & other)
            stay = np.flatnonzero((agree < LEAVE) & whole)
            down = np.flatnonzero((agree < LEAVE) & ~whole)
            at, child = _children(path[down].astype(np.uint64), sig[down])
            rows = np.concatenate([tied, stay, down[at]])
            kind = np.repeat([0, 1, 2], [len(tied), len(stay), len(at)])
            to = pa.array(np.where(kind == 0, rows, 0))
            yield pa.RecordBatch.from_arrays(
                [h.take(pa.array(rows)), pc.if_else(pa.array(kind == 0), p.take(to), pa.scalar(None, pa.string())),
                 pa.array(np.concatenate([path[tied], path[stay], child.astype(np.int64)])), pa.array(n[rows], pa.int64()), pa.array(kind == 1)],
                names=["h", "p", "path", "parent", "whole"])

    level = stored(sigs.mapInArrow(start, "h string, path long, parent long"), "paths")
    leaves, ties = [], []
    for depth in range(MAX_DEPTH):
        size = level.groupBy("path").agg(F.count("*").alias("n"), F.min("h").alias("pivot")).where("n > 1").withColumnRenamed("path", "at")
        rows = stored(level.join(size, F.col("path") == F.col("at")).drop("at"), "buckets")
        leaves.append(rows.where(F.col("n") <= whole_limit()).select("h", "path", "n"))
        large = rows.where(F.col("n") > whole_limit())
        if large.isEmpty():
            break
        pivots = large.select(F.col("pivot").alias("x")).distinct()
        few = pivots.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # 300 bytes each with their coordinates
        small = F.broadcast if few else (lambda df: df)
        pivots = stored(sigs.join(small(pivots), F.col("h") == F.col("x")).select("x", F.col("sig").alias("pivot_sig")), "pivots")
        whole = (F.col("n") >= F.col("parent") * SHRINK) | F.lit(depth == MAX_DEPTH - 1)
        large = large.join(sigs, "h").join(small(pivots), F.col("pivot") == F.col("x")).select("h", "path", "n", whole.alias("whole"), "pivot", "sig", "pivot_sig")
        found = stored(large.mapInArrow(grow, "h string, p string, path long, parent long, whole boolean"), "paths")
        ties.append(found.where("p IS NOT NULL").select(F.col("h").alias("a"), F.col("p").alias("b")))
        stay = found.where("whole")
        left = stay.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("path", "at")
        leaves.append(stay.join(left, F.col("path") == F.col("at")).select("h", "path", "n"))
        level = found.where("p IS NULL AND NOT whole").select("h", "path", "parent")
        if level.isEmpty():
            break
    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    rows = _blocks(rows.join(sigs, "h"), "n", CHUNK, F.xxhash64("h"))
    keys = ["path", "i", "j"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "h")  # what a block ties is named by its smallest digest, in every block

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in grouped(batches, keys):
            sig = _matrix(t.column("sig"))
            edges_a, edges_b = [], []
            for d in range(1, len(group)):
                a = np.flatnonzero(group[:-d] == group[d:])
                if not len(a):
                    break
                for lo in range(0, len(a), 8192):
                    x = a[lo:lo + 8192]
                    near = (sig[x] == sig[x + d]).sum(axis=1) >= AGREE * COORDS
                    edges_a.append(x[near])
                    edges_b.append(x[near] + d)
            a = np.concatenate([*edges_a, np.empty(0, np.int64)]).astype(np.int64)
            b = np.concatenate([*edges_b, np.empty(0, np.int64)]).astype(np.int64)
            label = local_components(len(group), a, b)
            # what is tied within a chunk comes from the chunk's own block; a block of two chunks adds one tie for each
            # of their parts that it joins, so a large bucket gives each member about once, not once per block
            chunk = t.column("c").to_numpy()
            own = chunk[a] == chunk[b]
            part = local_components(len(group), a[own], b[own])
            at = np.arange(len(label))
            across = t.column("i").to_numpy() != t.column("j").to_numpy()
            tied = np.flatnonzero((label != at) & (~across | (part == at)))
            h = t.column("h").combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.chunked_array([h]).take(pa.array(tied)).combine_chunks(),
                                              pa.chunked_array([h]).take(pa.array(label[tied])).combine_chunks()], names=["a", "b"])

    out = rows.select("path", "i", "j", "c", "h", "sig").mapInArrow(tie, "a string, b string")
    for tied in ties:
        out = out.unionByName(tied)
    return out


def exact_links(members: DataFrame) -> DataFrame:
    """Rows (h, links, root) from texts (root, n, bytes, h, t): exact comparison of all texts under one root."""
    num, den = THRESHOLD
    rows = _blocks(members, "n", TEXT_CHUNK, F.xxhash64("h"), "bytes")
    keys = ["root", "i", "j"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in grouped(batches, keys):
            h, chunk = t.column("h").to_pylist(), t.column("c").to_numpy()
            i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
            out_h, out_n, out_root = [], [], []
            for lo, hi in zip(cuts, cuts[1:]):
                at = sorted({h[r]: r for r in range(lo, hi)}.values())  # a repeated row counts once
                if len(at) < 2:
                    continue
                common, size = common_counts(t.column("t").take(pa.array(at)))
                union = size[:, None] + size[None, :] - common
                link = (common > 0) & (den * common >= num * union)
                np.fill_diagonal(link, False)
                if i[lo] != j[lo]:  # a block of two chunks counts the pairs across alone
                    own = chunk[at]
                    link &= own[:, None] != own[None, :]
                a, b = np.nonzero(np.triu(link))
                label = local_components(len(at), a, b)
                linked = np.flatnonzero(link.any(axis=1))
                out_h += [h[at[r]] for r in linked]
                out_n += [int(link[r].sum()) for r in linked]
                out_root += [h[at[label[r]]] for r in linked]
            yield pa.RecordBatch.from_arrays([pa.array(out_h, pa.string()), pa.array(out_n, pa.int64()),
                                              pa.array(out_root, pa.string())], names=["h", "links", "root"])

    return rows.select("root", "i", "j", "c", "h", "t").mapInArrow(compare, "h string, links long, root string")


def common_counts(texts) -> tuple[np.ndarray, np.ndarray]:
    """Common n-grams of each pair of texts, and each text's number of distinct n-grams."""
    hashes, offsets = shingles(texts)
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    keys, where = np.unique(hashes, return_inverse=True)
    cells = np.unique(where * n + of)  # distinct (n-gram, text), by n-gram
    gram, of = cells // n, cells % n
    size = np.bincount(of, minlength=n).astype(np.int64)
    shared = np.bincount(gram, minlength=len(keys)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[gram]
    gram, of = number[gram[keep]], of[keep]
    common = np.zeros((n, n), dtype=np.float64)
    for lo in range(0, int(gram[-1]) + 1 if len(gram) else 0, 4096):  # only n-grams that two texts hold, some at a time
        a, z = np.searchsorted(gram, [lo, lo + 4096])
        block = np.zeros((n, 4096), dtype=np.float32)
        block[of[a:z], gram[a:z] - lo] = 1
        common += block @ block.T
    common = np.rint(common).astype(np.int64)
    np.fill_diagonal(common, size)
    return common, size


def few_keys(keys: DataFrame) -> DataFrame:
    """A stored table of keys, broadcast if it is small, so that the texts it is joined with stay where they are."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct text: h (its digest), first (smallest key with it), n_rows, n_links (other texts at or over the threshold), class_h
    (the class's smallest digest)."""
    rows = docs.select(F.col(key).alias("k"), whole_text(text).alias("t")).withColumn("h", F.md5("t"))
    texts = rows.groupBy("h").agg(F.min("k").alias("first"), F.count("*").alias("n_rows"), F.first(F.octet_length("t")).alias("size"))
    texts = stored(texts, "texts")
    sigs = stored(_signature_rows(rows.select("h", "t")).dropDuplicates(["h"]), "signatures")
    ties = components(candidate_ties(sigs), "ties")
    tied = ties.join(texts.select(F.col("h").alias("node"), "first", "size"), "node")
    sizes = tied.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumnRenamed("root", "r")
    tied = tied.join(sizes, F.col("root") == F.col("r"))
    # one row's text per tied node: the condition names the text as well as the key, so shared or null keys pick right
    tied = stored(tied.select(F.col("node").alias("x"), "root", "n", "bytes", "first"), "tied")
    members = rows.join(few_keys(tied), (F.col("h") == F.col("x")) & F.col("k").eqNullSafe(F.col("first")))
    links = stored(exact_links(members.select("root", "n", "bytes", "h", "t")), "links")
    classes = components(links.select(F.col("h").alias("a"), F.col("root").alias("b")), "classes")
    counted = links.groupBy("h").agg(F.sum("links").alias("n_links")).withColumnRenamed("h", "lh")
    found = stored(counted.join(classes, F.col("lh") == F.col("node")).select("lh", "n_links", "root"), "linked")
    return texts.join(found, F.col("h") == F.col("lh"), "left").select(
        "h", "first", "n_rows", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "h").alias("class_h"))


def _found(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``near_duplicates`` as a table of its own; what it was made from is removed."""
    with temporary(docs.sparkSession):
        return stored(near_duplicates(docs, key, text), "near-duplicates", keep=True)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, class_id (smallest key of its class), n_links (other texts linked to its text) and
    n_copies (other documents with its very text)."""
    found = _found(docs, key, text)
    names = found.groupBy("class_h").agg(F.min("first").alias("class_id")).withColumnRenamed("class_h", "ch")
    per_text = found.join(names, F.col("class_h") == F.col("ch")).select(
        F.col("h").alias("x"), "class_id", "n_links", (F.col("n_rows") - 1).alias("n_copies"))
    rows = docs.select(F.col(key).alias("k"), F.md5(whole_text(text)).alias("h"))
    return rows.join(per_text, F.col("h") == F.col("x")).select(F.col("k").alias(key), "class_id", "n_links", "n_copies")


def keep_one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents (own columns) with each class's smallest key, ties by the text's digest; one row each."""
    found = _found(docs, key, text)
    chosen = found.groupBy("class_h").agg(F.min(F.struct(F.col("first").isNull().alias("z"), "first", "h")).alias("c"))
    h, k, row_h = (free_name(x, docs.columns) for x in ("_h", "_k", "_row_h"))
    chosen = chosen.select(F.col("c.first").alias("ck"), F.col("c.h").alias("ch"))
    pairs = docs.select(docs[f"`{key}`"].alias("k"), F.md5(whole_text(text)).alias("h")).groupBy("k", "h").count()
    pairs = stored(pairs, "pairs")
    # the rows that go are far fewer than those that stay
    gone = pairs.join(chosen, (F.col("h") == F.col("ch")) & F.col("k").eqNullSafe(F.col("ck")), "left_anti").select(F.col("k").alias(k), F.col("h").alias(h))
    gone = few_keys(stored(gone, "gone"))
    rows = docs.withColumn(row_h, F.md5(whole_text(text)))
    kept = rows.join(gone, (F.col(row_h) == F.col(h)) & rows[f"`{key}`"].eqNullSafe(F.col(k)), "left_anti")
    if not pairs.where("count > 1").isEmpty():  # repeated rows of one document: the first stays
        kept = kept.dropDuplicates([key, row_h])
    return kept.drop(row_h)
