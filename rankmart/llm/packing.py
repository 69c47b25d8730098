"""Best-fit packing by length patterns.

Documents become pieces of at most ``limit`` ids. What is packed is the histogram of their lengths (at most
``limit`` bins, however many documents there are): patterns of two or three lengths that fill a sequence
exactly are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and
rounded, and what the rounded counts leave is packed best-fit decreasing, again by length and multiplicity.
The plan says, for each length, which sequence and offset its r-th piece goes to; a piece knows its r from its
rank in its own part (counted where the piece is cut) and the length's counts in the parts before. So no task
or driver ever sees more than the histogram, and a length that a third of all pieces share is no hot key.

Null text counts as empty (a piece of the end id alone); null or repeated keys and repeated rows are pieces
like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmart.llm import tokenizing
from rankmart.llm.common import stored, whole_text

LIMIT = 4096
SPLITS = (0.5, 0.62, 0.75, 0.87)  # of the room beside a length, the share of a pattern's second length
ROUNDS = 300                      # of the least-squares fit
PIECES = "part int, rank long, {key} long, piece int, start long, length long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int = LIMIT, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """All documents' pieces with their ids, stored: part, rank (among the part's pieces of its length), key,
    piece, start, length, ids (little-endian unsigned 32-bit)."""
    names = ["part", "rank", key, "piece", "start", "length", "ids"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizing.loaded(tokenizing.WordBpe, tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, dtype=np.int64)
        for pdf in batches:
            rows = []
            for k, null, t in zip(pdf["k"], pdf["k_null"], pdf["t"]):
                ids = bpe.ids(t) + end
                for piece, at in enumerate(range(0, len(ids) // 4, limit)):
                    own = ids[4 * at:4 * (at + limit)]
                    n = len(own) // 4
                    rows.append((part, seen[n], None if null else k, piece, at, n, own))
                    seen[n] += 1
            out = pd.DataFrame(rows, columns=names)
            out[key] = out[key].astype("Int64")
            yield out

    rows = docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t"))
    rows = rows.select(F.coalesce("k", F.lit(0)).alias("k"), F.col("k").isNull().alias("k_null"), "t")
    return stored(rows.mapInPandas(cut, PIECES.format(key=f"`{key}`")), "pieces")


def enumerate_patterns(hist: np.ndarray, limit: int) -> np.ndarray:
    """Patterns of two and three lengths that fill ``limit`` exactly: rows of three lengths, 0 for none.

    All pairs, and for every length the triples that split the room beside it at the shares ``SPLITS``, as far
    as the histogram has their lengths: a number linear in ``limit``.
    """
    first = np.flatnonzero(hist[:limit])
    first = first[first > 0]
    found = [np.stack([first, limit - first, np.zeros_like(first)], axis=1)]
    for share in SPLITS:
        room = limit - first
        second = np.rint(room * share).astype(np.int64)
        found.append(np.stack([first, second, room - second], axis=1))
    pats = np.sort(np.concatenate(found), axis=1)[:, ::-1]
    used = (hist[pats] > 0) | (pats == 0)
    pats = pats[used.all(axis=1) & (pats[:, 1] > 0)]
    return np.unique(pats, axis=0)


def fit_counts(pats: np.ndarray, hist: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 with the lengths used, A x, as near the histogram as can be.

    A row of A is a length, a column a pattern with three entries at most, so accelerated projected gradient
    steps cost one gather and one bincount each.
    """
    n = len(hist)
    target = hist.astype(np.float64).copy()
    target[0] = 0
    apply = lambda x: np.bincount(pats.ravel(), np.repeat(x, 3), n) * (np.arange(n) > 0)
    # the largest eigenvalue of A'A is at most the largest column sum of A times the largest row sum
    step = 1.0 / (3 * max(1.0, apply(np.ones(len(pats))).max()))
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        slack = target - apply(y)
        slack[0] = 0
        new = np.maximum(0.0, y + step * slack[pats].sum(axis=1))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_sequences(hist: np.ndarray, limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often): uses every length of the histogram exactly as often as it occurs."""
    left = hist.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[limit]:
        plan.append(((limit,), int(left[limit])))
        left[limit] = 0
    pats = enumerate_patterns(left, limit)
    if len(pats):
        counts = np.rint(fit_counts(pats, left)).astype(np.int64)
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] <= 0:
                break
            own = tuple(int(x) for x in pats[i] if x)
            n = min(int(counts[i]), *(int(left[x]) // own.count(x) for x in own))
            if n > 0:
                plan.append((own, n))
                for x in own:
                    left[x] -= n
    plan += _best_fit(left, limit)
    return plan


def _best_fit(left: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on multiplicities: open sequences of one content are one entry with a count."""
    rooms: list[int] = []                       # room sizes of open sequences, ascending
    open_: dict[int, dict[tuple[int, ...], int]] = {}

    def add(room: int, content: tuple[int, ...], n: int):
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = {}
        open_[room][content] = open_[room].get(content, 0) + n

    for size in range(limit, 0, -1):
        n = int(left[size])
        while n:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):  # no room: new sequences, each as full of this size as it gets
                fit = limit // size
                whole, rest = divmod(n, fit)
                if whole:
                    add(limit - fit * size, (size,) * fit, whole)
                if rest:
                    add(limit - rest * size, (size,) * rest, 1)
                break
            room = rooms[i]
            content, there = open_[room].popitem()
            fit = min(room // size, n)
            took = min(there, n // fit)
            if there > took:
                open_[room][content] = there - took
            if not open_[room]:
                del open_[room], rooms[i]
            add(room - fit * size, content + (size,) * fit, took)
            n -= took * fit
    return [(content, n) for group in open_.values() for content, n in group.items()]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: from rank ``rank`` of ``length`` on, piece r sits in sequence
    ``sequence`` + (r - rank) // ``each`` at offset ``offset`` + (r - rank) % ``each`` * length."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for content, n in plan:
        at = 0
        for size in sorted(set(content), reverse=True):
            each = content.count(size)
            rank = taken.get(size, 0)
            rows.append((size, rank, sequence, each, at))
            taken[size] = rank + n * each
            at += each * size
        sequence += n
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T.copy()))


def place(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (stored; part, rank, length and any other columns) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = stored(counts, "piece-counts")
    hist = np.zeros(limit + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``limit`` rows
        hist[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(slots(plan_sequences(hist, limit)))
    before = counts.select(F.col("part").alias("b_part"), F.col("length").alias("b_length"), F.coalesce(
        F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    # the counts have a row per part and length and grow with the parts: joined by shuffle, never broadcast
    rows = pieces.join(before.hint("merge"), (F.col("part") == F.col("b_part")) & (F.col("length") == F.col("b_length")))
    rows = rows.select(*[pieces[f"`{c}`"] for c in pieces.columns if c != "rank"], (F.col("rank") + F.col("before")).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        # lengths and ranks in one sorted key: ranks stay below 2**48
        keys = (p["length"] << 48) + p["rank"]
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            r = rank - p["rank"][i]
            extra = [pa.array(p["sequence"][i] + r // p["each"][i]), pa.array(p["offset"][i] + r % p["each"][i] * length)]
            keep = [n for n in b.schema.names if n not in ("part", "rank")]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], *extra], names=[*keep, "sequence_id", "offset"])

    fields = [f for f in rows.schema.fields if f.name not in ("part", "rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return rows.mapInArrow(assign, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed pieces with their ids: key, piece, start, length, ids, sequence_id, offset."""
    return place(cut_pieces(docs, tokenizer, end_id, limit, key, text), limit)


def pack_digests(docs: DataFrame, tokenizer: str, end_id: int, limit: int = LIMIT, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """The packing with the ids' crc32 in place of the ids, taken from the stored pieces before they are moved."""
    pieces = cut_pieces(docs, tokenizer, end_id, limit, key, text)
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), limit)
