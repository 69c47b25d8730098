"""Source divergence audit: how far each source's words stand from those of the other sources of its language.

Every (lang, source) group prices every kept term of its language (a term in at least ``KEEP`` of the language's
documents) at ``1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``, all in whole numbers. The audit is a sparse
merge by pair tasks: a group's counts are arrays sorted by term id, cut into blocks of a bounded number of terms; the two
groups of each unordered pair meet block by block in a co-group, where the shorter array's ids are looked up in the longer
one's. Terms that both hold, that one holds and that neither holds are priced apart, so no array is ever filled up with
zeros, and a pair's sum serves both directions.

Work per task is bounded by the block; rows sent are groups x (groups of the language - 1) arrays, which the result (one
row for each ordered pair) needs anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmart.llm.common import mix, pieces, span_hashes, stored, text_buffer

KEEP = 30               # documents of the language a kept term is in
SMOOTH = 5
SCALE = 1_000_000_000
BLOCK_TERMS = 1 << 16   # expected terms in a block of ids
TOP_TERMS = 50
HELD_ROWS = 1 << 20     # distinct (group, term) rows that a task holds before it sends them

COUNTED = "lang string, source string, term string, n long, df long"
_ODD = np.uint64(0xA0761D6478BD642F)
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of every term: a run of ASCII letters and of characters beyond ASCII, whose bytes are all above 127."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    term = _IN_TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = term & (edge[:-1] | np.concatenate(([True], ~term[:-1])))
    ends = term & (edge[1:] | np.concatenate((~term[1:], [True])))
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans' bytes, one after the other."""
    at = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))] if len(starts) else np.empty(0, np.uint8)


class _Held:
    """Counts of (group, term), keyed by a 64-bit hash of both, with the term's bytes."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, column: pa.Array, group: np.ndarray) -> None:
        data, offsets = text_buffer(column)
        data = _LOWER[data]
        starts, ends = _term_spans(data, offsets)
        if not len(starts):
            return
        doc = np.repeat(np.arange(len(group)), np.diff(np.searchsorted(starts, offsets)))
        with np.errstate(over="ignore"):
            key = mix(span_hashes(data, starts, ends, lower=False) + (group[doc].astype(np.uint64) + np.uint64(1)) * _ODD)
        by = np.argsort(key, kind="stable")  # within a key, tokens stay in document order
        key, doc_by = key[by], doc[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(key)))
        df = np.add.reduceat((new | np.concatenate(([True], doc_by[1:] != doc_by[:-1]))).astype(np.int64), first)
        at = by[first]
        sizes = ends[at] - starts[at]
        self.parts.append((key[first], group[doc[at]], n, df, sizes, _gather(data, starts[at], sizes)))
        self.rows += len(first)

    def merge(self) -> None:
        if len(self.parts) < 2:
            return
        key, group, n, df, sizes = (np.concatenate(x) for x in list(zip(*self.parts))[:5])
        data = np.concatenate([p[5] for p in self.parts])
        starts = np.cumsum(sizes) - sizes
        key, first, where = np.unique(key, return_index=True, return_inverse=True)
        total = lambda x: np.bincount(where, x, len(key)).astype(np.int64)  # noqa: E731  exact below 2**53
        self.parts = [(key, group[first], total(n), total(df), sizes[first], _gather(data, starts[first], sizes[first]))]
        self.rows = len(key)

    def batch(self, groups: list[tuple[str, str]]) -> pa.RecordBatch:
        key, group, n, df, sizes, data = self.parts[0]
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        term = pa.StringArray.from_buffers(len(key), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))
        of = pa.array(group, pa.int64())
        lang, source = (pa.array([g[i] for g in groups], pa.string()).take(of) for i in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, term, pa.array(n, pa.int64()), pa.array(df, pa.int64())],
                                          names=["lang", "source", "term", "n", "df"])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, df) of the documents' terms, added up within each task only."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held = _Held()
        for b in pieces(batches, "t"):
            of = np.array([groups.setdefault(g, len(groups)) for g in zip(b.column("l").to_pylist(), b.column("s").to_pylist())], dtype=np.int64)
            held.add(b.column("t"), of)
            if held.rows > HELD_ROWS:
                held.merge()
                if held.rows > HELD_ROWS // 2:
                    yield held.batch(list(groups))
                    held = _Held()
        held.merge()
        if held.rows:
            yield held.batch(list(groups))

    return docs.select(plain(lang).alias("l"), plain(source).alias("s"), plain(text).alias("t")).mapInArrow(work, COUNTED)


def kept_counts(counted: DataFrame, keep: int = KEEP) -> DataFrame:
    """(lang, term, source, n) of the terms in at least ``keep`` documents of their language. One shuffle on (lang, term)
    serves the counts of the groups and of the language alike."""
    per = (counted.repartition("lang", "term").groupBy("lang", "term", "source")
                  .agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    return (per.withColumn("docs", F.sum("df").over(Window.partitionBy("lang", "term")))
               .filter(F.col("docs") >= keep).select("lang", "term", "source", "n"))


def price(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), by long division in base 1000: no product passes 2**63."""
    over = int(total) + SMOOTH * int(terms)
    if over >= 1 << 53:
        raise OverflowError("a group with 2**53 terms or more")
    rest, out = np.asarray(count, dtype=np.int64) + SMOOTH, np.int64(0)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // over, rest % over
    return out + 1


def _price_sql(n: Column, total: Column, terms: Column) -> Column:
    whole = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", whole(n + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + terms * SMOOTH)) + 1


def pair_cost(ids_a, n_a, total_a: int, ids_b, n_b, total_b: int, terms: int, block_terms: int) -> int:
    """Sum of the price differences over a block's terms: the shorter array's ids are searched in the longer one; what is
    left over is held by one group, and the terms of neither differ by the two groups' price of a missing term."""
    if len(ids_a) > len(ids_b):
        ids_a, n_a, total_a, ids_b, n_b, total_b = ids_b, n_b, total_b, ids_a, n_a, total_a
    at = np.searchsorted(ids_b, ids_a)
    both = at < len(ids_b)
    both[both] = ids_b[at[both]] == ids_a[both]
    p_a, p_b = price(n_a, total_a, terms), price(n_b, total_b, terms)
    none_a, none_b = int(price(np.zeros(1), total_a, terms)[0]), int(price(np.zeros(1), total_b, terms)[0])
    alone_b = np.ones(len(ids_b), dtype=bool)
    alone_b[at[both]] = False
    shared = np.abs(p_a[both] - p_b[at[both]]).sum()
    absent = block_terms - len(ids_a) - int(alone_b.sum())
    return int(shared) + int(np.abs(p_a[~both] - none_b).sum()) + int(np.abs(p_b[alone_b] - none_a).sum()) + absent * abs(none_a - none_b)


def _array(table: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    rows = table.column("terms")[0].values
    if rows is None or len(rows) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), table.column("total")[0].as_py()
    return rows.field("id").to_numpy().astype(np.int64), rows.field("n").to_numpy(), table.column("total")[0].as_py()


def _pair_sums(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    def cost(left: pa.Table, right: pa.Table) -> pa.Table:
        at = [left.column(c)[0].as_py() for c in ("lang", "a", "b")]
        value = pair_cost(*_array(left), *_array(right), left.column("v")[0].as_py(), left.column("block_terms")[0].as_py())
        return pa.table({"lang": [at[0]], "a": [at[1]], "b": [at[2]], "value": pa.array([value], pa.int64())})

    def side(c):  # columns of its own, as both sides come from the same tables
        rows = pairs.join(arrays.withColumnRenamed("source", c), ["lang", c])
        return rows.toDF(*rows.columns).groupBy("lang", "a", "b", "block")

    parts = side("a").cogroup(side("b")).applyInArrow(cost, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", keep: int = KEEP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the sum of price differences to each other source of the language, all ranks. Part ``term``: the
    terms a source prices above its language as a whole, the ``TOP_TERMS`` largest differences. Ranks go by value, then by
    the item's bytes. Null text, lang and source count as empty; a group or language without kept terms has pairs of
    value 0; no documents give no rows; repeated rows count as often as they occur.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = stored(docs.select(plain(lang).alias("lang"), plain(source).alias("source")).distinct(), "audit-groups")
    kept = stored(kept_counts(term_counts(docs, lang, source, text), keep), "audit-counts")
    per_term = kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    sizes = per_term.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    most = sizes.agg(F.max("v")).first()[0] or 1  # one number
    blocks = -(-int(most) // BLOCK_TERMS)
    ids = per_term.select("lang", "term", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")).withColumn(
        "id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")))
    ids = stored(ids, "audit-ids")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of = (groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
                .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"),
                        F.coalesce("lang_total", F.lit(0)).alias("lang_total")))

    # a group's array of each block, also where it is empty
    in_block = ids.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("block_terms"))
    lists = (kept.join(ids, ["lang", "term"]).groupBy("lang", "source", "block")
                 .agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("terms")))
    arrays = of.select("lang", "source", "v", "total").join(in_block, "lang").join(lists, ["lang", "source", "block"], "left")
    arrays = stored(arrays.withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<id:int,n:bigint>>)"))), "audit-arrays")
    others = groups.select("lang", F.col("source").alias("b"))
    pairs = groups.select("lang", F.col("source").alias("a")).join(others, "lang").filter(F.col("a") < F.col("b"))
    summed = pairs.join(_pair_sums(pairs, arrays), ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    both = summed.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    shape = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    pair = shape(both.select("lang", "x.source", "x.item", "value"), "pair")

    more = (kept.join(per_term, ["lang", "term"]).join(of, ["lang", "source"])
                .withColumn("value", _price_sql(F.col("n"), F.col("total"), F.col("v")) - _price_sql(F.col("lang_n"), F.col("lang_total"), F.col("v")))
                .filter(F.col("value") > 0).select("lang", "source", F.col("term").alias("item"), "value"))
    return pair.unionByName(shape(more, "term").filter(F.col("rank") <= TOP_TERMS))
