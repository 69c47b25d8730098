"""Benchmark decontamination by template canonicalisation.

A text becomes a row of canonical tokens: the white-space separated words without the marks around them, lower-cased;
numbers, units (after a number) and names (capitalised inside a sentence) are replaced by the typed placeholders
``<num>``, ``<unit>`` and ``<name>``. In scripts written without spaces every character is a word. Windows of ``WINDOW``
canonical tokens are hashed and joined with the benchmark's.
A match must fill the placeholders consistently: along one alignment of document and item, equal values of the item
stand for equal values of the document (different ones may coincide). Windows with a value that stands for several are left
out, unless they have the item's own values throughout. Windows with names are hashed with the names as plain words, too, so that an
item is found again in capitals or small letters alone. An item counts as leaked when the
windows matched this way make up at least ``COVERAGE`` of its own.

Null text counts as empty; items without a word match nothing. Items with fewer tokens than a window are one window of
what they have, and documents give windows of these widths, too. Windows with fewer than ``MIN_PLAIN`` plain tokens are
too general as templates and are left out on both sides; items that are short or have no other windows are found by their
words as they stand, values included (an item of one word is in every document with this word). Null or repeated keys
and repeated rows keep their rows; an empty table on either side gives no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart.llm.common import free_name, pieces, span_sums, stored, temporary, whole_text

WINDOW = 8
MIN_PLAIN = 4
COVERAGE = 0.5
FILTER_WINDOWS = 4_000_000     # item windows (8 bytes each) that tasks may hold as a filter; beyond, all windows are joined
PIECE_BYTES = 1 << 20          # text that a task looks at at once, a document being the least
BROADCAST_WINDOWS = 50_000     # item windows (about 100 bytes each) on a broadcast side of the join
UNITS = frozenset("""mm cm m km in inch inches ft foot feet yd yards mile miles mg g kg t lb lbs oz pound pounds ton tons ml cl l
liter liters litre litres s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month
months year years hz khz mhz ghz w kw mw v a kwh j kj cal kcal pa bar psi k c f celsius fahrenheit degrees percent % usd eur
gbp dollar dollars euro euros cent cents kb mb gb tb mph kmh kph""".split())
PLAIN, NUM, UNIT, NAME = 0, 1, 2, 3
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*%?$")
_ENDS = re.compile(r"[.!?:][^\w]*$")
_CORE = re.compile(r"\w.*\w|\w", re.S)
# Thai, Lao, Tibetan, Burmese, Khmer, kana and Han: no spaces between words
_UNSPACED = re.compile("([\u0e01-\u0e4f\u0e80-\u0ecf\u0edc-\u0eff\u0f40-\u0fbf\u1000-\u103f\u1050-\u108f\u1780-\u17d3\u3005-\u3007\u3040-\u30ff"
                       "\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
_HASH = {NUM: np.uint64(0x1F83D9ABFB41BD6B), UNIT: np.uint64(0x5BE0CD19137E2179), NAME: np.uint64(0x3C6EF372FE94F82B)}
_EXACT = np.uint64(0xA54FF53A5F1D36F1)  # keeps hashes of plain words apart from those of templates


def _text_hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Canonical:
    """Canonical tokens of texts; what a chunk is by itself is looked up, context is vectorised."""

    LIMIT = 400_000

    def __init__(self):
        self.clear()

    def clear(self):
        # number of a chunk, and by number: hash of its plain form, value, kind flags
        self.number: dict[str, int] = {}
        self.hash, self.value, self.flags = [], [], []
        self.hash_array, self.flag_array = np.empty(0, np.uint64), np.empty(0, np.uint8)

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and flags by number; what was added since the last call is appended."""
        n = len(self.hash_array)
        if n < len(self.hash):
            self.hash_array = np.concatenate([self.hash_array, np.array(self.hash[n:], dtype=np.uint64)])
            self.flag_array = np.concatenate([self.flag_array, np.array(self.flags[n:], dtype=np.uint8)])
        return self.hash_array, self.flag_array

    def _add(self, chunk: str) -> int:
        body = chunk if chunk[-1:] not in (",", ".") else chunk[:-1]
        if body.isalpha():  # letters alone, or with one mark behind: what the patterns below would find
            core, number, ends = body, False, chunk[-1] == "."
        else:
            m = _CORE.search(chunk)
            core = m.group() if m else ""
            number, ends = bool(core and _NUMBER.match(core)), bool(_ENDS.search(chunk))
        low = core.lower()
        flags = 1 * bool(core) | 2 * number | 4 * (low in UNITS)
        flags |= 8 * (len(core) > 1 and core[0].isupper() and core[1:].islower()) | 16 * ends
        n = self.number[chunk] = len(self.hash)
        self.hash.append(_text_hash(low))
        self.value.append(low)
        self.flags.append(flags)
        return n

    def tokens(self, texts: list[str]):
        """Over all texts: each token's canonical hash, hash with names plain, plain hash, kind, chunk number; the texts' offsets."""
        if len(self.number) > self.LIMIT:
            self.clear()
        numbers, sizes = [], []
        for t in texts:
            if not t.isascii():
                t = _UNSPACED.sub(r" \1 ", t)
            chunks = t.replace("\n", " ").split(" ")
            if "\t" in t or "\r" in t:
                chunks = t.split()
            try:
                own = list(map(self.number.__getitem__, chunks))
            except KeyError:
                own = [self.number[c] if c in self.number else self._add(c) for c in chunks]
            numbers.append(np.array(own, dtype=np.int64))
            sizes.append(len(own))
        number = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        hashes, flags = self._arrays()
        of = np.repeat(np.arange(len(texts)), sizes)
        word = (flags[number] & 1) > 0 if len(number) else np.empty(0, bool)
        ends = (flags[number] & 16) > 0 if len(number) else np.empty(0, bool)
        # a sentence ends with the chunk before, whether that has a word or is marks alone
        ended = np.concatenate(([0], np.cumsum(ends)))[:-1][word]  # sentence ends before the chunk
        number, of = number[word], of[word]
        offsets = np.searchsorted(of, np.arange(len(texts) + 1))
        if not len(number):
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int8), number, offsets
        f = flags[number]
        head = np.zeros(len(number), dtype=bool)
        head[offsets[:-1][np.diff(offsets) > 0]] = True
        first = head | np.concatenate(([True], ended[1:] > ended[:-1]))
        kind = np.where(f & 2, NUM, PLAIN).astype(np.int8)
        kind[(kind == PLAIN) & ((f & 8) > 0) & ~first] = NAME
        after_num = np.concatenate(([False], kind[:-1] == NUM)) & ~head
        kind[((f & 4) > 0) & after_num] = UNIT
        plain = h = hashes[number]
        for k, v in _HASH.items():
            h = np.where(kind == k, v, h)
        return h, np.where(kind == NAME, plain, h), plain, kind, number, offsets


# (exact, width): templates need MIN_PLAIN plain tokens, exact windows none
WINDOW_KINDS = [*[(False, n) for n in range(MIN_PLAIN, WINDOW + 1)], *[(True, n) for n in range(1, WINDOW + 1)]]
WINDOW_ROWS = "pos int, w long, slots array<string>, n_windows int, exact boolean, width int"
_CANON: list[Canonical] = []


def windows(tokens, kinds, whole: bool):
    """For each of ``kinds``: (exact, width, start tokens, hashes, whether names are placeholders); and the number of windows
    per text. ``whole``: texts are items, so widths under WINDOW are for texts of this size alone and exact windows for
    those that are short or have no others."""
    h, nameless, raw, kind, _, offsets = tokens
    sizes = np.diff(offsets)
    of, stop = np.repeat(np.arange(len(sizes)), sizes), np.repeat(offsets[1:], sizes)
    plain, names = (np.concatenate(([0], np.cumsum(kind == k))) for k in (PLAIN, NAME))
    n, sums, out = np.zeros(len(sizes), np.int64), {}, []

    def hashes(name, values, at, width):
        if name not in sums:
            sums[name] = span_sums(values)
        return sums[name](at, at + width)

    for exact, width in kinds:
        at = np.arange(max(len(h) - width + 1, 0))
        fits = at + width <= stop[at]
        if whole and width < WINDOW:
            fits &= sizes[of[at]] == width
        elif whole and exact:
            fits &= n[of[at]] == 0
        if exact:
            at = at[fits]
            out.append((True, width, at, hashes("raw", raw, at, width) ^ _EXACT, np.zeros(len(at), bool)))
            if whole:
                n = np.maximum(n, np.bincount(of[at], minlength=len(n)))
            continue
        n_plain, n_names = plain[width:] - plain[:-width], names[width:] - names[:-width]
        typed = at[fits & (n_plain >= MIN_PLAIN)]
        # with names as plain words: every window again that has one (there are no fewer plain tokens then)
        enough = fits & (n_plain + n_names >= MIN_PLAIN)
        again = at[enough & (n_names > 0)]
        if whole:
            n += np.bincount(of[at[enough]], minlength=len(n))
        out.append((False, width, np.concatenate([typed, again]),
                    np.concatenate([hashes("typed", h, typed, width), hashes("nameless", nameless, again, width)]),
                    np.arange(len(typed) + len(again)) < len(typed)))
    return out, n


def window_rows(texts: DataFrame, kinds=None, keep=None) -> DataFrame:
    """One row per window of ``texts`` (columns and the text in ``t``): the columns but t, pos, w (hash), slots ("kind value" per
    placeholder), n_windows of the text, exact, width. ``kinds``: the (exact, width) that the items have; none: the texts are
    the items. ``keep``: a broadcast dictionary of sorted hashes by kind, other windows are left out."""
    columns = [c for c in texts.columns if c != "t"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _CANON:
            _CANON.append(Canonical())
        canon, wanted = _CANON[0], None if keep is None else keep.value
        for part in pieces(batches, "t", PIECE_BYTES):  # the windows of all kinds stand side by side: tens of bytes for one of text
            tokens = canon.tokens(part.column("t").to_pylist())
            _, _, _, kind, number, offsets = tokens
            if not len(kind):
                continue
            found, n = windows(tokens, WINDOW_KINDS if kinds is None else kinds, kinds is None)
            for exact, width, at, w, named in found:
                if wanted is not None and len(w):
                    own = wanted[exact, width]
                    hit = own[np.minimum(np.searchsorted(own, w), len(own) - 1)] == w
                    at, w, named = at[hit], w[hit], named[hit]
                if not len(at):
                    continue
                of = np.searchsorted(offsets, at, side="right") - 1
                slots = [[] if exact else [f"{kind[k]} {canon.value[number[k]]}" for k in range(a, a + width)
                                           if kind[k] and (names or kind[k] != NAME)] for a, names in zip(at, named)]
                rows = part.take(pa.array(of))
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in columns], pa.array((at - offsets[of]).astype(np.int32)), pa.array(w.view(np.int64)),
                     pa.array(slots, pa.list_(pa.string())), pa.array(n[of].astype(np.int32)),
                     pa.array(np.full(len(at), exact)), pa.array(np.full(len(at), width, np.int32))],
                    names=[*columns, "pos", "w", "slots", "n_windows", "exact", "width"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "t")
    return texts.mapInArrow(emit, f"{kept}, {WINDOW_ROWS}")


def _packed(group: pa.Table) -> pa.Table:
    w = np.sort(group.column("w").to_numpy().view(np.uint64))
    return pa.table({"exact": group.column("exact")[:1], "width": group.column("width")[:1].cast(pa.int32()), "w": pa.array([w.astype("<u8").tobytes()], pa.binary())})


def leaked_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """One row per document and item leaked into it: doc_key, doc_h (md5 of the text), item_id, n_matched (item windows), coverage."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("item_id"), whole_text(item_text).alias("t"))
    own = stored(window_rows(items), "benchmark-windows")
    kinds = sorted((r["exact"], r["width"]) for r in own.select("exact", "width").distinct().collect())
    hashes = own.select("exact", "width", "w").distinct()
    n = hashes.limit(FILTER_WINDOWS + 1).count()
    keep = None
    if n <= FILTER_WINDOWS:
        packed = hashes.groupBy("exact", "width").applyInArrow(_packed, "exact boolean, width int, w binary").collect()  # a row per kind
        keep = spark.sparkContext.broadcast({(r["exact"], r["width"]): np.frombuffer(bytes(r["w"]), "<u8") for r in packed})
    rows = docs.select(F.col(key).alias("doc_key"), whole_text(text).alias("t")).withColumn("doc_h", F.md5("t"))
    seen = window_rows(rows.select("doc_key", "doc_h", "t"), kinds, keep).select("doc_key", "doc_h", "pos", "w", "slots")
    right = own.select("item_id", F.col("pos").alias("item_pos"), F.col("w").alias("item_w"), F.col("slots").alias("item_slots"), "n_windows")
    if own.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        right = F.broadcast(right)
    hits = seen.join(right, F.col("w") == F.col("item_w"))
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    by = ["doc_key", "doc_h", "item_id", "shift"]
    hits = hits.withColumn("shift", F.col("pos") - F.col("item_pos"))
    # along one alignment: the windows, and the values of the item that stand for more than one of the document
    one = hits.groupBy(*by).agg(
        F.collect_set(F.struct("item_pos", (F.col("item_slots") == F.col("slots")).alias("same"), pairs.alias("pairs"))).alias("found"),
        F.max("n_windows").alias("n"))
    one = one.withColumn("pairs", F.array_sort(F.array_distinct(F.flatten("found.pairs"))))
    one = one.withColumn("torn", F.transform(F.filter("pairs", lambda p, i: (i > 0) & (p["a"] == F.get("pairs", i - 1)["a"])), lambda p: p["a"]))
    good = F.filter("found", lambda x: x["same"] | ~F.arrays_overlap(x["pairs"]["a"], F.col("torn")))
    good = one.select(*by, "n", F.array_distinct(F.transform(good, lambda x: x["item_pos"])).alias("found"))
    out = good.groupBy("doc_key", "doc_h", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).cast("long").alias("n_matched"), F.max("n").alias("n"))
    out = out.withColumn("coverage", F.col("n_matched") / F.col("n"))
    return out.where(F.col("coverage") >= COVERAGE).drop("n")


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a leaked item, with their own columns."""
    k, h, row_h = (free_name(x, docs.columns) for x in ("doc_key", "doc_h", "_row_h"))
    with temporary(docs.sparkSession):
        bad = leaked_items(docs, benchmark, key, text).select(F.col("doc_key").alias(k), F.col("doc_h").alias(h))
        bad = stored(bad.distinct(), "leaks", keep=True)
    rows = docs.withColumn(row_h, F.md5(whole_text(text)))
    return rows.join(bad, (F.col(row_h) == F.col(h)) & rows[f"`{key}`"].eqNullSafe(F.col(k)), "left_anti").drop(row_h)
