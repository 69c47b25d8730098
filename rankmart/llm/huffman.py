"""Token ids as canonical length-limited Huffman files.

Format: a Parquet folder ``blocks`` and a one-row Parquet folder ``book``. Every row of ``blocks`` is a
segment: consecutive documents of one range partition, in ascending key order. Its ``payload`` is the
segment's bit stream, most significant bit first; blocks of ``BLOCK`` ids start at the checkpointed bit
offsets (``offsets``: 64-bit, byte planes, zstd), so any block is decoded without those before it. ``keys``,
``null_keys`` and ``lengths`` list the documents. The code is canonical: the book holds the lengths of all ids alone,
and codes follow from (length, id). No code is longer than ``MAX_BITS``, so one table of 2**MAX_BITS entries
decodes any code by a single look-up.

Null text counts as empty (just the end id); null keys sort first; equal keys keep all their rows; an empty
table writes an empty folder and a book without codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmart.llm import tokenizing
from rankmart.llm.common import pack_ints, pieces, shuffle_width, stored, unpack_ints, whole_text

MAX_BITS = 18
BLOCK = 256            # ids between two bit-offset checkpoints
SEGMENT = 1 << 20      # ids of a segment, about; a longer document is a segment of its own
SCHEMA = ("part int, segment int, ids_before long, n_ids long, n_docs long, keys binary, null_keys binary, lengths binary, "
          "offsets binary, payload binary")


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur.

    ``limit`` rounds of merging the sorted symbols with the pairs of the round before; a symbol's length is
    the number of times it is in the cheapest 2n - 2 items of the last round.
    """
    used = np.flatnonzero(counts)
    n = len(used)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    rounds, pairs = [], np.empty(0)
    for _ in range(limit):
        cost = np.concatenate([leaf, pairs])
        is_leaf = np.concatenate([np.ones(n, bool), np.zeros(len(pairs), bool)])
        by = np.argsort(cost, kind="stable")
        cost, is_leaf = cost[by], is_leaf[by]
        rounds.append(is_leaf)
        even = len(cost) // 2 * 2
        pairs = cost[0:even:2] + cost[1:even:2]
    take, depth = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(rounds):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1  # leaves stand in cost order, so the first ones are taken
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id, as an integer of its length."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code, before = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if not lengths[i]:
            continue
        code <<= int(lengths[i]) - before
        codes[i], before = code, int(lengths[i])
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """For each next ``limit`` bits: id * 32 + code length."""
    table = np.zeros(1 << limit, dtype=np.uint32)
    codes = canonical_codes(lengths)
    for i in np.flatnonzero(lengths):
        n = int(lengths[i])
        at = int(codes[i]) << (limit - n)
        table[at:at + (1 << (limit - n))] = int(i) * 32 + n
    return table


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream of the ids and the bit offset of every block's start."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    starts = ends - n
    out = np.zeros(total // 32 + 3, dtype=np.uint64)  # words of 32 bits, in 64 for the carry-free sum
    word, shift = starts >> 5, (64 - (starts & 31) - n).astype(np.uint64)
    value = codes[ids].astype(np.uint64) << shift  # at most 31 + 18 bits: within one word and the next
    # codes of one word never overlap, so summing is setting bits
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    if len(heads):
        out[word[heads]] += np.add.reduceat(value >> np.uint64(32), heads)
        out[word[heads] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), heads)
    return out[: (total + 31) // 32].astype(">u4").tobytes(), starts[::BLOCK].astype(np.uint64)


def decode_bits(payload: bytes, offsets: np.ndarray, n_ids: int, table: np.ndarray) -> np.ndarray:
    """All ids of a segment: its blocks are decoded side by side, one id of each per step."""
    ids = np.empty((len(offsets), BLOCK), dtype=np.uint32)
    data = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8)
    wide = data[:-3].astype(np.uint32)  # 32 bits from every byte on
    wide = (wide << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    at, top = offsets.astype(np.int64), len(wide) - 1
    for k in range(min(BLOCK, n_ids)):
        found = table[(wide[np.minimum(at >> 3, top)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)]
        ids[:, k] = found >> 5
        at += found & 31
    return ids.reshape(-1)[:n_ids]


RAW = "part int, segment int, ids_before long, n_ids long, n_docs long, keys binary, null_keys binary, lengths binary, ids binary"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def key_bounds(keys: DataFrame, parts: int) -> np.ndarray:
    """At most ``parts`` - 1 ascending keys that cut the documents' keys into ranges of about one size (one row of them)."""
    shares = [(i + 1) / parts for i in range(parts - 1)]
    if not shares:
        return np.empty(0, np.int64)
    found = keys.agg(F.percentile_approx("k", shares, 20 * parts).alias("b")).first()["b"]
    return np.unique(np.array(found or [], dtype=np.int64))


def raw_segments(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str) -> DataFrame:
    """Segments of consecutive documents in ascending key order, their ids in two bytes each (four for a vocabulary that needs them).

    Each text is encoded once, where it is read; only ids move. The range of a document's key is its partition, found from
    the keys alone, so the partitioner has no texts to sample."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t"))
    bounds = spark.sparkContext.broadcast(key_bounds(rows.select("k"), shuffle_width(spark)))  # eight bytes per partition

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizing.loaded(tokenizing.ByteBpeBatch, tokenizer)
        end = np.array([end_id], dtype=bpe.dtype).tobytes()
        for b in pieces(batches, "t", bpe.BATCH_CHARS):
            ids = [x + end for x in bpe.batch(b.column("t"))]
            k = b.column("k")
            part = np.searchsorted(bounds.value, k.fill_null(-(1 << 63)).to_numpy(), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), k, pa.array(ids, pa.binary())], names=["part", "k", "ids"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(tokenizing.loaded(tokenizing.ByteBpeBatch, tokenizer).dtype).itemsize
        part, seq, before, keys, docs_ids, held = None, 0, 0, [], [], 0

        def flush():
            nonlocal keys, docs_ids, held, seq, before
            data = b"".join(docs_ids)
            n = len(data) // width
            row = (part, seq, before, n, len(keys), pack_ints(np.array([0 if k is None else k for k in keys], dtype="<i8")),
                   pack_ints(np.array([k is None for k in keys], dtype=np.uint8)),
                   pack_ints(np.array([len(d) // width for d in docs_ids], dtype="<u8")), pack_ints(np.frombuffer(data, f"<u{width}")))
            seq, before, keys, docs_ids, held = seq + 1, before + n, [], [], 0
            kinds = [pa.int32(), pa.int32()] + [pa.int64()] * 3 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=_columns(RAW))

        for b in batches:
            for p, k, ids in zip(b.column("part").to_pylist(), b.column("k").to_pylist(), b.column("ids").to_pylist()):
                if p != part:
                    if keys:
                        yield flush()
                    part, seq, before = p, 0, 0
                docs_ids.append(ids)
                keys.append(k)
                held += len(ids) // width
                if held >= SEGMENT:
                    yield flush()
        if keys:
            yield flush()

    encoded = rows.mapInArrow(encode, "part int, k long, ids binary")
    dealt = encoded.repartition(shuffle_width(spark), "part").sortWithinPartitions("part", "k")
    return stored(dealt.mapInArrow(segments, RAW), "raw-segments")


def _raw_ids(batch: pa.RecordBatch, dtype: str) -> Iterator[np.ndarray]:
    for ids, n in zip(batch.column("ids"), batch.column("n_ids")):
        yield unpack_ints(ids.as_py(), n.as_py(), dtype)


def global_counts(raw: DataFrame, vocab: int, dtype: str) -> np.ndarray:
    """Occurrences of every id in all segments; each task sends at most one row per id of the vocabulary."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, dtype=np.int64)
        for b in batches:
            for ids in _raw_ids(b, dtype):
                total += np.bincount(ids, minlength=vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    rows = raw.select("n_ids", "ids").mapInArrow(count, "id long, n long")
    out = np.zeros(vocab, dtype=np.int64)
    for r in rows.groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row per id of the vocabulary
        out[r["id"]] = r["n"]
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
              vocab: int | None = None) -> None:
    """Encode all documents and write them, in ascending key order, to ``path``."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    vocab, dtype = vocab or max(size, end_id + 1), "<u2" if size <= 1 << 16 else "<u4"
    if end_id >= 1 << 16 and dtype == "<u2":
        raise ValueError("the end id doesn't fit the ids' two bytes")
    raw = raw_segments(docs, tokenizer, end_id, key, text)
    lengths = code_lengths(global_counts(raw, vocab, dtype))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/book")
    codes = spark.sparkContext.broadcast((canonical_codes(lengths), lengths))  # 5 bytes per id of the vocabulary

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = codes.value
        for b in batches:
            for i, ids in enumerate(_raw_ids(b, dtype)):
                payload, offsets = encode_bits(ids, code, length)
                same = [b.column(c).slice(i, 1) for c in _columns(SCHEMA)[:8]]
                yield pa.RecordBatch.from_arrays([*same, pa.array([pack_ints(offsets.astype("<u8"))], pa.binary()), pa.array([payload], pa.binary())],
                                                 names=_columns(SCHEMA))

    raw.mapInArrow(pack, SCHEMA).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document, decoded from the files: key, start (ids before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    book = bytes(spark.read.parquet(f"{path}/book").first()["lengths"])
    shared = spark.sparkContext.broadcast(book)  # one byte per id of the vocabulary
    blocks = spark.read.schema(SCHEMA).parquet(f"{path}/blocks")
    # ids before each part: one row per range partition, of which the writer made a set number
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    placed = blocks.join(F.broadcast(parts), blocks["part"] == parts["p"])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = decode_table(np.frombuffer(shared.value, np.uint8))
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                offsets = unpack_ints(r.offsets, -(-r.n_ids // BLOCK), "<u8")
                ids = decode_bits(r.payload, offsets, r.n_ids, table)
                lengths = unpack_ints(r.lengths, r.n_docs, "<u8").astype(np.int64)
                keys = unpack_ints(r.keys, r.n_docs, "<i8")
                null = unpack_ints(r.null_keys, r.n_docs, np.uint8).astype(bool)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                at = 0
                for lo in range(0, r.n_docs, 256):  # documents in slices: a batch of whole segments would be large
                    hi = min(lo + 256, r.n_docs)
                    cut = [0 if lo == 0 else int(ends[lo - 1]), *map(int, ends[lo:hi])]
                    yield pd.DataFrame({
                        key: pd.array(keys[lo:hi], dtype="Int64").copy() if not null[lo:hi].any() else
                        pd.array([None if z else int(k) for k, z in zip(keys[lo:hi], null[lo:hi])], dtype="Int64"),
                        "start": r.part_start + r.ids_before + np.array(cut[:-1], dtype=np.int64),
                        "n_tokens": lengths[lo:hi], "ids": [raw[4 * a:4 * b] for a, b in zip(cut, cut[1:])]})

    return placed.select("n_ids", "n_docs", "keys", "null_keys", "lengths", "offsets", "payload", "ids_before", "part_start").mapInPandas(
        decode, f"`{key}` long, start long, n_tokens long, ids binary")
