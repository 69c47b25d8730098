"""Language-model scores by deleted interpolation.

A text's probability mixes, token by token, the maximum-likelihood n-gram estimates of orders 1..``order`` and
a uniform floor 1 / (V + 1). The mixture weights depend on how often the context was seen (one bucket per power
of two), and are learned by expectation-maximisation on a deleted fold: for the training documents of fold
``DELETED`` the counts are taken without that fold.

How counts travel. Documents are processed in blocks (documents of one input partition, split by a hash of
the key). A block sends the sorted distinct 64-bit n-gram hashes it holds, each with its own counts, one
compressed row per hash range; a range is summed over all blocks in one group, and each block gets its n-grams'
corpus counts back in the order it sent them. So the shuffles carry one entry per distinct n-gram of a block,
whatever the number of its occurrences, a hot n-gram is one entry per block, and no task holds more than a
range or a block. Everything gathered grows with the corpus; nothing is cut off.

Null text counts as empty (its one token is the end), a null key as the empty string for the folds; repeated
rows count as often as they occur; an empty table gives an empty result. Without deleted documents the
weights stay uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart.llm.common import (mix, pack_ints, shuffle_width, span_hashes, stored, text_buffer, unpack_ints, whole_text,
                                 word_spans)

FOLDS = 10
HELD_OUT = 0            # documents of this fold are never learned from
DELETED = 9             # training documents of this fold teach the weights
BLOCK_BYTES = 4 << 20   # input bytes of a block, about
CONTEXT_BUCKETS = 48    # context never seen, seen 1, 2-3, 4-7, ...
STEP = 8                # held-out events are binned by estimates of 1/8 octave
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
GATHERED = "bucket int, block long, n long, docs long, deleted_docs long, hashes binary, train binary, deleted binary"
RETURNED = "block long, bucket int, n long, check long, train binary, deleted binary, tokens long, types long, deleted_tokens long, docs long, deleted_docs long"


def _tagged(h: np.ndarray, order: int) -> np.ndarray:
    """The n-gram's order in the two lowest bits, so all orders share one key space."""
    return (h & ~np.uint64(3)) | np.uint64(order - 1)


def ngrams(column, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order the tagged hashes of the n-grams that end at each token, and the documents' token offsets.

    Texts start with a virtual start symbol and end with the end token.
    """
    data, offsets = text_buffer(column)
    starts, ends = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    n_docs = len(offsets) - 1
    at = first + np.arange(n_docs + 1)  # every document before has one more token than words
    tokens = np.full(len(starts) + n_docs, END, dtype=np.uint64)
    is_word = np.ones(len(tokens), dtype=bool)
    is_word[at[1:] - 1] = False
    tokens[is_word] = span_hashes(data, starts, ends)
    out, before, prior = [_tagged(tokens, 1)], tokens, START
    with np.errstate(over="ignore"):
        for m in range(2, order + 1):
            context = np.empty_like(before)
            context[1:] = before[:-1]
            context[at[:-1]] = prior
            before = mix(context * np.uint64(0x9FB21C651E98DF25) + tokens * np.uint64(0xD6E8FEB86659FD93))
            prior = mix(np.array([prior * np.uint64(0x9FB21C651E98DF25) + START], dtype=np.uint64))[0]
            out.append(_tagged(before, m))
    return out, at


def _ranges(buckets: int) -> np.ndarray:
    return (np.arange(buckets, dtype=np.float64) * (2.0 ** 64 / buckets)).astype(np.uint64)


def _with_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    per_part = max(1, -(-_bytes_conf(spark.conf.get("spark.sql.files.maxPartitionBytes")) // BLOCK_BYTES))
    fold = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    rows = docs.select(F.col(key).alias("k"), whole_text(text).alias("t"), fold.alias("fold"),
                       F.spark_partition_id().cast("long").alias("part"))
    within = F.when(F.col("fold") == DELETED, F.lit(per_part)).otherwise(F.pmod(F.xxhash64("k"), F.lit(per_part)))
    return rows.select("k", "t", "fold", (F.col("part") * (per_part + 1) + within).alias("block"))


def _bytes_conf(text: str) -> int:
    text = text.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return int(text[:-1] if unit else text) << unit


def gather(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """Corpus counts of every block's n-grams, in the block's order (see the module)."""
    ranges = _ranges(buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            of, fold = b.column("block").to_numpy(), b.column("fold").to_numpy()
            grams, at = ngrams(b.column("t"), order)
            size = np.diff(at)
            token_block, token_fold = np.repeat(of, size), np.repeat(fold, size)
            for block in np.unique(of):
                mine = token_block == block
                own = held.setdefault(int(block), [[], [], 0, 0])
                own[0].append(np.concatenate([g[mine] for g in grams]))
                own[1].append(np.tile((token_fold[mine] != HELD_OUT), order))
                docs = fold[of == block]
                own[2] += int((docs != HELD_OUT).sum())
                own[3] += int((docs == DELETED).sum())
        for block in list(held):
            hashes, train, docs, deleted = held.pop(block)
            hashes, train = np.concatenate(hashes), np.concatenate(train)
            keys, where = np.unique(hashes, return_inverse=True)
            counts = np.bincount(where[train], minlength=len(keys)).astype("<u4")
            # a block holds documents of the deleted fold alone, or none of it
            gone = counts if deleted else np.zeros(len(keys), "<u4")
            cuts = [*np.searchsorted(keys, ranges), len(keys)]
            rows = []
            for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
                if z > a or i == 0:  # the first range carries the numbers of documents
                    gaps = np.diff(keys[a:z], prepend=np.uint64(0)).astype("<u8")
                    rows.append((i, block, int(z - a), docs if i == 0 else 0, deleted if i == 0 else 0, pack_ints(gaps),
                                 pack_ints(counts[a:z]), pack_ints(gone[a:z])))
            yield _batch(rows, GATHERED)

    def add(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        bucket = group.column("bucket")[0].as_py()
        part = lambda name, dtype: [unpack_ints(x.as_py(), int(k), dtype) for x, k in zip(group.column(name), n)]
        hashes = [np.cumsum(g, dtype=np.uint64) for g in part("hashes", "<u8")]
        keys, where = np.unique(np.concatenate(hashes), return_inverse=True)
        total = lambda name: np.bincount(where, np.concatenate(part(name, "<u4")), len(keys)).astype(np.int64)
        train, deleted = total("train"), total("deleted")
        word = (keys & np.uint64(3)) == 0
        sums = (int(train[word].sum()), int((train[word] > 0).sum()), int(deleted[word].sum()),
                int(group.column("docs").to_numpy().sum()), int(group.column("deleted_docs").to_numpy().sum()))
        rows, at = [(-1, bucket, 0, 0, b"", b"", *sums)], 0
        for block, k, own in zip(group.column("block").to_pylist(), n, hashes):
            mine = where[at:at + int(k)]
            at += int(k)
            rows.append((block, bucket, int(k), _check(own), pack_ints(train[mine].astype("<u8")),
                         pack_ints(deleted[mine].astype("<u8")), 0, 0, 0, 0, 0))
        return pa.Table.from_batches([_batch(rows, RETURNED)])

    sent = blocks.select("t", "fold", "block").mapInArrow(send, GATHERED)
    return stored(sent.groupBy("bucket").applyInArrow(add, RETURNED), "ngram-counts")


def _check(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys, initial=np.uint64(0)).astype(np.int64)) if len(keys) else 0


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [pa.field(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def _token_counts(texts: pa.Table, counts: pa.Table, order: int, buckets: int):
    """Per order the corpus counts (train, deleted) of the n-gram at each token; the documents' token offsets."""
    grams, at = ngrams(texts.column("t"), order)
    keys, where = np.unique(np.concatenate(grams), return_inverse=True)
    by = counts.sort_by("bucket")
    n = by.column("n").to_numpy()
    cuts = np.searchsorted(keys, _ranges(buckets)[by.column("bucket").to_numpy()])
    same = int(n.sum()) == len(keys) and all(
        _check(keys[a:a + k]) == c for a, k, c in zip(cuts, n, by.column("check").to_numpy()))
    if not same:
        raise RuntimeError("the table's partitions changed between two passes over it; write it once and score that table")
    part = lambda name: np.concatenate([unpack_ints(x.as_py(), int(k), "<u8") for x, k in zip(by.column(name), n)])
    train, deleted = part("train").astype(np.float64), part("deleted").astype(np.float64)
    split = np.split(where, order)
    return [train[w] for w in split], [deleted[w] for w in split], at


def _contexts(counts: list[np.ndarray], at: np.ndarray, docs: float) -> list[np.ndarray]:
    """For each order from 2 on, how often the n-gram's context was seen: the count of the shorter n-gram that
    ends one token before, or of all documents at a text's start."""
    out = []
    for shorter in counts[:-1]:
        context = np.empty_like(shorter)
        context[1:] = shorter[:-1]
        context[at[:-1]] = docs
        out.append(context)
    return out


def _estimates(counts: list[np.ndarray], at: np.ndarray, tokens: float, types: float, docs: float):
    """(estimates by order from the uniform floor up, context bucket) of each token."""
    contexts = _contexts(counts, at, docs)
    share = lambda c, n: np.divide(c, n, out=np.zeros_like(c), where=n > 0)
    p = [np.full(len(counts[0]), 1.0 / (types + 1)), counts[0] / tokens if tokens else np.zeros(len(counts[0]))]
    p += [share(c, n) for c, n in zip(counts[1:], contexts)]
    seen = contexts[-1] if contexts else np.full(len(counts[0]), docs)
    bucket = np.where(seen > 0, np.floor(np.log2(np.maximum(seen, 1))).astype(np.int64) + 1, 0)
    return p, np.minimum(bucket, CONTEXT_BUCKETS - 1)


def learn_weights(events: list, order: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights per context bucket by expectation-maximisation on binned held-out events.

    An event row is (bucket, log2 of each order's estimate over the floor in 1/STEP octaves or -1 for zero, count).
    An order whose estimates are all zero in a bucket ends with weight 0 there, the floor never quite.
    """
    weights = np.full((CONTEXT_BUCKETS, order + 1), 1.0 / (order + 1))
    if not events:
        return weights
    table = np.array([[r["bucket"], *r["q"], r["n"]] for r in events], dtype=np.float64)
    bucket, n = table[:, 0].astype(int), table[:, -1]
    q = table[:, 1:-1]
    odds = np.concatenate([np.ones((len(q), 1)), np.where(q <= -999, 0.0, 2.0 ** (q / STEP))], axis=1)
    total = np.bincount(bucket, n, CONTEXT_BUCKETS)
    for _ in range(rounds):
        part = weights[bucket] * odds
        part *= (n / part.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, part[:, m], CONTEXT_BUCKETS) for m in range(order + 1)], axis=1)
        new[:, 0] += 0.5  # half an event for the floor keeps unseen words possible
        seen = total > 0
        weights[seen] = new[seen] / new[seen].sum(axis=1, keepdims=True)
    known = np.flatnonzero(total > 0)
    for b in range(CONTEXT_BUCKETS):  # a bucket without events takes the nearest one's weights
        if total[b] == 0:
            weights[b] = weights[known[np.argmin(np.abs(known - b))]]
    # no context seen: the highest order has no estimate
    weights[0, -1] = 0.0 if order > 1 else weights[0, -1]
    weights[0] /= weights[0].sum()
    return weights


def score_documents(docs: DataFrame, order: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams), score (log10 probabilities)."""
    if not 1 <= order <= 4:
        raise ValueError("orders 1 to 4")
    spark = docs.sparkSession
    buckets = 2 * shuffle_width(spark)
    blocks = _with_blocks(docs, key, text)
    counts = gather(blocks, order, buckets)
    s = counts.where("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
        "tokens", "types", "deleted_tokens", "docs", "deleted_docs")]).first()
    tokens, types, n_docs = s["tokens"], s["types"], s["docs"]
    kept_tokens, kept_docs = tokens - s["deleted_tokens"], n_docs - s["deleted_docs"]
    own = counts.where("block >= 0").select("block", "bucket", "n", "check", "train", "deleted")

    def events(texts: pa.Table, given: pa.Table) -> pa.Table:
        train, deleted, at = _token_counts(texts, given, order, buckets)
        kept = [a - b for a, b in zip(train, deleted)]
        p, bucket = _estimates(kept, at, float(kept_tokens), float(types), float(kept_docs))
        q = [np.where(x > 0, np.rint(STEP * np.log2(np.maximum(x, 1e-300) / p[0])), -999).astype(np.int64) for x in p[1:]]
        rows, n = np.unique(np.stack([bucket, *q], axis=1), axis=0, return_counts=True)
        return pa.table({"bucket": rows[:, 0], "q": pa.array(rows[:, 1:].tolist(), pa.list_(pa.int64())), "n": n})

    deleted_texts = blocks.where(F.col("fold") == DELETED).select("block", "t")
    seen = deleted_texts.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(
        lambda a, b: events(a, b) if a.num_rows else pa.table({
            "bucket": pa.array([], pa.int64()), "q": pa.array([], pa.list_(pa.int64())), "n": pa.array([], pa.int64())}),
        "bucket long, q array<long>, n long")
    # a bounded grid: buckets x eighth-octaves of the estimates
    weights = learn_weights(seen.groupBy("bucket", "q").agg(F.sum("n").alias("n")).collect(), order)

    def score(texts: pa.Table, given: pa.Table) -> pa.Table:
        if texts.num_rows:
            train, _, at = _token_counts(texts, given, order, buckets)
            p, bucket = _estimates(train, at, float(tokens), float(types), float(n_docs))
            mixed = sum(weights[bucket, m] * x for m, x in enumerate(p))
            base = np.log10((train[0] + 0.1) / (tokens + 0.1 * (types + 1)))
            add = lambda x: np.add.reduceat(x, at[:-1])
            out = [np.diff(at), add((train[0] > 0).astype(np.int64)), add(base), add(np.log10(mixed))]
        else:
            out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)]
        held = np.asarray(texts.column("fold").to_numpy()) == HELD_OUT
        return pa.table({"k": texts.column("k"), "held_out": held, "n_tokens": out[0], "n_known": out[1],
                         "train_tokens": np.full(len(held), tokens, np.int64), "base_score": out[2], "score": out[3]})

    kind = docs.schema[key].dataType.simpleString()
    scored = blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(
        score, f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("k", key)
