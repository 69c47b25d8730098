"""Shared helpers: tables in the shared folder, byte-level word scanning, cached subword ids."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmart.session import checkpoint_dir
from rankmart.sources.files import Store

# words are runs of anything but ASCII space and \t \n \v \f \r
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for ``name`` under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_OPEN: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables that ``stored`` writes in this block are removed at its end, other than those stored with ``keep``.

    What the block returns must be kept, or read nothing but kept tables. After an error nothing is removed."""
    _OPEN.append([])
    try:
        yield
    except BaseException:
        _OPEN.pop()
        raise
    for path in _OPEN.pop():
        Store(spark, path).delete(path)


def stored(df: DataFrame, name: str, path: str | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is cut there,
    so a lost executor costs only the files' next reader a retry. In a ``temporary`` block the table goes with the
    block, unless ``keep`` hands it to the block around (or to the caller)."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    at = len(_OPEN) - 1 - keep
    if at >= 0:
        _OPEN[at].append(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, *taken) -> str:
    """``name``, with underscores in front until no column in the lists of names has it (names match without case)."""
    used = {c.lower() for cols in taken for c in cols}
    while name.lower() in used:
        name = "_" + name
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(col: str = "text"):
    """The text column with null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


# ---------------------------------------------------------------- byte-level words, vectorised
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix): spreads every input bit over the output."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_KEY = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _inverse(a: int) -> int:
    x = a
    for _ in range(6):  # Newton on 2-adic numbers
        x = x * (2 - a * x) & 0xFFFFFFFFFFFFFFFF
    return x


_INV = np.uint64(_inverse(int(_BASE)))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        step = base
        while done < n:  # doubling: out[k : 2k] = out[:k] * base**k
            k = min(done, n - done)
            out[done:done + k] = out[:k] * step
            step = step * step
            done += k
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches, column: str, most: int = 6 << 20):
    """Batches of about ``most`` bytes of text, a row being the least, so that arrays made per byte or word stay bounded."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy()
        lo, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > lo and held + n > most:
                yield b.slice(lo, i - lo)
                lo, held = i, 0
            held += n
        if lo < len(sizes):
            yield b.slice(lo)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of every word of the rows' texts, in order."""
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a word never runs over a row's end
    starts = word & (edge[:-1] | np.concatenate(([True], ~word[:-1])))
    ends = word & (edge[1:] | np.concatenate((~word[1:], [True])))
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span (A-Z folded): a polynomial over keyed bytes, from prefix sums."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    key = _BYTE_KEY[_LOWER] if lower else _BYTE_KEY
    out = np.empty(len(starts), dtype=np.uint64)
    step, lo = 1 << 20, 0
    with np.errstate(over="ignore"):
        while lo < len(starts):  # windows of about a megabyte stay in cache
            base = starts[lo]
            hi = max(lo + 1, int(np.searchsorted(starts, base + step)))
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            n = int(e[-1])
            pre = np.empty(n + 1, dtype=np.uint64)
            pre[0] = 0
            np.cumsum(key[data[base:base + n]] * _power_table(n), out=pre[1:])
            out[lo:hi] = (pre[e] - pre[s]) * _power_table(n + 1, True)[s]
            lo = hi
        return mix(out + (ends - starts).astype(np.uint64) * _GOLD)


def span_sums(h: np.ndarray):
    """A function of (starts, ends): 64-bit hash of each span of ``h``, in order, a polynomial over them from prefix sums."""
    pre = np.zeros(len(h) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(h) * _power_table(len(h)), out=pre[1:])

    def sums(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = (pre[ends] - pre[starts]) * _power_table(len(h) + 1, True)[starts]
            return mix(total + (ends - starts).astype(np.uint64) * _GOLD)

    return sums


_TABLES: dict[bool, np.ndarray] = {}


def _power_table(n: int, inverse: bool = False) -> np.ndarray:
    have = _TABLES.get(inverse)
    if have is None or len(have) < n:
        have = _TABLES[inverse] = _powers(_INV if inverse else _BASE, max(n, 1 << 20))
    return have[:n]


# ---------------------------------------------------------------- compact integer payloads
def pack_ints(values: np.ndarray) -> bytes:
    """Integers of one width, byte planes apart, zstd-compressed."""
    raw = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpack_ints(payload: bytes, n: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = pa.decompress(payload, decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(dtype).reshape(n)


# ---------------------------------------------------------------- subword ids, cached per worker
class ChunkCache:
    """Ids of whole texts, put together from ids of the texts' chunks.

    ``encode`` maps a list of chunks to one id list each, and must have the property that a text's ids are
    the chunks' ids in order (true where the tokenizer's own pre-splitting always breaks at the chunk
    borders). Chunks seen before come from a dictionary, which is emptied at ``limit`` entries, so that
    memory stays bounded.
    """

    def __init__(self, encode, limit: int = 600_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def fill(self, chunks) -> None:
        missing = {c for c in chunks if c not in self.known}
        if missing:
            if len(self.known) + len(missing) > self.limit:
                self.known.clear()
                missing = set(chunks)
            missing = list(missing)
            self.known.update(zip(missing, self.encode(missing)))
