"""Conversation structure repair: cheapest edits that make the roles ``(s?(ua)+)?``, by rank-convergence parallel Viterbi.

A conversation's rows, in order, are a path through four states (start, after system, after user, after assistant). With
``cost[q]`` the least cost of repairing the rest from state ``q``, a row is a min-plus map from the costs behind it to the
costs before it. A conversation of any length is cut into chunks of ``CHUNK`` rows, which run at the same time:

* every chunk but a conversation's last starts its backward pass from a speculative cost vector;
* fix-up passes hand each chunk the vector its successor arrived at; a chunk reruns from its end only until its vector
  differs from the stored one by a constant (vectors are stored less their least entry, so then they are equal): all
  vectors before it are right as they are. Such maps lose rank fast, so a pass or two settle nearly every chunk; the
  passes go on until no chunk's end vector changes, so the result is exact at any length;
* the stitched backward costs then drive the trace: at each row the first letter of D, I, K, R that keeps the remaining cost
  least, which gives the ASCII-least of the cheapest audits, as every letter leads to one state only. Chunks trace from
  a speculative entry state and rerun while the state their predecessor leaves differs from it.

Rows get their order once, by a range sort whose partitions are cut anywhere, also within a conversation; a chunk lies in
one partition. Texts move twice: into that order, and to the running digest of each conversation, which reads its rows
as a sorted stream (SHA-256 can only be computed in order; memory is one row and the audit).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmart.llm.common import SPACES, stored

CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

# a row's code: its role's place in "?sua", + 4 if it must go, + 8 if it is truncated; written as chr(65 + code)
START, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = (USER, USER, ASSISTANT, USER)  # the state that an inserted or changed role leads to, by state
END = (0, 2 * INSERT, INSERT, 0)          # cost of the rest behind the last row: "", "II", "I", ""
SPECULATIVE = (0, 0, 0, 0)
ENTRY = ASSISTANT                         # speculative entry state of a chunk
ALLOWED = ((), (START,), (START, SYSTEM, ASSISTANT), (USER,))  # states in which a role may be kept


def _less_min(v) -> tuple:
    low = min(v)
    return tuple(x - low for x in v)


class Steps:
    """The min-plus maps of rows: known[(code, vector behind)] is (vector before, moves by state); a move is (letters, next state)."""

    def __init__(self):
        self.known: dict = {}

    def __call__(self, code: int, behind: tuple):
        got = self.known.get((code, behind))
        if got is None:
            got = self.known[code, behind] = self._step(code, behind)
        return got

    @staticmethod
    def _step(code: int, behind: tuple):
        role, must_go, cut = code & 3, code & 4, TRUNCATED if code & 8 else 0
        once = []
        for q in range(4):
            moves = {"D": (DELETE + behind[q], q)}
            if not must_go:
                if q in ALLOWED[role]:
                    moves["K"] = (cut + behind[role], role)
                moves["R"] = (REROLE + cut + behind[INSERTED[q]], INSERTED[q])
            once.append(moves)
        least = [min(c for c, _ in m.values()) for m in once]
        for _ in range(3):  # inserted turns before the row
            least = [min(least[q], INSERT + least[INSERTED[q]]) for q in range(4)]
        moves = []
        for q in range(4):
            letters, at = "", q
            while True:
                options = {x: c for x, (c, _) in once[at].items()} | {"I": INSERT + least[INSERTED[at]]}
                letter = min(x for x, c in options.items() if c == least[at])
                letters += letter
                if letter == "I":
                    at = INSERTED[at]
                    continue
                moves.append((letters, once[at][letter][1]))
                break
        return _less_min(least), tuple(moves)


def backward(codes: str, end: tuple, steps: Steps, before: bytes | None = None) -> bytes:
    """Cost vectors behind each row and before the first, four bytes each, from ``end``. With ``before`` (an earlier run's
    vectors) the run stops as soon as a vector equals the stored one."""
    n = len(codes)
    out = bytearray(before) if before is not None else bytearray(4 * (n + 1))
    v = _less_min(end)
    out[4 * n:] = bytes(v)
    for i in range(n - 1, -1, -1):
        v, _ = steps(ord(codes[i]) - 65, v)
        new = bytes(v)
        if before is not None and before[4 * i:4 * i + 4] == new:
            break
        out[4 * i:4 * i + 4] = new
    return bytes(out)


def trace(codes: str, costs: bytes, state: int, steps: Steps) -> tuple[str, int]:
    """Audit letters of a chunk entered in ``state``, and the state it leaves."""
    letters = []
    for i, c in enumerate(codes):
        _, moves = steps(ord(c) - 65, tuple(costs[4 * i + 4:4 * i + 8]))
        more, state = moves[state]
        letters.append(more)
    return "".join(letters), state


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _chunk_map(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the columns of each batch, as lists by name; the key keeps its type."""
    fields = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for b in batches:
            out = work({c: b.column(c).to_pylist() for c in b.schema.names}, steps)
            kinds = [b.schema.field("conv_id").type if c == "conv_id" else _TYPES[t] for c, t in fields]
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for (c, _), t in zip(fields, kinds)], names=[c for c, _ in fields])

    return rows.mapInArrow(run, schema)


def _settle(chunks: DataFrame, work, schema: str, given: str, made: str, neighbour, name: str) -> DataFrame:
    """Fix-up passes: while some chunk's ``given`` differs from its neighbour's ``made``, those chunks run anew."""
    while True:
        due = F.coalesce(neighbour(made), F.col(given))
        chunks = stored(chunks.withColumn("due", due).withColumn("redo", F.col("due") != F.col(given)), f"{name}-due")
        if chunks.filter("redo").isEmpty():
            return chunks.drop("due", "redo")
        redone = _chunk_map(chunks.filter("redo").withColumn(given, F.col("due")).drop("due", "redo"), work, schema)
        chunks = stored(chunks.filter("not redo").drop("due", "redo").unionByName(redone), name)


def edits(codes: DataFrame) -> DataFrame:
    """(conv_id, chunk, codes, audit) from rows (conv_id, pos, code): the cheapest audit, chunk by chunk.

    ``pos`` orders a conversation's rows; ``pos >> CHUNK_BITS`` is the chunk. A chunk's audit holds, per row, the inserted
    turns before it and its own letter; the last chunk's also the turns inserted behind the last row.
    """
    kind = codes.schema["conv_id"].dataType.simpleString()
    rows = codes.groupBy("conv_id", F.shiftright("pos", CHUNK_BITS).alias("chunk")).agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])).alias("codes"))
    by = Window.partitionBy("conv_id").orderBy("chunk")
    rows = rows.withColumn("last", F.lead("chunk").over(by).isNull()).withColumn("first", F.lag("chunk").over(by).isNull())
    rows = rows.withColumn("given", F.when(F.col("last"), F.lit(bytearray(_less_min(END)))).otherwise(F.lit(bytearray(SPECULATIVE))))
    schema = f"conv_id {kind}, chunk long, codes string, last boolean, first boolean, given binary, costs binary, before binary"

    def cost(cols: dict, steps: Steps) -> dict:
        had = cols.get("costs") or [None] * len(cols["codes"])
        costs = [backward(c, tuple(g), steps, h) for c, g, h in zip(cols["codes"], cols["given"], had)]
        return cols | {"costs": costs, "before": [x[:4] for x in costs]}

    chunks = stored(_chunk_map(rows, cost, schema), "repair-costs")
    chunks = _settle(chunks, cost, schema, "given", "before", lambda c: F.lead(c).over(by), "repair-costs")

    schema = f"conv_id {kind}, chunk long, codes string, last boolean, costs binary, entry int, audit string, left int"

    def follow(cols: dict, steps: Steps) -> dict:
        done = [trace(c, x, q, steps) for c, x, q in zip(cols["codes"], cols["costs"], cols["entry"])]
        audit = [a + "I" * (END[q] // INSERT) * bool(last) for (a, q), last in zip(done, cols["last"])]
        return cols | {"audit": audit, "left": [q for _, q in done]}

    entry = F.when(F.col("first"), F.lit(START)).otherwise(F.lit(ENTRY)).alias("entry")
    traced = stored(_chunk_map(chunks.select("conv_id", "chunk", "codes", "last", "costs", entry), follow, schema), "repair-traces")
    traced = _settle(traced, follow, schema, "entry", "left", lambda c: F.lag(c).over(by), "repair-traces")
    return traced.select("conv_id", "chunk", "codes", "audit")


class _Conversation:
    """Running counts and digest of one conversation's repaired rows."""

    NAMES = ("", "system", "user", "assistant")

    def __init__(self, key):
        self.key, self.state, self.rows, self.audit, self.at = key, START, 0, [], 0
        self.letters = self.codes = ""
        self.row = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.before, self.sha = None, hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.rows else "") + role + ":" + text).encode())
        self.rows += 1

    def _insert(self) -> None:
        self.cost += INSERT
        self.state = INSERTED[self.state]
        self._write(self.NAMES[self.state], "")

    def chunk(self, codes: str, audit: str) -> None:
        self.close()
        self.codes, self.letters, self.at, self.row = codes, audit, 0, 0
        self.audit.append(audit)

    def turn(self, role: str, text: str, fault: int) -> None:
        pair = (self.before or "") + role[:1]
        self.illegal += self.before is not None and pair not in ("su", "ua", "au")
        self.before = role[:1]
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        code = ord(self.codes[self.row]) - 65
        self.row += 1
        while self.letters[self.at] == "I":
            self._insert()
            self.at += 1
        letter = self.letters[self.at]
        self.at += 1
        if letter == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED * bool(code & 8)
        if letter == "K":
            self.state = code & 3
        else:
            self.cost += REROLE
            self.state = INSERTED[self.state]
            role = self.NAMES[self.state]
        self._write(role, text)

    def close(self) -> None:
        while self.at < len(self.letters):  # turns inserted behind the last row
            self._insert()
            self.at += 1

    def result(self) -> tuple:
        self.close()
        return (self.key, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


RESULT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _read_repaired(turns: DataFrame, audits: DataFrame, kind: str) -> DataFrame:
    """Counts, cost, audit and digest per conversation, from its turns and chunk audits as one sorted stream."""
    rows = turns.select("conv_id", "chunk", "pos", "role", "text", "fault", F.lit("").alias("codes"), F.lit("").alias("audit")).unionByName(
        audits.select("conv_id", "chunk", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"),
                      F.lit(0).alias("fault"), "codes", "audit"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "pos")
    names = ["conv_id"] + [x.split()[0] for x in RESULT.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done, key = None, [], pa.null()

        def batch():
            cols = list(zip(*done))
            done.clear()
            types = [key] + [pa.int64()] * 5 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for b in batches:
            key = b.schema.field("conv_id").type
            for k, pos, role, text, fault, codes, audit in zip(*(b.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text", "fault", "codes", "audit"))):
                if at is None or k != at.key:
                    if at is not None:
                        done.append(at.result())
                    at = _Conversation(k)
                    if len(done) >= 5000:
                        yield batch()
                if pos < 0:
                    at.chunk(codes, audit)
                else:
                    at.turn(role, text, fault)
        if at is not None:
            done.append(at.result())
        if done:
            yield batch()

    return rows.mapInArrow(work, f"conv_id {kind}, {RESULT}")


def damage(turns: DataFrame) -> DataFrame:
    """The rows with faults planted by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 removes its ``.!?``,
    3 repeats it, 4 makes its role user. Null columns count as one space; the turn stays null."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20).alias("fate")
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), fate).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fate")
    return rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))).drop("fate", "again")


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation in
    (conv_id, turn, role, text) rows, and of those in ``ids``: one without rows has zeros, an empty audit and the digest of
    nothing.

    Rows go by turn (nulls first), then role, then text; rows equal in all of these can't be told apart. Null role or text
    is one space; a null conv_id is a conversation like any other. A row's first fault counts: blank (no character but
    space, \\t, \\n, \\v, \\f, \\r), duplicate (role and text seen earlier), truncated (its last such character isn't one of ``.!?``). Roles
    other than those beginning with s, u or a are never kept as they are. Other columns don't matter; no rows give no rows.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", plain("role"), plain("text"))
    same = F.monotonically_increasing_id()  # equal rows are dealt apart, so that their number is no one partition's
    order = ("conv_id", "turn", "role", "text", "same")
    ordered = rows.withColumn("same", same).repartitionByRange(*order).sortWithinPartitions(*order)
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00")), F.length("role").cast("string"), "role", "text"))
    ordered = stored(ordered.drop("same").withColumn("pos", F.monotonically_increasing_id()).withColumn("same_as", key), "repair-rows")
    gaps = ordered.groupBy("conv_id").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("n"))
    gaps = gaps.select("conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))

    # the first of rows that occur more than once
    seen = ordered.groupBy("same_as").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    light = ordered.select("conv_id", "pos", "same_as", F.substring("role", 1, 1).alias("initial"),
                           F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1).alias("tail"))
    fault = (F.when(F.col("tail") == "", 1).when(F.col("pos") > F.col("first"), 2)
              .when(~F.col("tail").isin(".", "!", "?"), 3).otherwise(0))
    role = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(F.col("initial") == "a", ASSISTANT).otherwise(0)
    code = role + F.when(F.col("fault").isin(1, 2), 4).when(F.col("fault") == 3, 8).otherwise(0)
    marked = light.join(seen, "same_as", "left").select("conv_id", "pos", "initial", fault.alias("fault"))
    marked = stored(marked.select("conv_id", "pos", "fault", F.char(F.lit(65) + code).alias("code")), "repair-codes")
    audits = edits(marked.select("conv_id", "pos", "code"))
    faults = marked.filter("fault > 0").select("pos", "fault")
    texts = ordered.join(faults, "pos", "left").select("conv_id", F.shiftright("pos", CHUNK_BITS).alias("chunk"), "pos", "role", "text",
                                                       F.coalesce("fault", F.lit(0)).alias("fault"))
    read = _read_repaired(texts, audits, kind)
    every = (turns if ids is None else ids).select("conv_id").distinct().alias("o")
    out = every.join(gaps.alias("g"), F.expr("o.conv_id <=> g.conv_id"), "left").join(read.alias("r"), F.expr("o.conv_id <=> r.conv_id"), "left")
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    names = ["gaps"] + [x.split()[0] for x in RESULT.split(", ")]
    return out.select("o.conv_id", *[F.coalesce(c, F.lit(none.get(c, 0)).cast("string" if c in none else "long")).alias(c) for c in names])
