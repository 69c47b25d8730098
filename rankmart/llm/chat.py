"""Chat formatting from heterogeneous record layouts by schema fingerprint.

A record is a JSON object. Its fingerprint is the hash of its sorted nested field paths (array positions count as
``[]``), so records of one layout share it whatever their values. A registry maps fingerprints to declarative
mappings: where the turns are, which field names the role and which the text, or which fields make up the turns.
A mapping turns any known layout into canonical turns (role, text); unknown layouts are returned with their fingerprint
and no turns, to be given a mapping, never guessed.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts a backslash becomes two, and
``<|`` becomes ``<\\|``, so no control string can be forged and unescaping (backslash x -> x) restores every text; in
roles line ends are escaped as well. The loss mask marks the assistants' texts as (start, end) spans of the
formatted string.

Null role or text counts as empty; a conversation without turns is an empty string; equal turn numbers are ordered by role and
text. A conversation is one record, or, if it is long, several in order (``bucket``, ``part``), each with at most ``TURNS``
turns and, unless one turn alone has more, ``CHARS`` characters; its formatted string is theirs in a row. Buckets of turn
numbers are dealt out alone, so the records of one conversation are made by many tasks; only its running digests
need all of them in order, and read them as a stream.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS, CHARS = 256, 1 << 15  # of a record
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}  # of layouts that have their own names for them


def field_paths(value, path: str = "") -> set[str]:
    """Nested field paths of a parsed JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{path}.{k}")} or {path}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{path}[]")} or {f"{path}[]"}
    return {path}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


# declarative mappings: a list of turns with the names of its fields and the roles it calls otherwise, or (role, field) pairs in order
MAPPINGS = {
    "messages": {"list": "messages", "role": "role", "text": "content"},
    "sharegpt": {"list": "conversations", "role": "from", "text": "value", "roles": ROLES},
    "prompt": {"turns": [("user", "prompt"), ("assistant", "completion")]},
    "instruction": {"turns": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
}


def _paths_of(mapping: dict) -> set[str]:
    if "list" in mapping:
        return {f".{mapping['list']}[].{mapping[f]}" for f in ("role", "text")}
    return {f".{field}" for _, field in mapping["turns"]}


def registry(mappings: dict | None = None, extra_fields: tuple[str, ...] = ("id",)) -> dict[str, dict]:
    """Fingerprint -> mapping, for the layouts with and without the extra top-level fields."""
    out = {}
    for m in (mappings or MAPPINGS).values():
        variants = [_paths_of(m)] + ([{f".{m['list']}[]"}] if "list" in m else [])
        for paths in variants:
            for k in range(1 << len(extra_fields)):
                out[fingerprint(paths | {f".{x}" for i, x in enumerate(extra_fields) if k >> i & 1})] = m
    return out


def canonical_turns(record: dict, mapping: dict) -> list[tuple[str, str]]:
    """The record's (role, text) turns under the mapping."""
    if "list" in mapping:
        return [(mapping.get("roles", {}).get(r := t.get(mapping["role"]) or "", r), t.get(mapping["text"]) or "") for t in record[mapping["list"]]]
    return [(role, record.get(field) or "") for role, field in mapping["turns"]]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), text, flags=re.S)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_text(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted string and loss spans."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


_TURN = re.compile(re.escape(START) + r"((?:\\.|[^\\\n])*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string; anything but whole turns is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m.group(1)), _unescape_text(m.group(2))))
        at = m.end()
    return turns


def format_records(records: DataFrame, key: str = "conv_id", record: str = "record", mappings: dict | None = None) -> DataFrame:
    """key, fingerprint, known, n_turns, formatted, loss (array of start, end) from JSON records; bucket and part, if they have these."""
    known = registry(mappings)
    order = [c for c in ORDER if c in records.columns]
    kind = records.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text, *at in zip(pdf["k"], pdf["r"], *[pdf[c] for c in order]):
                value = json.loads(text) if text else {}
                mark = fingerprint(field_paths(value))
                mapping = known.get(mark)
                turns = canonical_turns(value, mapping) if mapping else []
                formatted, spans = render(turns)
                rows.append((k, mark, mapping is not None, len(turns), formatted, [{"start": a, "end": z} for a, z in spans], *at))
            yield pd.DataFrame(rows, columns=["k", "fingerprint", "known", "n_turns", "formatted", "loss", *order])

    rows = records.select(F.col(key).alias("k"), F.col(record).alias("r"), *order)
    out = rows.mapInPandas(work, f"k {kind}, fingerprint string, known boolean, n_turns long, formatted string, "
                                 "loss array<struct<start:long,end:long>>" + "".join(f", {c} long" for c in order))
    return out.withColumnRenamed("k", key)


ORDER = ("bucket", "part")


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from the formatted strings and spans alone. Rows with bucket
    and part are streamed in order, with a conversation's running digests as the only state."""
    field = formatted.schema[key]
    whole = not set(ORDER) <= set(formatted.columns)
    names = ["k", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state, schema = [], None, None

        def close():
            if state:
                k, turns, sha, chars, loss, size = state
                done.append((k, turns, sha.hexdigest(), chars, loss.hexdigest(), size))

        def batch():
            rows = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema)], names=names)

        for b in batches:
            schema = schema or [b.schema.field("k").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            spans = b.column("loss")
            for i, k in enumerate(b.column("k").to_pylist()):
                if state is None or whole or k != state[0]:
                    close()
                    state = [k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    if len(done) >= 5000:
                        yield batch()
                text = b.column("formatted")[i].as_py()
                turns = parse(text)
                state[1] += len(turns)
                state[2].update("".join([f"{role}\n{body}\n" for role, body in turns]).encode())
                for s in spans[i].as_py():
                    part = _unescape_text(text[s["start"]:s["end"]])
                    state[3] += len(part)
                    state[4].update(part.encode())
                state[5] += len(text)
        close()
        if done:
            yield batch()

    rows = formatted.select(F.col(key).alias("k"), "formatted", "loss", *([] if whole else ORDER))
    if not whole:
        rows = rows.repartition("k").sortWithinPartitions("k", *ORDER).drop(*ORDER)
    out = rows.mapInArrow(work, f"k {field.dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, "
                                "loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("k", key)


def _record(k, turns: list[tuple[str, str]], plain: bool) -> str:
    """The turns as JSON, in the layout their shape allows."""
    ident = {} if k is None else {"id": k}
    roles, texts = [r for r, _ in turns], [t for _, t in turns]
    if roles == ["user", "assistant"]:
        value = ident | {"prompt": texts[0], "completion": texts[1]}
    elif roles == ["system", "user", "assistant"]:
        value = {"instruction": texts[0], "input": texts[1], "output": texts[2]}
    elif plain or not ROLES.keys().isdisjoint(roles):  # the other layout would rename these roles
        value = {"messages": [{"role": r, "content": t} for r, t in turns]}
    else:
        value = ident | {"conversations": [{"from": r, "value": t} for r, t in turns]}
    return json.dumps(value, ensure_ascii=False, default=str)


def conversation_records(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, record, bucket, part): each conversation as one JSON record, or one per bounded part, in the layout its own shape
    allows: prompt and completion, instruction with input and output, or a list of messages (every other one in the
    from/value form)."""
    kind = turns.schema[key].dataType.simpleString()
    # a bucket's turns come after those of the bucket before; other than whole numbers are one bucket
    bucket = F.expr(f"turn div {TURNS}") if isinstance(turns.schema["turn"].dataType, T.IntegralType) else F.lit(0)
    rows = turns.select(F.col(key).alias("k"), bucket.cast("long").alias("bucket"), (F.pmod(F.xxhash64(key), F.lit(2)) == 0).alias("plain"),
                        "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", F.coalesce("bucket", F.lit(-(1 << 62))))  # turns without a number come first
    rows = rows.repartition("k", "bucket").sortWithinPartitions("k", "bucket", "turn", "role", "text").drop("turn")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, at, size, part, plain, kinds = [], [], None, 0, 0, False, None

        def close():
            if held:
                out.append((at[0], _record(at[0], held, plain), at[1], part))

        def batch():
            rows = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["k", "record", "bucket", "part"])

        for b in batches:
            kinds = kinds or [b.schema.field("k").type, pa.string(), pa.int64(), pa.int64()]
            for k, z, p, role, text in zip(*[b.column(c).to_pylist() for c in ("k", "bucket", "plain", "role", "text")]):
                if at != (k, z) or len(held) == TURNS or held and size + len(text) > CHARS:
                    close()
                    part = part + 1 if at == (k, z) else 0
                    at, plain, held, size = (k, z), p, [], 0
                    if len(out) >= 500:
                        yield batch()
                held.append((role, text))
                size += len(text)
        close()
        if out:
            yield batch()

    return rows.mapInArrow(work, f"k {kind}, record string, bucket long, part long").withColumnRenamed("k", key)
