"""Conversation repair against a plain search over all edits, on odd rows and over chunk borders."""

import hashlib
import random
import zlib

import pytest

from rankmart.llm import conversation_repair as repair
from rankmart.llm.registry import prepare

WHITE = " \t\n\x0b\x0c\r"
NAMES = {"s": "system", "u": "user", "a": "assistant"}


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of (turn, role, text) rows."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", [])}

    def insert(best):
        for _ in range(3):
            for at, (cost, audit, out) in list(best.items()):
                role = "a" if at == "u" else "u"
                new = (cost + 2, audit + "I", out + [NAMES[role] + ":"])
                if role not in best or new[:2] < best[role][:2]:
                    best[role] = new
        return best

    for (_, role, text), fault in zip(rows, faults):
        best, new = insert(best), {}
        for at, (cost, audit, out) in best.items():
            moves = [(at, 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if role[:1] and role[:1] in follow[at]:
                    moves.append((role[:1], cut, "K", [role + ":" + text]))
                turn = "a" if at == "u" else "u"
                moves.append((turn, 2 + cut, "R", [NAMES[turn] + ":" + text]))
            for state, more, letter, added in moves:
                option = (cost + more, audit + letter, out + added)
                if state not in new or option[:2] < new[state][:2]:
                    new[state] = option
        best = new
    cost, audit, out = min(x for at, x in insert(best).items() if at in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = zip(rows, rows[1:])
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def collected(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, chunk long, pos long, fault int"


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def random_rows(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["One.", "Two!", "no end", "", " \n", None, "Three?  ", "é…"]
    rows = []
    for i in range(n):
        turn = None if rng.random() < 0.05 else i + rng.choice([0, 0, 0, 1, 4])
        good = rng.random() < 0.6
        rows.append((conv, turn, ("user", "assistant")[i % 2] if good else rng.choice(roles), f"text {i}." if good else rng.choice(texts)))
    return rows


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = [r for conv in [None, *range(120)] for r in random_rows(rng, conv, rng.randint(1, 14))]
    got = collected(repair.repair(frame(spark, rows)))
    want = {c: brute([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


@pytest.mark.parametrize("bits", [0, 2])
def test_chunk_borders_change_nothing(spark, monkeypatch, bits):
    """Chunks of one and of four rows: many fix-up passes, the same audits."""
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    rng = random.Random(bits)
    rows = [r for conv in range(6) for r in random_rows(rng, conv, 25)]
    rows += [(6, i, ("user", "assistant")[i % 2], f"all is well {i}.") for i in range(30)]
    rows += [(7, i, "tool", f"never kept {i}.") for i in range(9)]
    got = collected(repair.repair(frame(spark, rows)))
    assert got == {c: brute([r[1:] for r in rows if r[0] == c]) for c in range(8)}


def test_speculative_and_true_vectors_meet():
    rng = random.Random(1)
    codes = "".join(chr(65 + rng.choice([2, 3, 1, 6, 10, 11])) for _ in range(500))
    steps = repair.Steps()
    whole = repair.backward(codes, repair.END, steps)
    first = repair.backward(codes[:250], repair.SPECULATIVE, steps)
    fixed = repair.backward(codes[:250], tuple(whole[1000:1004]), steps, first)
    assert fixed == whole[:1004]
    assert sum(first[4 * i:4 * i + 4] != fixed[4 * i:4 * i + 4] for i in range(251)) < 20  # rank converges after a few rows


def test_repeated_rows_nulls_and_long_texts(spark):
    long = "word " * 200_000 + "." + " " * 100_000
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", None), (2, None, None, None), (2, None, "user", "a."),
            (3, 5, "assistant", "x"), (None, None, "user", "b."), (None, 2, "assistant", "c.")]
    got = collected(repair.repair(frame(spark, rows)))
    assert got == {c: brute([r[1:] for r in rows if r[0] == c]) for c in (1, 2, 3, None)}


def test_empty_table_and_conversations_without_rows(spark):
    none = frame(spark, [])
    assert repair.repair(none).count() == 0
    ids = frame(spark, [(7, 0, "user", "a."), (None, 1, "user", "b.")])
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert collected(repair.repair(none, ids)) == {7: empty, None: empty}


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(40) for t in (0, 1, None)] + [(None, 3, None, None)]
    got = sorted(map(str, (tuple(r) for r in repair.damage(frame(spark, rows)).collect())))
    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if fate == 4 else role, "" if fate == 1 else text.translate({ord(x): None for x in ".!?"}) if fate == 2 else text)
        want += [row] * {0: 0, 3: 2}.get(fate, 1)
    assert got == sorted(map(str, want))


def test_query_against_the_plain_search(spark):
    """All conversations of the smallest tables."""
    from rankmart.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = repair.damage(turns).collect()
    ids = [r[0] for r in turns.select("conv_id").distinct().collect()]
    want = {c: brute([tuple(r)[1:] for r in rows if r["conv_id"] == c]) for c in ids if any(r["conv_id"] == c for r in rows)}
    got = collected(QUERIES["op12_conversation_repair"](spark, sf))
    assert set(got) == set(ids) and {c: got[c] for c in want} == want
