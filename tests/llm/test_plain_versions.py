"""Whole operators against plain Python versions on small tables: scores, surrogates, divergence, odd rows in every stage."""

import collections
import hashlib
import math
import re
import zlib

import pytest
import regex

import corpus_pipeline
from rankmart.llm import chosen_path, decontam, divergence, huffman, lm_scoring, packing, pii, quality, token_cache
from rankmart.llm.common import free_name, shared_path, stored, temporary
from rankmart.sources.files import Store

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# ------------------------------------------------------------------------------------------ 1
def plain_scores(docs, order):
    """(key, score) by deleted interpolation, with counts of word tuples and a loop of expectation-maximisation."""
    texts = [(k, zlib.crc32(("" if k is None else str(k)).encode()) % 10, WORD.findall(low(t)) + ["\nend"]) for k, t in docs]

    def grams(tokens):
        padded = ["\nstart"] * (order - 1) + tokens
        return [[tuple(padded[i + order - m:i + order]) for m in range(1, order + 1)] for i in range(len(tokens))]

    full, kept = collections.Counter(), collections.Counter()
    n_full = n_kept = docs_full = docs_kept = 0
    for _, fold, tokens in texts:
        if fold == 0:
            continue
        all_grams = [g for gs in grams(tokens) for g in gs]
        full.update(all_grams)
        n_full, docs_full = n_full + len(tokens), docs_full + 1
        if fold != 9:
            kept.update(all_grams)
            n_kept, docs_kept = n_kept + len(tokens), docs_kept + 1
    types = sum(len(g) == 1 for g in full)

    def estimates(tokens, counts, n, n_docs):
        out, before = [], None
        for gs in grams(tokens):
            seen = [n_docs] * (order - 1) if before is None else [counts[g] for g in before[:-1]]
            p = [1 / (types + 1), counts[gs[0]] / n if n else 0.0] + [counts[g] / c if c else 0.0 for g, c in zip(gs[1:], seen)]
            last = seen[-1] if seen else n_docs
            out.append((p, min(47, int(math.log2(last)) + 1 if last else 0)))
            before = gs
        return out

    events = collections.Counter()
    for _, fold, tokens in texts:
        if fold == 9:
            for p, b in estimates(tokens, kept, n_kept, docs_kept):
                events[b, tuple(round(8 * math.log2(x / p[0])) if x > 0 else None for x in p[1:])] += 1
    weights = {b: [1 / (order + 1)] * (order + 1) for b in range(48)}
    known = sorted({b for b, _ in events})
    for b in known:
        mine = [([1.0] + [0.0 if x is None else 2 ** (x / 8) for x in q], n) for (c, q), n in events.items() if c == b]
        w = weights[b]
        for _ in range(60):
            new = [0.5] + [0.0] * order
            for odds, n in mine:
                part = [x * y for x, y in zip(w, odds)]
                total = sum(part)
                new = [a + n * x / total for a, x in zip(new, part)]
            w = [x / sum(new) for x in new]
        weights[b] = w
    if known:
        for b in set(range(48)) - set(known):
            weights[b] = list(weights[min(known, key=lambda k: (abs(k - b), k))])
    if order > 1 and known:
        weights[0][-1] = 0.0
    weights[0] = [x / sum(weights[0]) for x in weights[0]]
    return [(k, sum(math.log10(sum(w * x for w, x in zip(weights[b], p))) for p, b in estimates(tokens, full, n_full, docs_full))) for k, _, tokens in texts]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_the_plain_model_s(spark, make_docs, order):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(70).collect()]
    rows += [(None, "a b a"), (1000, None), (1000, "a b"), (1001, "a b a b c")]
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_scoring.score_documents(make_docs(rows), order=order).collect())
    want = sorted((str(k), len(WORD.findall(t or "")) + 1, s) for (k, s), (_, t) in zip(plain_scores([(k, t or "") for k, t in rows], order), rows))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(math.isclose(g[2], w[2], rel_tol=1e-6) for g, w in zip(got, want))


# ------------------------------------------------------------------------------------------ 10
def core_of(kind, entity):
    """What makes two mentions of a type the same, from the mention alone."""
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", entity)
    if kind == "iban":
        return re.sub("[^A-Z0-9]", "", entity)
    if kind == "secret":
        return re.sub(pii._SECRET_HEAD, "", entity)
    return entity.lower() if kind in ("email", "ip6") else entity


def test_surrogates_of_whole_documents(spark):
    """Entities are found by the pattern in Python; around them nothing changes, and core to surrogate is one to one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    find = regex.compile(pii.PATTERN)
    to, back, real = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    old = {r["doc_id"]: r["text"] for r in docs.collect()}
    n = 0
    for r in pii.replace_entities(docs, "some key").collect():
        text, spans = old[r["doc_id"]], r["pii"]["spans"] or []
        found = list(find.finditer(text))
        assert len(found) == len(spans) == r["pii"]["n_entities"], (text, spans)
        at = new_at = 0
        for m, s in zip(found, spans):
            new = r["text"][s["start"]:s["start"] + s["length"]]
            assert text[at:m.start()] == r["text"][new_at:s["start"]]  # what stands between
            at, new_at = m.end(), s["start"] + s["length"]
            n += 1
            if s["type"] != "name":
                a, z = core_of(s["type"], m.group()), core_of(s["type"], new)
                to[s["type"], a].add(z)
                back[s["type"], z].add(a)
                real[s["type"]].add(a)
        assert text[at:] == r["text"][new_at:]
    assert n > 20 and all(len(x) == 1 for x in to.values()) and all(len(x) == 1 for x in back.values())
    assert not [1 for (kind, a), z in to.items() if z & real[kind]]


def test_exceptions_as_maps_and_by_join_give_the_same(spark, make_docs, monkeypatch):
    docs = make_docs([(i, f"call +1 ({200 + i % 700}) 555-{(i * 37) % 10000:04d} now") for i in range(4000)] + [(None, "call +1 (200) 555-0000"), (None, None)])
    maps = sorted((str(r["doc_id"]), r["text"] or "") for r in pii.replace_entities(docs, "k").collect())
    monkeypatch.setattr(pii, "BROADCAST_EXCEPTIONS", -1)
    joined = sorted((str(r["doc_id"]), r["text"] or "") for r in pii.replace_entities(docs, "k").collect())
    assert maps == joined


# ------------------------------------------------------------------------------------------ 13
def plain_audit(rows, keep):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", [low(w) for w in term.findall(text or "")]) for lang, source, text in rows]
    df, counts, groups = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        df.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
        counts[lang, None].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [w for (x, w), n in df.items() if x == lang and n >= keep]
        price = {}
        for s in [*sources, None]:
            total = sum(counts[lang, s][w] for w in kept)
            price[s] = {w: 1 + 10**9 * (counts[lang, s][w] + 5) // (total + 5 * len(kept)) for w in kept}
        for s in sources:
            pairs = [(sum(abs(price[s][w] - price[o][w]) for w in kept), o) for o in sources - {s}]
            terms = [(price[s][w] - price[None][w], w) for w in kept if counts[lang, s][w] and price[s][w] > price[None][w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 50)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_divergence_is_the_plain_audit(spark, monkeypatch, block):
    """Also with blocks of three terms, so that a pair's sum comes from many."""
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    words = "The the THE and of été Ärger über naïve zeta_omega don't x1y2 日本語 aa-bb".split()
    rows = [(("en", "fr", None)[i % 3], (None, "s1", "s2", "s\U0001f600")[i % 4], " ".join(words[(i * j) % len(words)] for j in range(i % 17))) for i in range(160)]
    rows += [("de", "only", "ein Wort"), ("xx", "a", None), ("xx", "b", ""), ("en", "s1", "the " * 30_000), ("en", "s1", "the " * 30_000)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "lang string, source string, text string, term string, n long, total long")
    got = sorted(tuple(r) for r in divergence.audit(df, keep=6).collect())
    assert got == plain_audit(rows, 6) and any(r[2] == "term" for r in got)
    assert divergence.audit(df.limit(0)).count() == 0


def test_prices_are_exact():
    import numpy as np
    counts = np.array([0, 1, 7, 10**12, 4 * 10**14 + 3])
    total, terms = 9 * 10**14, 12345
    assert divergence.price(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in counts]
    with pytest.raises(OverflowError):
        divergence.price(counts, 1 << 54, 1)


# ------------------------------------------------------------------------------------------ clashes, empty tables, the pipeline
CLASH = ("doc_h", "doc_key", "_h", "_k", "_row_h", "pii", "PII", "chosen", "part")


def clashing(df):
    for c in CLASH:
        if c.lower() not in [x.lower() for x in df.columns]:
            df = df.withColumn(c, df["doc_id"].cast("string"))
    return df


def test_stages_keep_clashing_columns(spark, odd_docs):
    docs = clashing(odd_docs)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    for out in (quality.keep_documents(docs), chosen_path.keep_one_per_class(docs), decontam.keep_clean(docs, bench)):
        assert out.columns == docs.columns
        assert all(r["pii"] == (None if r["doc_id"] is None else str(r["doc_id"])) for r in out.collect())
    out = pii.replace_entities(docs, "k")
    assert out.columns == [*docs.columns, "_pii"] and all(r["_pii"]["n_entities"] >= 0 for r in out.collect())


def test_empty_tables(spark, make_docs):
    import public_tokenizers
    none = make_docs([])
    word, byte, piece = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
    assert lm_scoring.score_documents(none).count() == 0 and packing.pack_digests(none, word, end_id=1).count() == 0
    assert token_cache.count_tokens(none, piece, shared_path(spark, "none")).count() == 0 and quality.score_documents(none).count() == 0
    path = shared_path(spark, "none-ids")
    huffman.write_ids(none, path, byte, end_id=2)
    assert huffman.read_ids(spark, path).count() == 0


@pytest.fixture()
def odd_folder(spark, odd_docs, tmp_path):
    """Nulls, empty and long texts, repeated rows and a hostile benchmark, as tables."""
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, ""), (2, "never seen words of a benchmark item here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_on_odd_rows(spark, odd_folder):
    before = set(Store(spark, corpus_pipeline.shared_path(spark, "x")).names(corpus_pipeline.shared_path(spark, "x").rsplit("/", 1)[0]))
    got = corpus_pipeline.run(spark, odd_folder).collect()
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    kept = quality.keep_documents(docs)
    assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in kept.collect()} and all(0 < r["length"] <= 4096 for r in got)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, odd_folder)
        assert out.count() == 0
    left = set(Store(spark, shared_path(spark, "x")).names(shared_path(spark, "x").rsplit("/", 1)[0])) - before
    assert not [x for x in left if re.match("quality_rules|near_duplicates-|benchmark_decontamination|ties|buckets|paths|signatures|entities|surrogates", x)]


def test_temporary_tables_go_and_kept_ones_stay(spark):
    with temporary(spark):
        a = stored(spark.range(3), "gone")
        with temporary(spark):
            b = stored(a, "kept-by-the-outer-block", keep=True)
            stored(b, "gone-first")
        c = stored(b, "kept", keep=True)
        assert b.count() == 3
    assert c.count() == 3
    with pytest.raises(Exception):
        a.count()
    with pytest.raises(Exception):
        b.count()
    assert free_name("x", ["X", "_x"]) == "__x" and free_name("y", ["x"]) == "y"


def test_own_role_names_are_kept(spark):
    """Turns called human or gpt in the table are no assistant's, and read back under their own names."""
    from rankmart.llm import chat
    rows = [(c, t, role, f"text {t}") for c in range(8) for t, role in enumerate(["human", "gpt", "human", "bot"][: 2 + c % 3])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_records(chat.conversation_records(df))).collect()}
    for c in range(8):
        turns = [(r, x) for k, _, r, x in rows if k == c]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest() and got[c]["loss_chars"] == 0
    landed = spark.createDataFrame([(1, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}')], "conv_id long, record string")
    assert chat.read_back(chat.format_records(landed)).first()["loss_chars"] == 1  # a layout with its own names for them
