"""What the operators hold, encode and join at once."""

import random
import re
import time

import public_tokenizers
import pyarrow as pa
import pytest

from rankmart.llm import chosen_path, decontam, tokenizing, warc
from rankmart.llm.registry import prepare


class Captured:
    """Stands for a table of texts; keeps the function that a task would run."""

    class schema:
        fields = []

    columns = ["t"]

    def mapInArrow(self, work, schema):
        self.work = work
        return self


# ------------------------------------------------------------------------------------------ pipeline
def test_texts_go_to_workers_by_size(spark):
    prepare(spark)

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    sizes = [r["n"] for r in spark.range(0, 6000, 1, 1).selectExpr("repeat('abcdefgh ', 400) AS t").mapInArrow(rows, "n long").collect()]
    assert sum(sizes) > 20_000_000
    assert max(sizes) < 6_000_000


@pytest.mark.parametrize("operator", ["windows", "signatures"])
def test_text_worked_on_at_once(monkeypatch, operator):
    rng, seen = random.Random(5), []
    texts = [" ".join(rng.choice(["ab", "cde", "f"]) for _ in range(3000)) for _ in range(600)] + [None, ""]
    tokens, shingles = decontam.Canonical.tokens, chosen_path.shingles
    monkeypatch.setattr(decontam.Canonical, "tokens", lambda self, some: seen.append(sum(map(len, some))) or tokens(self, some))
    monkeypatch.setattr(chosen_path, "shingles", lambda c: seen.append(sum(len(x or "") for x in c.to_pylist())) or shingles(c))
    one = Captured()
    if operator == "windows":
        decontam.window_rows(one, [(False, 8)])
        batch = pa.RecordBatch.from_arrays([pa.array([x or "" for x in texts])], names=["t"])
    else:
        chosen_path._signature_rows(one)
        batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], names=["h", "t"])
    for _ in one.work(iter([batch])):
        pass
    assert sum(seen) == sum(len(x or "") for x in texts)
    assert max(seen) <= (1 << 20 if operator == "windows" else 2 << 20)


# ------------------------------------------------------------------------------------------ op6
class Counted:
    def __init__(self, inner):
        self.inner, self.calls = inner, 0

    def encode_batch_fast(self, *args, **kw):
        self.calls += 1
        return self.inner.encode_batch_fast(*args, **kw)

    def __getattr__(self, name):
        return getattr(self.inner, name)


def test_new_chunks_are_encoded_together():
    tok = tokenizing.ByteBpeBatch(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    words = list({"".join(rng.choice("abcdeéßж") for _ in range(rng.randint(3, 9))) for _ in range(4500)})
    odd = ["x  y", "a  b", " lead", "tab\tin", "end ", "\n\nx", "mark! (two) 3.5", "line\nnext, line.\nlast", "", "<|endoftext|> z", "日本 語。", "\x85 q", "don't DON'T"]
    texts = [" ".join(words[i:i + 50]) for i in range(0, len(words), 50)] + odd
    plain = [b"".join(i.to_bytes(2, "little") for i in tok.whole.encode(t, add_special_tokens=False).ids) for t in texts]
    tok.whole = Counted(tok.whole)
    assert tok.batch(texts) == plain
    assert tok.whole.calls == 1
    assert tok.batch(texts) == plain  # all known now
    assert tok.whole.calls == 1


def test_marks_are_cut_from_words_before_they_are_looked_up():
    tok = tokenizing.ByteBpeBatch(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["alpha", "Straße", "ÿÀé"]
    texts = [f"go {w}{m} {w} {w}{m}{m} x\n{w}{m}" for w in words for m in tokenizing.MARKS]
    odd = ["a ×, ÷. é× b×, “a”, …, x…, ж, жук. 12, €. don't' it's, l'été! \n×, z", "a,", "\n, a", "ab\n, \né, \n12. b", ", , ,", "a\u0301, b\u0301.",
           "日本, 語。,", "² ½, ª, µ. b²,", "<|endoftext|>, a, b,", "a  b, c", "", "x\tb, c,", "\x85, q,", "a,\x85 b,", "it's 's, 's", "é,", " é,", "a word2, word2!!"]
    rng = random.Random(11)
    signs = ["a", "Z", "é", "ß", "×", "÷", "ж", "1", "²", "“", "…", "\u0301", " ", " ", "\n", "\t", "'", "s", "t", ",", ".", "!", "<", "|", ">", "_", "日"]
    odd += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    plain = [b"".join(i.to_bytes(2, "little") for i in tok.whole.encode(t, add_special_tokens=False).ids) for t in texts + odd]
    tok.whole = Counted(tok.whole)
    assert tok.batch(texts) == plain[:len(texts)]
    assert tok.whole.calls == 0  # letters of Latin-1 go to the model itself
    assert not [c for c in tok.known if c.strip("\n")[-1] in tokenizing.MARKS]  # a word is kept once, whatever stands behind it
    assert tok.batch(pa.array(texts + odd)) == plain
    for t, want in zip(odd, plain[len(texts):]):  # each by itself too
        assert tok.batch([t]) == [want], t


# ------------------------------------------------------------------------------------------ op4
def folded_first(page):
    """``visible_text`` with the page's white space folded before anything else."""
    import html
    body = warc._TAG.sub("", warc._BLOCK.sub("\n", warc._DROP.sub("", re.sub(r"[ \t\r\n\f]+", " ", page))))
    lines = (" ".join(html.unescape(x).replace("\r", " ").split()) for x in body.split("\n"))
    return "\n".join((" " + x if x.startswith("WARC/") else x) for x in lines if x)


def test_visible_text_of_odd_white_space():
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\r\n", "\r", "\t", "\f", "\v", "\x85", " ", "a", "Bc", "&amp", "&amp;", "&#13;", "&#10;", "&not", "in;", "<", "<p>", "</p\n>",
             "<b ", ">", "<script>", "</script \n>", "<!--", "-->", "WARC/1.1", "<br\r>", "<style", "<title>", "&#38", "é", "<h1 a='", "'>"]
    for _ in range(20_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert warc.visible_text(page) == folded_first(page), page


def test_visible_text_does_not_replace_every_space():
    page = "<p>" + "words of a page " * 50_000

    def took(work):
        times = []
        for _ in range(5):
            began = time.process_time()
            work()
            times.append(time.process_time() - began)
        return min(times)

    assert took(lambda: warc.visible_text(page)) < took(lambda: re.sub(r"[ \t\r\n\f]+", " ", page))


# ------------------------------------------------------------------------------------------ op8
def test_members_keep_one_edge(spark):
    prepare(spark)
    members, pivots = [f"m{i:04d}" for i in range(400)], [f"a{i}" for i in range(6)]
    rng = random.Random(2)
    ties = [(m, p) for m in members for p in rng.sample(pivots, 4)] + [("z1", "z0"), ("z2", "z1"), ("b", "m9999"), ("q", "q")]
    edges = spark.createDataFrame(ties, "a string, b string")
    assert chosen_path._stars(edges).count() <= len(members) + len(pivots) ** 2 + 3
    found = {r["node"]: r["root"] for r in chosen_path.components(edges, "few").collect()}
    assert found == {x: "a0" for x in members + pivots} | {x: "z0" for x in ("z0", "z1", "z2")} | {"b": "b", "m9999": "b"}


def test_buckets_that_fit_their_blocks_are_not_split(spark, make_docs, monkeypatch):
    stored, grown = chosen_path.stored, []

    def seen(df, name, *more, **kw):
        out = stored(df, name, *more, **kw)
        if name in ("paths", "pivots"):
            grown.append((name, out.count()))
        return out

    monkeypatch.setattr(chosen_path, "stored", seen)
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, copy = words(60), words(100)
    rows = [(i, " ".join(passage + words(40))) for i in range(150)]  # a common passage, far from the threshold
    rows += [(1000 + i, " ".join(copy[:95] + words(5))) for i in range(150)]  # near copies
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.classes(make_docs(rows)).collect()}
    assert found == {i: (i, 0) for i in range(150)} | {1000 + i: (1000, 149) for i in range(150)}
    most = chosen_path.BRANCHES * chosen_path.runs_needed() * len(rows)
    assert [name for name, _ in grown] == ["paths"] and grown[0][1] <= most, grown  # no bucket of 64 to 2560 sets makes children


def test_blocks_name_ties_by_the_smallest_digest(spark):
    prepare(spark)
    digests, rng = [f"{i:04d}" for i in range(300)], random.Random(6)
    sig = bytes(range(256))
    rng.shuffle(digests)
    sigs = spark.createDataFrame([(h, bytearray(sig)) for h in digests], "h string, sig binary")
    ties = {(r["a"], r["b"]) for r in chosen_path.candidate_ties(sigs).where("a != b").collect()}
    assert ties == {(h, "0000") for h in digests if h != "0000"}


def test_components_end_when_the_edges_are_stars(spark, monkeypatch):
    prepare(spark)
    stored, rounds = chosen_path.stored, []
    monkeypatch.setattr(chosen_path, "stored", lambda df, name, *more: rounds.append(name) or stored(df, name, *more))
    found = lambda ties: {r["node"]: r["root"] for r in chosen_path.components(spark.createDataFrame(ties, "a string, b string"), "few").collect()}
    assert found([(f"m{i}", "a") for i in range(30)] + [("z", "y")]) == {f"m{i}": "a" for i in range(30)} | {"a": "a", "z": "y", "y": "y"}
    assert rounds == ["edges", "few"]
    chain = [f"{i:03d}" for i in range(60)]
    assert found(list(zip(chain, chain[1:]))) == dict.fromkeys(chain, "000")
    assert found([("q", "q")]) == {}
