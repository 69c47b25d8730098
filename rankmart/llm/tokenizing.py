"""Whole-text ids of the public tokenizers, put together from cached ids of the texts' chunks.

Invented and natural prose alike repeat most of their words, so a worker looks a chunk up instead of
encoding it again. Each class below states why its chunks' ids, in order, are the text's ids; a text for
which that is not certain goes to the library whole.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rankmart.llm.common import pieces

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LOADED: dict = {}


def loaded(kind, path: str):
    """One instance per worker process and file."""
    key = (kind, path)
    if key not in _LOADED:
        _LOADED[key] = kind(path)
    return _LOADED[key]


def packed(tokens: list) -> bytes:
    """The tokens' ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])


MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves in byte-level models
_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_LETTER_CODES = np.array([ord(_LETTERS.get(b, chr(b))) for b in range(256)], dtype="<u2")

_ASCII_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


def latin(word: str) -> bool:
    """Letters of Latin-1 alone: such a word is one run of letters to every splitter, is its own NFC, and each letter has one lower form."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0100")


def byte_letters(word: str) -> str:
    """The letters that byte-level models have for the word's UTF-8 bytes."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)


class _Cached:
    LIMIT = 500_000  # entries; the dictionary is emptied when full, so a worker's memory stays bounded

    def __init__(self):
        self.known: dict = {}

    def look_up(self, chunks: list):
        """The chunks' entries in order; None if one of them has no entry of its own."""
        known = self.known
        found = list(map(known.get, chunks))  # most texts hold a chunk that is new: only these are looked at again
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps and len(known) > self.LIMIT:
            known.clear()
        for i in gaps:
            c = chunks[i]
            if c not in known:
                known[c] = self.entry(c)
            found[i] = known[c]
        return found


class WordBpe(_Cached):
    """Tokenizers whose pre-splitting drops white space: chunks are the runs between spaces and line ends.

    No pre-token holds white space, normalisation never joins across it, so the ids of the runs in order are
    the ids of the text. A run of Latin-1 letters (with ASCII marks after it) is one lower-cased pre-token (and a
    second one) of the model; other runs go through the library's own normaliser and splitter.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model, self.norm, self.split = self.whole.model, self.whole.normalizer, self.whole.pre_tokenizer
        self.pre: dict = {}

    def _pre(self, token: str) -> bytes:
        ids = self.pre.get(token)
        if ids is None:
            if len(self.pre) > self.LIMIT:
                self.pre.clear()
            ids = self.pre[token] = packed(self.model.tokenize(token))
        return ids

    def entry(self, chunk: str) -> bytes:
        word = chunk.rstrip(MARKS)
        if latin(word):
            ids = self._pre(byte_letters(word.lower()))
            return ids if len(word) == len(chunk) else ids + self._pre(chunk[len(word):])
        return b"".join(self._pre(p) for p, _ in self.split.pre_tokenize_str(self.norm.normalize_str(chunk)))

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if "<|" in text:  # may hold a special token's string, which the library treats by itself
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(self.look_up(text.replace("\n", " ").split(" ")))


class ByteBpe(_Cached):
    """Byte-level BPE whose pre-splitting breaks before the single space or line end in front of a word.

    A chunk is a run without spaces and line ends, with the one space or line end before it. Where a chunk
    would be empty, or holds other white space at an edge, the splitter's look-ahead could see past it: such
    a text goes to the library whole.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model, self.split = self.whole.model, self.whole.pre_tokenizer
        self.pre: dict = {}

    def _pre(self, token: str) -> bytes:
        ids = self.pre.get(token)
        if ids is None:
            if len(self.pre) > self.LIMIT:
                self.pre.clear()
            ids = self.pre[token] = packed(self.model.tokenize(token))
        return ids

    def _raw(self, piece: str) -> bytes:
        return b"".join(self._pre(p) for p, _ in self.split.pre_tokenize_str(piece))

    def entry(self, chunk: str):
        body = chunk[1:] if chunk[:1] == "\n" else chunk
        if not body or body[0].isspace() or body[-1].isspace() or "\x85" in body or not body.isprintable() and any(
                x.isspace() for x in body):
            return None
        if chunk[:1] != "\n" and chunk.isascii():
            if chunk.isalpha():
                return self._pre("Ġ" + chunk)  # the library's letter for a space byte
            if chunk[-1] in ",." and chunk[:-1].isalpha():
                return self._pre("Ġ" + chunk[:-1]) + self._pre(chunk[-1])
        return self._raw(chunk if chunk[:1] == "\n" else " " + chunk)

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text and text:
            first, *rest = text.replace("\n", " \n").split(" ")
            # a chunk that starts with the line end has its own key; others stand for " " + chunk
            if first and not first[0].isspace() and not first[-1].isspace() and first.isprintable():
                parts = self.look_up(rest) if rest else []
                if None not in parts:
                    return self._raw(first) + b"".join(parts)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class ByteBpeBatch(ByteBpe):
    """The same ids for many texts at once: Arrow splits the texts and numbers their distinct chunks, each of which is looked
    up once. Of the chunks that are not known yet, words of Latin-1 letters go to the library's model and the others to the
    whole tokenizer in one call.

    Ids are kept as 16-bit integers where the vocabulary allows, else as 32-bit ones (``dtype``). Known chunks stand in two
    generations; when the younger is full it becomes the older one, and what is looked up there moves back, so that
    common chunks are never lost and memory stays bounded.
    """

    GENERATION = 300_000  # entries; with a batch more they fit a dictionary of half a million places
    JOINED = 5_000        # chunks encoded in one call
    BATCH_CHARS = 1_000_000  # bytes of UTF-8, so no more characters

    def __init__(self, path: str):
        super().__init__(path)
        size = self.whole.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.width = np.array([len(self.whole.id_to_token(i) or "") for i in range(size)])  # a letter of a token is a byte of the text
        self.id_bytes = [np.array(i, self.dtype).tobytes() for i in range(size)]
        self.line_end = self._narrow(self._raw("\n"))
        self.older: dict = {}

    def _plain(self, chunk: str) -> bool:
        """Whether a chunk's ids don't depend on what stands around it (see ``ByteBpe``)."""
        body = chunk[1:] if chunk[:1] == "\n" else chunk
        if not body or body[0].isspace() or body[-1].isspace() or "\x85" in body:
            return False
        return body.isprintable() or not any(x.isspace() for x in body)

    def _learn(self, chunks: list[str]) -> None:
        for lo in range(0, len(chunks), self.JOINED):
            some = chunks[lo:lo + self.JOINED]
            joined = (" " + " ".join(some)).replace(" \n", "\n")
            raw = np.array(self.whole.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
            data = np.frombuffer(joined.encode(), np.uint8)
            starts = np.flatnonzero((data == 32) | (data == 10))  # a chunk's space or line end is its first byte alone
            ends, at = np.append(starts[1:], len(data)), np.cumsum(self.width[raw])
            cuts = np.searchsorted(at, ends)
            if len(starts) != len(some) or not (at[cuts] == ends).all():
                raise RuntimeError("a token runs over a chunk's end; this tokenizer needs the whole text")
            stops = ((cuts + 1) * raw.itemsize).tolist()
            self.known.update(zip(some, map(raw.tobytes().__getitem__, map(slice, [0, *stops], stops))))

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words of Latin-1 letters with ``before`` (a space or nothing) in front: the splitter keeps such a run whole, so
        the model gets it directly."""
        data = np.frombuffer((before + ("\n" + before).join(words)).encode(), np.uint8)
        tokenize, of = self.model.tokenize, self.id_bytes
        letters = _LETTER_CODES[data].tobytes().decode("utf-16-le").split(_LETTERS[10]) if words else []
        return [b"".join([of[t.id] for t in tokenize(x)]) for x in letters]

    def _find(self, chunks: list[str]) -> list[bytes | None]:
        """Entries of chunks that aren't in the younger generation. Letters with marks behind them are two pre-tokens, so such a
        chunk is the letters' ids and the marks', and only the letters are kept (with their line end, if one is before them)."""
        known, older = self.known, self.older
        spaced, lines, other, marked = {}, {}, {}, {}
        for c in chunks:
            body = c[1:] if c[:1] == "\n" else c
            key, word = c, body
            if not body.isalpha():
                word = body.rstrip(MARKS)
                if word.isalpha():
                    key = c[:len(c) - len(body) + len(word)]
                    marked[c] = key
                    if key in known:
                        continue
                elif not self._plain(c):
                    continue
            got = older.get(key)
            if got is not None:
                known[key] = got
            elif not word.isascii() and max(word) > "\u00ff" or not word.isalpha():
                other[key] = True
            elif body is c:
                spaced[key] = True
            else:
                lines[key] = word
        known.update(zip(spaced, self._words(list(spaced), " ")))
        known.update(zip(lines, [self.line_end + x for x in self._words(list(lines.values()), "")]))
        self._learn(list(other))
        ends: dict = {}
        for c, key in marked.items():
            end = c[len(key):]
            if end not in ends:
                ends[end] = self._narrow(self._raw(end))
            marked[c] = known[key] + ends[end]
        return [marked[c] if c in marked else known.get(c) for c in chunks]

    def _narrow(self, ids: bytes) -> bytes:
        """32-bit ids as ``dtype`` integers."""
        return ids if self.dtype == "<u4" else np.frombuffer(ids, "<u4").astype("<u2").tobytes()

    def _head(self, first: str) -> bytes | None:
        """Ids of a text's first chunk, which no space stands before; None where the text goes to the library whole."""
        if not first or first[0].isspace() or first[-1].isspace() or not first.isprintable():
            return None
        return self._narrow(self._raw(first))

    def _cut_marks(self, chunks: pa.Array, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The chunks with the ASCII marks at their end as parts of their own, whether a part is such marks, and the texts' offsets
        among the parts. The splitter breaks between a letter or digit and marks; only those of ASCII and letters of
        Latin-1 are seen as such here, and a text's first chunk stays whole."""
        n, (_, at, raw) = len(chunks), chunks.buffers()
        bounds, data = np.frombuffer(at, np.int64)[chunks.offset:chunks.offset + n + 1], np.frombuffer(raw or b"", np.uint8)
        cuts = bounds[:-1] + pc.binary_length(pc.ascii_rtrim(chunks, MARKS)).to_numpy()
        marked = (cuts > bounds[:-1]) & (cuts < bounds[1:])
        marked[offsets[:-1]] = False
        found = np.flatnonzero(marked)
        cuts = cuts[found]
        last, before = data[cuts - 1], data[cuts - 2]
        sure = _ASCII_ALNUM[last] | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)  # not the signs of times and division
        found, cuts = found[sure], cuts[sure]
        parts = pa.LargeStringArray.from_buffers(n + len(found), pa.py_buffer(np.insert(bounds, found + 1, cuts)), raw)
        is_marks = np.zeros(n + len(found), bool)
        is_marks[found + 1 + np.arange(len(found))] = True
        return parts, is_marks, offsets + np.searchsorted(found, offsets)

    def _some(self, texts: pa.Array) -> list[bytes]:
        if len(self.known) > self.GENERATION:
            self.older, self.known = self.known, {}
        # the texts' parts (chunks, and marks cut from them) in order, as numbers of the distinct ones; each text has at least one
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        parts, is_marks, offsets = self._cut_marks(split.flatten(), split.offsets.to_numpy())
        coded = parts.dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary
        starts = offsets[:-1]
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)  # may hold a special token's string
        heads = [None if x else self._head(f) for x, f in zip(special, names.take(coded.indices.take(pa.array(starts))).to_numpy(zero_copy_only=False))]
        whole = np.array([h is None for h in heads])
        rest = np.repeat(~whole, np.diff(offsets))
        rest[starts] = False
        asked = np.flatnonzero(np.bincount(codes[rest & ~is_marks], minlength=len(names)))
        ends_asked = np.flatnonzero(np.bincount(codes[is_marks], minlength=len(names)))
        chunks = names.take(pa.array(asked)).to_numpy(zero_copy_only=False).tolist()  # quicker than to_pylist
        found = list(map(self.known.get, chunks))
        gaps = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(gaps, self._find([chunks[i] for i in gaps])):
            found[i] = x
        # entries: the distinct chunks, the distinct marks behind words, then one for each text's first chunk or whole
        failed = np.zeros(len(names), bool)
        failed[asked[[i for i in gaps if found[i] is None]]] = True
        whole |= np.logical_or.reduceat(failed[codes] & rest & ~is_marks, starts)
        rest &= np.repeat(~whole, np.diff(offsets))
        todo = np.flatnonzero(whole)
        for i, t in zip(todo.tolist(), texts.take(pa.array(todo)).to_pylist()):
            heads[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        marks = [self._narrow(self._raw(x)) for x in names.take(pa.array(ends_asked)).to_numpy(zero_copy_only=False)]
        entries = [x or b"" for x in found] + marks + heads
        pool = np.frombuffer(b"".join(entries), self.dtype)
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // pool.itemsize
        place = np.zeros(len(names), np.int64)
        place[asked] = np.arange(len(asked))
        at = place[codes]
        place[ends_asked] = len(asked) + np.arange(len(marks))
        at[is_marks] = place[codes[is_marks]]
        at[starts] = len(asked) + len(marks) + np.arange(len(texts))
        n = np.where(rest, sizes[at], 0)
        n[starts] = sizes[at[starts]]
        ends = np.cumsum(n)
        data = pool[np.repeat((np.cumsum(sizes) - sizes)[at] - ends + n, n) + np.arange(ends[-1])].tobytes()
        stops = (ends[offsets[1:] - 1] * pool.itemsize).tolist()
        return list(map(data.__getitem__, map(slice, [0, *stops], stops)))

    def batch(self, texts) -> list[bytes]:
        """Ids of each text (a list or an Arrow array, without nulls) as ``dtype`` integers; a bounded number of bytes is worked on
        at once, a text being the least."""
        some = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        one = pa.RecordBatch.from_arrays([some.cast(pa.large_string())], names=["t"])
        return [x for b in pieces([one], "t", self.BATCH_CHARS) for x in self._some(b.column("t"))]


class PieceCounts(_Cached):
    """Token counts of a sentencepiece BPE model whose pieces never hold the space mark behind another
    character: no merge crosses a space, so a text's count is the sum over its space-separated runs, as long
    as single spaces stand between them."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        size = self.whole.vocab_size()
        self.local = not any(mark in self.whole.id_to_piece(i).lstrip(mark) for i in range(size))
        # the count of a run must not depend on what the model adds in front of a text
        one = lambda s: len(self.whole.encode(s))
        self.local = self.local and one("ab cd") == one("ab") + one("cd")

    def entry(self, chunk: str):
        if not chunk or "▁" in chunk or any(x.isspace() and x != "\n" for x in chunk) or chunk[0] == "\n" or chunk[-1] == "\n":
            return None
        return len(self.whole.encode(chunk))

    def count(self, text: str) -> int:
        if self.local and text and "<" not in text:
            if (counts := self.look_up(text.split(" "))) and None not in counts:
                return sum(counts)
        return len(self.whole.encode(text))
