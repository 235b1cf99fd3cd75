"""Exact encoders over public vocabulary files that encode each distinct chunk of text once.

Both kinds of vocabulary file used here cut text before the merges in a way that always cuts
between a character that is not white space and white space that follows it, whatever stands
around: no alternative of the byte-level pattern crosses that place and none looks back, and the
lower-casing vocabulary drops white space. So the ids of a text are the ids of its chunks (white
space, then other characters), joined, and a task needs to encode a chunk once.

New chunks are encoded many at a time by a rank table made from the file's own merges; a table
whose ids differ from the tokenizers library on a probe of every vocabulary entry that is a text (whole
UTF-8, nothing reserved) isn't used, the library itself is then; each worker process probes once.

The table reads classes, lower case and normal forms from other Unicode tables than the library, so
each code point is tried when it first comes up, and texts with one that may differ, or with one that
the table reserves, go to the library whole (see Repertoire).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Python counts the separators U+001C to U+001F as white space, the tokenizers do not; the rest are reserved.
RESERVED = re.compile("[\x00\x01\x1c-\x1f]")
#: A task keeps at most so many chunks, each of at most so many characters.
CACHED, LONGEST = 300_000, 48
#: The published cutting patterns; \x01 stands between chunks, \x00 ends a word.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+(?!\S)|\s+|\x01"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}\x01]+|\x01"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def library_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Through the tokenizers library: no special tokens are added, and their strings are plain text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    many = getattr(tok, "encode_batch_fast", tok.encode_batch)
    return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in many(texts, add_special_tokens=False)]


class RankTable:
    """The merges of a byte-level vocabulary file as ranks; word ends, if it has them, as a last byte 0."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.word_end = model.get("end_of_word_suffix") or ""
        letters, vocab = byte_letters(), model["vocab"]

        def raw(token: str) -> bytes:
            body, end = (token[: -len(self.word_end)], b"\0") if self.word_end and token.endswith(self.word_end) else (token, b"")
            return bytes(letters[c] for c in body) + end

        ids: dict[bytes, int] = {bytes([letters[c]]): vocab[c] for c in letters}
        order = [bytes([b]) for b in range(256)]
        if self.word_end:
            ids |= {bytes([b, 0]): vocab[c + self.word_end] for c, b in letters.items()}
            order += [bytes([b, 0]) for b in range(256)]
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merged = raw(left) + raw(right)
            if merged not in ids:
                ids[merged] = vocab[left + right]
                order.append(merged)
        self.to_id = np.array([ids[t] for t in order], "<u4")
        pattern = r"[^\x00\x01]*\x00|\x01" if self.word_end else BYTE_LEVEL
        self.table = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
        self.words = regex.compile(WORD_LEVEL)

    def whole(self, text: str) -> bytes:
        return self.to_id[self.table.encode_ordinary(text)].tobytes()

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Of texts that hold no reserved character and, with word ends, no white space."""
        import unicodedata

        if not self.word_end:
            return [self.whole(c) for c in chunks]
        joined = unicodedata.normalize("NFC", "\x01".join(chunks))
        joined = "".join(c.lower() for c in joined) if "Σ" in joined else joined.lower()
        found = self.words.findall(joined + "\x01")
        ranks = np.array(self.table.encode_ordinary("\0".join(found).replace("\x01\0", "\x01")), np.int64)
        ends = np.flatnonzero(ranks == 1)
        if len(ends) != len(chunks):
            raise ValueError("a chunk holds a reserved character")
        ids, ends = self.to_id[ranks].tobytes(), (4 * ends).tolist()
        return [ids[i:j] for i, j in zip([0, *(e + 4 for e in ends)], ends, strict=False)]


def probes(vocab: Iterable[str], word_end: str) -> list[str]:
    """The text of every entry that has one; with word ends white space has no ids and is left out."""
    letters, out = byte_letters(), []
    for token in vocab:
        body = token.removesuffix(word_end) if word_end else token
        try:
            text = bytes(letters[c] for c in body).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if not RESERVED.search(text) and not (word_end and any(map(str.isspace, text))):
            out.append(text)
    return out


@cache
def chunk_encoder(path: str) -> tuple[Callable[[list[str]], list[bytes]], Callable[[list[str]], list[bytes]], bool]:
    """(encoder of chunks, encoder of whole texts, whether white space has no ids)."""
    whole = library_encoder(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    no_space = bool((spec["model"].get("end_of_word_suffix")))
    try:
        table = RankTable(path)
        probe = [*probes(spec["model"]["vocab"], table.word_end), "don't", "it's", "Straße", "Ère,", "x́y", "123abc...", "你好"]
        if table.encode(probe) == whole(probe):
            return table.encode, whole, no_space
    except (KeyError, ValueError):
        pass
    return whole, whole, no_space


class Repertoire:
    """The code points that the table is known to treat as the library does.

    Such a one is assigned and inert under normalisation by itself and beside others (no mark, no
    conjoining letter), and gives the library's ids alone, between letters, and between symbols. With
    word ends these ids show every cut and the lower case, so they settle its class; a byte-level
    table's ids need not show a cut, so there its class must also have been the same ever since
    Unicode 3.2, before any of the tables concerned.
    """

    def __init__(self, table: Callable[[list[str]], list[bytes]], library: Callable[[list[str]], list[bytes]], cuts_show: bool):
        self.table, self.library, self.cuts_show = table, library, cuts_show
        self.fine, self.odd = set(map(chr, range(128))), set()

    def inert(self, c: str) -> bool:
        import unicodedata as u

        kind = u.category(c)
        old = self.cuts_show or u.ucd_3_2_0.category(c) == kind
        return old and kind not in ("Cn", "Cs", "Mn", "Mc", "Me") and not 0x1100 <= ord(c) < 0x1200 and u.is_normalized("NFC", c)

    def odd_ones(self, texts: list[str]) -> list[int]:
        """Which texts hold another code point."""
        wide = [i for i, t in enumerate(texts) if not t.isascii()]
        seen = set().union(*(texts[i] for i in wide))
        new = sorted(seen - self.fine - self.odd)
        likely = [c for c in new if self.inert(c) and not RESERVED.search(c)]
        tries = [t for c in likely for t in (c, f"a{c}a", f"!{c}!", f"A{c}")]
        same = [a == b for a, b in zip(self.table(tries), self.library(tries), strict=True)] if tries else []
        self.fine.update(c for k, c in enumerate(likely) if all(same[4 * k : 4 * k + 4]))
        self.odd.update(c for c in new if c not in self.fine)
        return [] if seen <= self.fine else [i for i in wide if not self.odd.isdisjoint(texts[i])]


class WordCache:
    """Ids of words, in two generations: the older one goes when the newer one is full."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]]):
        self.encode_many, self.new, self.old = encode_many, {}, {}

    def of(self, words: list[str]) -> list[bytes]:
        new, old, out = self.new, self.old, []
        wanted = []
        for w in words:
            x = new.get(w)
            if x is None:
                x = old.get(w)
                if x is None:
                    wanted.append(len(out))
                else:
                    new[w] = x
            out.append(x)
        if wanted:
            for i, x in zip(wanted, self.encode_many([words[i] for i in wanted]), strict=True):
                out[i] = x
                if len(words[i]) <= LONGEST:
                    new[words[i]] = x
        if len(new) > CACHED:
            self.new, self.old = {}, new
        return out


class TextEncoder:
    """Whole texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        some, self.whole, self.no_space = chunk_encoder(path)
        self.table = getattr(some, "__self__", None)
        self.cache = WordCache(some)
        self.repertoire = Repertoire(self.by_table, self.whole, self.no_space)

    def by_table(self, texts: list[str]) -> list[bytes]:
        return self.by_words(texts) if self.no_space else [self.table.whole(t) if t else b"" for t in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.table is None:
            return self.whole(texts)
        odd = sorted({*self.repertoire.odd_ones(texts), *(i for i, t in enumerate(texts) if RESERVED.search(t))})
        plain = texts
        if odd:
            plain = list(texts)
            for i in odd:
                plain[i] = ""
        out = self.by_table(plain)
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        return out

    def by_words(self, texts: list[str]) -> list[bytes]:
        """Each distinct word of the batch is looked up once; the ids are then gathered by Arrow."""
        words = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        flat = words.flatten()
        kept = pc.not_equal(flat, "")
        ends = words.offsets.to_numpy()
        if not pc.all(kept).as_py():
            before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
            ends = before[ends - ends[0]]
            flat = flat.filter(kept)
        else:
            ends = ends - ends[0]
        coded = flat.dictionary_encode()
        ids = pa.array(self.cache.of(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        if not len(ids):
            return [b""] * len(texts)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1][ends].tolist()
        raw = memoryview(data) if data is not None else b""
        return [bytes(raw[i:j]) for i, j in zip(at, at[1:], strict=False)]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def document_encoder(path: str, end_id: int | None) -> Callable[[list[str]], list[bytes]]:
    """Whole texts to ids by the vocabulary file, with end_id (if any) after each document."""
    chunked = TextEncoder(path)
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    return lambda texts: [x + tail for x in chunked.encode(texts)]
