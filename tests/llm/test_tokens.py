"""Vocabulary encoders, BPE by tree reduction, packing and token files against the libraries."""

import base64
import hashlib
import json
import unicodedata
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphlake.llm import packing, token_files
from graphlake.llm.bpe_tree import Tree, encode_documents
from graphlake.llm.vocab import document_encoder, library_encoder

ODD = ["", " ", "\n\n a", "a  \n", "x\x1cy  z", "ΣΑΣ Σ", "İx", "a\x00b", "<|endoftext|> hi", "don't  won't", "Å Å", "１２ ² ½", " a b", "é " * 3, "'s 'S", "日本語　テスト", "ſ K", "a" * 5000, "x " * 3000, "!!!..'s'll"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice("ab 'sté,.\n1２\t") for _ in range(draw.randrange(60))) for _ in range(300)]
    want = [x + b"\2\0\0\0" for x in library_encoder(P.path(name))(texts)]
    assert document_encoder(P.path(name), 2)(texts) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library_in_all_scripts(name):
    draw, mixed = random.Random(3), []
    kinds = [lambda: chr(draw.randrange(0x20, 0x250)), lambda: chr(draw.randrange(0x250, 0x3000)), lambda: chr(draw.randrange(0x3000, 0xD800)), lambda: chr(draw.randrange(0xE000, 0x11000)),
             lambda: chr(draw.randrange(0x10000, 0x1F000)), lambda: chr(draw.randrange(0x1F000, 0x30000)), lambda: draw.choice("aA1 .'e\u0301\u0316\u1100\u1161\u11a8\u09c7\u09beΣİK")]
    for _ in range(6000):
        some = draw.sample(kinds, 2)
        mixed.append("".join(draw.choice(some)() for _ in range(draw.randrange(1, 12))))
    mixed += [chr(c) + "a" + chr(c) for c in range(0x110000) if c % 7 == 0 and not 0xD800 <= c < 0xE000]
    mixed += ["\u209eB", "\u208f\u1f5c", *"\u1c89\ua7cb\U00010d50\U00010d65\U00016ea0"]
    want = [x + b"\2\0\0\0" for x in library_encoder(P.path(name))(mixed)]
    got = document_encoder(P.path(name), 2)(mixed)
    assert [t for t, a, b in zip(mixed, got, want, strict=True) if a != b] == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_merges_by_rank_are_merges_by_pair(name):
    """Each merge's bytes come down to its own pair under the merges before it: so a rank's bytes meet by no other pair."""
    model = json.load(open(P.path(name), encoding="utf-8"))["model"]
    end = model.get("end_of_word_suffix") or "\0none"
    rank: dict[tuple, int] = {}
    split = lambda t: (*t.removesuffix(end)[:-1], t.removesuffix(end)[-1:] + (end if t.endswith(end) else ""))
    for k, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        parts = list(split(left + right))
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 10**9))
            if rank.get(parts[best] + parts[best + 1], 10**9) == 10**9:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [left, right]
        assert rank.setdefault(left + right, k) == k


RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1 '\n\tsrevl.é,", max_size=60), st.integers(1, 7))
def test_tree_equals_whole(text, leaf):
    tree = TREE
    tree.leaf = leaf
    _, ids = tree.encode(text)
    assert [int(x) for x in ",".join(ids).split(",") if x] == LIBRARY.encode_ordinary(text)
    assert tree.decode(ids) == text.encode()


TREE = Tree(RANKS, P.PATTERN)


def test_join_is_associative():
    tree = Tree(RANKS, P.PATTERN, leaf=1)
    one = [tree.encode(x) for x in ("don", "'", "t  ", " stop", "")]
    left = one[0]
    for x in one[1:]:
        left = tree.join(left, x)
    right = one[-1]
    for x in one[-2::-1]:
        right = tree.join(x, right)
    assert left == right == tree.encode("don't   stop")


def test_bpe_documents(docs_of):
    rows = [*enumerate(ODD), (100, None)]
    got = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in encode_documents(docs_of(rows), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, leaf=16).collect()}
    assert got == {i: (LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows}
    told = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(docs_of(rows), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, digest=True).collect()}
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    assert told == {i: (len(ids), sha(",".join(map(str, ids)).encode()), sha(raw)) for i, (ids, raw) in got.items()}
    with pytest.raises(ValueError):
        Tree(RANKS, r"\s*[\r\n]+|\S+|\s+")
    assert encode_documents(docs_of([]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 70))
def test_bits_round_trip(width, n):
    ids = np.random.default_rng(n).integers(0, 2**width, n).astype(np.uint32)
    data = token_files.pack_bits(ids, width)
    assert len(data) == -(-n * width // 8)
    assert (token_files.unpack_bits(data, width, n) == ids).all()


def test_file_reads_at_random(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 8)
    draw = np.random.default_rng(0)
    docs = [(i, draw.integers(0, 2**17, int(draw.integers(0, 30))).astype(np.uint32)) for i in range(40)]
    w = token_files.Writer(str(tmp_path / "a.tok"), 17)
    for i, ids in docs:
        w.add(None if i == 0 else i, ids)
    every = np.concatenate([x for _, x in docs])
    assert w.close() == (40, len(every))
    r = token_files.Reader(str(tmp_path / "a.tok"))
    for a, b in ((0, 3), (5, 9), (7, 8), (0, len(every)), (4, 4)):
        assert (r.ids(a, b) == every[a:b]).all()
    assert [(d, x.tolist()) for d, _, x in r.documents()] == [(None if i == 0 else i, x.tolist()) for i, x in docs]


def test_token_files(spark, docs_of):
    rows = [(7, "b a"), (3, None), (5, "hello  world\n"), (3, "again"), (9, "x" * 100_000)]
    files = token_files.write_token_files(docs_of(rows), P.path("byte_bpe_50k.json"))
    got = [tuple(r) for r in token_files.read_token_files(spark, files).orderBy("start").collect()]
    encode, at, want = document_encoder(P.path("byte_bpe_50k.json"), 2), 0, []
    for d, t in sorted((d, t or "") for d, t in rows):
        ids = encode([t])[0]
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    assert token_files.read_token_files(spark, token_files.write_token_files(docs_of([]), P.path("byte_bpe_50k.json"))).count() == 0


def test_packing(docs_of):
    rows = [(i, "word " * (i * 3)) for i in range(30)] + [(50, None), (51, ""), (51, "twice")]
    pieces = [r.asDict() for r in packing.pack(docs_of(rows), P.path("word_bpe_49k.json"), 16).collect()]
    spans = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    at = 0
    for seq, off, n in spans:
        assert (seq, off) == divmod(at, 16)
        at += n
    encode, by = document_encoder(P.path("word_bpe_49k.json"), 2), {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        by[p["doc_id"]] = by.get(p["doc_id"], b"") + bytes(p["ids"])
        assert len(p["ids"]) == 4 * p["length"]
    for d, t in rows:
        if d != 51:
            assert by[d] == encode([t or ""])[0]
    assert len(by[51]) == len(encode([""])[0]) + len(encode(["twice"])[0])
    assert packing.pack(docs_of([]), P.path("word_bpe_49k.json")).count() == 0
