"""Trie encoding against the tokenizers library and a plain merge loop."""

import hashlib
import json
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lavra.llm import bpe
from lavra.llm.queries import op13_bpe_trie

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def ids_of(vocabulary, text):
    (out,) = bpe.Encoder(vocabulary).encode([text])
    return list(struct.unpack(f"<{len(out) // 4}I", out))


def digests(library, text):
    text = text or ""
    ids = library.encode(text, add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False).encode())


def plain(vocabulary, word):
    """Merges of lowest rank first, leftmost of equals."""
    ids = [vocabulary.ids[bytes([b])] for b in word]
    while True:
        found = [(vocabulary.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in vocabulary.merge]
        if not found:
            return ids
        _, i = min(found)
        ids[i : i + 2] = [vocabulary.merge[ids[i], ids[i + 1]][1]]


TEXTS = [
    "", " ", "a", "Hello, world's  best 1234 tokens!\n\n  end ", "aaaaaaaaaaaaaaaaaaaaaaaa", "  \n\t  x", "é́ 日本語 𝒳 ½ ٣", "\x00\x01\x7f", "don't DON'T we'll",
    "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "ࢗ\U0001c000 ՘x\U000323b0 1\U00011de0", "  " * 300, "\r\n" * 7, "=" * 200, "� ﻿",
]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(vocabulary, library, text):
    assert ids_of(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_random_texts_as_the_library(vocabulary, library, seed):
    rng = random.Random(seed)
    alphabets = ["ab", "abcdefghij klmnop", "the in er on at re ", " \n\t.,'!s1", "éüñßçø ", "日本語テスト "]
    for _ in range(150):
        text = "".join(rng.choice(rng.choice(alphabets)) if rng.random() < 0.9 else chr(rng.randrange(0x20, 0x3000)) for _ in range(rng.randrange(1, 120)))
        assert ids_of(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


def test_every_code_point_is_cut_as_the_library_cuts_it(vocabulary, library):
    encoder = bpe.Encoder(vocabulary)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(points), 20_011):  # blocks from all planes, the whole of the first
        text = "\n".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}." for c in points[k : k + (20_011 if k < 0x10000 else 500)])
        if encoder._has_foreign(text):
            text = "".join(c for c in text if not encoder._has_foreign(c))
        words = [w for u in encoder._units(text) for w in encoder.words.findall(u)]
        assert words == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_units_are_cut_as_the_whole(vocabulary):
    encoder, rng = bpe.Encoder(vocabulary), random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("  \n\t\u00a0a1'.s\u3000") for _ in range(rng.randrange(0, 14)))
        units = encoder._units(text)
        assert "".join(units) == text and [w for u in units for w in encoder.words.findall(u)] == encoder.words.findall(text)


def test_words_as_a_plain_merge_loop(vocabulary):
    rng = random.Random(9)
    words = {bytes(rng.choice(b"abcdeaetn \xc3\xa9") for _ in range(rng.randrange(1, 25))) for _ in range(800)}
    assert dict(vocabulary.encode_words(words)) == {w: plain(vocabulary, w) for w in words}


def test_a_made_up_vocabulary_with_equal_halves_and_unreachable_tokens(tmp_path):
    """Merges of a token with itself, and one whose own bytes merge otherwise."""
    chars = {b: c for c, b in bpe._byte_chars().items()}
    merges = ["a a", "b c", "aa aa", "a b", "ab c", "aa a", "bc bc", "aab c"]
    tokens = [chars[b] for b in range(256)] + list(dict.fromkeys(m.replace(" ", "") for m in merges)) + ["aab"]
    merges.append("aa b")
    pre = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}
    path = tmp_path / "small.json"
    path.write_text(json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": pre, "post_processor": None, "decoder": pre, "model": model}))
    voc, lib = bpe.Vocabulary(str(path)), Tokenizer.from_file(str(path))
    rng = random.Random(1)
    for _ in range(600):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 18)))
        assert ids_of(voc, text) == lib.encode(text, add_special_tokens=False).ids, text
    model["byte_fallback"] = True
    path.write_text(json.dumps({"added_tokens": [], "normalizer": None, "pre_tokenizer": pre, "model": model}))
    with pytest.raises(ValueError, match="byte_fallback"):
        bpe.Vocabulary(str(path))


def test_shared_prefixes_are_worked_out_once(vocabulary, monkeypatch):
    calls = []
    real = bpe.Vocabulary.step
    monkeypatch.setattr(bpe.Vocabulary, "step", lambda self, w, e, *more: calls.append(w[:e]) or real(self, w, e, *more))
    dict(vocabulary.encode_words([b"inter", b"internal", b"international", b"intern", b"x", b"inter"]))
    assert len(calls) == len(set(calls)) == len("international") + len("l") + len("x")


def test_bounds_change_nothing(vocabulary, library, monkeypatch):
    text = "lorem ipsum dolor " * 50 + "x" * 3000 + " 12 <|endoftext|> " + "é" * 500
    want = library.encode(text, add_special_tokens=False).ids
    for name, value in (("SLICE", 100), ("RUN", 7), ("DEEP", 3), ("KEPT_BYTES", 10), ("KEPT_PAIRS", 3)):
        monkeypatch.setattr(bpe, name, value)
        assert ids_of(vocabulary, text) == want
    assert [len(x) for x in bpe.Encoder(vocabulary).encode([text, "", "a b", text])][1:3] == [0, 8]


def test_documents_of_every_kind(spark, docs, rows, library):
    encoded = bpe.encode(docs, PATH)
    found = bpe.decode(encoded, PATH).withColumn("listed", bpe.token_ids(F.col("ids"))).collect()
    got = sorted((r.doc_id, r.listed, r.decoded) for r in found)
    want = sorted((r[0], library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in rows)
    assert got == want


def test_foreign_ids_and_broken_bytes(spark, library):
    for ids in ([50256, 3, 99999, 447], [447, 447, 247, 262], []):
        df = spark.createDataFrame([(1, bytearray(struct.pack(f"<{len(ids)}I", *ids)))], "ids_of int, ids binary")
        assert bpe.decode(df, PATH).head().decoded == library.decode(ids, skip_special_tokens=False)


def test_empty_table(empty):
    assert bpe.decode(bpe.encode(empty, PATH), PATH).collect() == []


def test_query_over_the_given_documents(spark, sf, given, library):
    got = sorted(tuple(r) for r in op13_bpe_trie(spark, sf).collect())
    assert got == sorted((i, *digests(library, t)) for i, t in given)
