import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parley.llm import bpe
from parley.llm.bpe import TrieEncoder, bpe_roundtrip
from parley.llm.tokens import token_counts
from parley.llm.words import Words

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["the", "Don't", "é", "Ü", "ΣΣ.", "İ", "1２", "½", "\x1c", "!!'t", "<|endoftext|>", "<|STARTOFTEXT|>", "<|",
         "中文", "한글", "가", "ﬁ", "ͅ", "Ⅷ", "　", " ", "\n", "\xa0", "\U0001F600", "anlyen", "x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    made = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(400)]
    made += [" ".join(draw.choice(PARTS) for _ in range(300)) for _ in range(20)]
    # Without white space: no common boundary until the overlap holds the whole text.
    made += ["", None, "x" * 700, "ab1" * 400, "word " * 200, "!" * 500 + " a" * 300, "word " * 200]
    return made


def frame(spark, texts):
    rows = [(i, t, "other") for i, t in enumerate(texts)] + [(None, "a b", "x"), (0, texts[0], "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")


def test_counts_equal_the_library_for_any_cut(spark, library, texts):
    expected = [len(library.encode(t or "", add_special_tokens=False)) for t in texts]
    expected = sorted([*enumerate(expected), (-1, 2), (0, expected[0])])
    for chunk, overlap in ((32_768, 512), (100, 7), (64, 30)):
        got = token_counts(frame(spark, texts), PATH, chunk=chunk, overlap=overlap, limit=50).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == expected
        assert all(r.over_limit == (r.n_tokens > 50) for r in got)
        assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in got if r.doc_id is not None)


def test_roundtrip_equals_the_library(spark, library, texts):
    got = bpe_roundtrip(frame(spark, texts), PATH).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "a b" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_small_memory_changes_nothing(library, texts):
    small = TrieEncoder(PATH, most=50, together=300)
    whole = TrieEncoder(PATH)
    kept = [t or "" for t in texts]
    assert list(small.encode_texts(kept)) == list(whole.encode_texts(kept))


def bytes_held(things, seen):
    total = 0
    for x in things:
        if id(x) not in seen:
            seen.add(id(x))
            inside = [*x, *x.values()] if isinstance(x, dict) else x if isinstance(x, (list, tuple, set)) else []
            total += sys.getsizeof(x) + bytes_held(inside, seen)
    return total


def test_an_encoder_holds_little():
    encoder, seen = TrieEncoder(PATH), set()
    # The library's tables are not kept beside the encoder's own.
    assert not any(isinstance(x, Tokenizer) for x in vars(encoder.words).values())
    assert bytes_held([x for x in vars(encoder).values() if isinstance(x, dict)], seen) < 28e6
    draw = random.Random(4)
    words = {"".join(draw.choice("abdegilmnorstu") for _ in range(9)) for _ in range(30_000)}
    list(encoder.encode_texts([" ".join(sorted(words))]))
    assert len(encoder.known) == len(words)
    memories = [encoder.known, encoder.spelled]
    assert bytes_held(memories, seen.difference(map(id, memories))) < 260 * len(words)


def test_texts_put_together_in_parts_equal_the_library(library, texts, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 7)
    kept = [t or "" for t in texts]
    for text, (ids, n, decoded) in zip(kept, TrieEncoder(PATH).encode_texts(kept), strict=True):
        found = library.encode(text, add_special_tokens=False).ids
        assert (ids, n) == (" ".join(map(str, found)), len(found))
        assert decoded == library.decode(found, skip_special_tokens=False)


def test_border_rule_equals_plain_merging():
    encoder = TrieEncoder(PATH)
    draw = random.Random(2)
    tokens = [t for t in encoder.size if not t.endswith("</w>")]
    for _ in range(20_000):
        a, b = draw.choice(tokens), draw.choice(list(encoder.size) if draw.random() < 0.01 else tokens)
        steps = encoder.merges(encoder.split(a) + encoder.split(b))
        own = encoder.merges(encoder.split(a)) + encoder.merges(encoder.split(b))
        joined = a + b
        assert encoder.beside(a, b) == (sorted(steps) == sorted(own)), joined


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts(empty, PATH).count() == 0
    assert bpe_roundtrip(empty, PATH).count() == 0


def test_words_with_any_code_point_below_0300_equal_the_library(library):
    words = Words(PATH)
    for c in map(chr, range(0x300)):
        for text in (c, c + "bc", "ab" + c, f"a{c}b {c}{c}", c + "1"):
            low = library.normalizer.normalize_str(text)
            pieces = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(low)]
            made = [i for w in words(text) for i in library.encode(w, add_special_tokens=False).ids]
            assert len(words(text)) == len(pieces), (hex(ord(c)), text)
            assert made == library.encode(text, add_special_tokens=False).ids
