import hashlib
import itertools
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from tests.llm.helpers import ODD, documents
from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tok():
    return bpe.Tokenizer(bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def known(tok):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tok.ranks, special_tokens={})


def random_texts(n):
    rnd = random.Random(1)
    alphabet = "ab 's'tre'll'd'm've  \n\t\r.,!?1234é漢字ñ  \u0085\x1c🙂ǅ²½'`´İ　 the of Th́"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_like_the_library(tok, known):
    for text in [t or "" for _, t, _ in ODD] + random_texts(4000):
        ids = tok.encode(text)
        assert ids == known.encode_ordinary(text), repr(text)[:80]
        assert tok.decode(ids) == text.encode()


def test_pieces_like_the_pattern():
    for text in random_texts(2000):
        assert bpe.split(text) == regex.findall(public_tokenizers.PATTERN, text), repr(text)


def test_every_character(tok, known):
    """In all surroundings that the pattern knows."""
    for lo in range(0, 0x20000, 64):
        found = [chr(c) for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b 1{c}2 .{c}! {c}  {c}'s{c}'s\n{c}\n\n" for c in found)
        assert tok.encode(text) == known.encode_ordinary(text), hex(lo)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 20_000, "=" * 20_000, "ab" * 20_000, "é" * 9_000, "\n" * 5_000 + "x"])
def test_long_pieces(tok, known, text):
    assert tok.encode(text) == known.encode_ordinary(text)


def test_memory_starts_anew(tok, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    own = bpe.Tokenizer(tok.ranks, tok.sound)
    for text in random_texts(300):
        assert own.encode(text) == tok.encode(text)
    assert len(own.memo) <= 10 and len(own.older) <= 10


def test_runs_of_texts(tok, monkeypatch):
    """New pieces of a run are merged together, in rows, and remembered; those are what single pieces give."""
    texts = [t or "" for _, t, _ in ODD] + random_texts(600)
    want = [tok.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "ROWS", 7)
    for memo in (bpe.MEMO, 10):
        monkeypatch.setattr(bpe, "MEMO", memo)
        own = bpe.Tokenizer(tok.ranks, tok.sound)
        assert own.encode_all(texts[:300]) + own.encode_all(texts[300:]) == want
        assert own.encode_all([]) == [] and own.encode_all([""]) == [[]]
        assert len(own.memo) <= max(memo, 10) + 7


def test_rows_merge_as_defined(tok):
    rnd = random.Random(3)
    some = [bytes(rnd.choices(b"aeinst \xc3\xa9!01\x00\xff", k=rnd.randint(1, 90))) for _ in range(3000)]
    want = [[tok.ranks[p]] if p in tok.ranks else bpe.merged(tok.ranks, p) for p in some]
    assert list(map(list, tok.encode_rows(some))) == want
    # A token that a later merge outranks, and bytes that are no tokens: those pieces go one by one.
    odd = {bytes([i]): i for i in range(256)} | {b"bc": 300, b"aab": 256, b"aa": 299, b"ab": 298, b"abab": 400}
    own = bpe.Tokenizer(odd)
    every = [bytes(x) for n in range(1, 8) for x in itertools.product(b"abc", repeat=n)]
    assert list(map(list, own.encode_rows(every))) == [[odd[p]] if p in odd else bpe.merged(odd, p) for p in every]
    assert bpe.Tokenizer({b"a": 0, b"aa": 1}).encode_all(["aaa", "aa", "a"]) == [[1, 0], [1], [0]]


def test_tokens_that_merging_never_makes():
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"xy": 257}
    tok = bpe.Tokenizer(ranks)
    enc = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert 256 not in tok.sound and 257 in tok.sound
    for text in ("abc", "abcabc", "xyxy", "xabc", " abc"):
        assert tok.encode(text) == enc.encode_ordinary(text)


def test_columns_and_round_trip(spark):
    docs = documents(spark)
    held = bpe.load(spark, PATH)
    encoded = bpe.encode(docs, held)
    assert encoded.columns == [*docs.columns, "ids_"]
    back = bpe.decode(encoded, held, "ids_")
    assert back.columns[-1] == "decoded_"
    rows = back.collect()
    assert len(rows) == len(ODD)
    assert all(bytes(r.decoded_).decode() == (r.text or "") for r in rows)
    both = bpe.encode(docs, held, decoded=True)
    assert both.columns == back.columns
    assert sorted(map(str, both.collect())) == sorted(map(str, rows))
    digests = bpe.digests(docs, held).collect()
    want = sorted((r.doc_id or 0, len(r.ids_), hashlib.sha256(",".join(map(str, r.ids_)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == want
    assert bpe.digests(documents(spark, []), held).count() == 0
