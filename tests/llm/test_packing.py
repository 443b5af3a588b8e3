import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, documents
from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2**32 - 1))
@settings(max_examples=200, deadline=None)
def test_pack_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    words = packing.pack(ids, bits)
    assert len(words) == -(-n // 64) * bits
    assert packing.unpack(words, bits, n).tolist() == ids.tolist()


def test_width():
    assert [packing.width(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize("bits", [1, 13, 16, 17, 32])
def test_blocks_are_read_alone(bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 3 * packing.BLOCK + 77, dtype=np.uint64)
    image = packing.file_image(pa.array(["a", None]), np.array([5, len(ids) - 5]), ids, bits, 3, 4) + b"\n"
    found = packing.PackedFile(image)
    assert (found.part, found.seq, found.doc_ids.to_pylist()) == (3, 4, ["a", None])
    for lo, hi in [(0, 5), (4095, 4097), (5000, 5000), (8192, 12_288), (12_300, 99_999), (0, len(ids))]:
        assert found.ids(lo, hi).tolist() == ids[lo:hi].tolist()
    broken = bytearray(image)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        packing.PackedFile(bytes(broken))


def encoded(words, texts):
    raw = [t.encode() for t in texts]
    begins = np.cumsum([0, *map(len, raw)])
    return words.encode(np.frombuffer(b"".join(raw), np.uint8), begins)


def test_word_by_word_is_the_whole_text(library):
    rnd = random.Random(3)
    alphabet = ["a", "B", "'s", "'re", " ", "  ", "\n", "\x0b", "\x1c", "\x85", " ", "́", "é", "É", "Σ", "İ", "1", "²", "漢", "🙂", "<|endoftext|>", "<|startof", "!", " ", "‍", "ﬁ", "the"]
    words = packing.Words(library.to_str())
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(rnd.choices("ab9Z+/", k=20_000)), "x" * 9000 + "7" * 9000 + "é" * 500]
    got = encoded(words, texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == whole(library, text), repr(text)[:80]


def test_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 5)
    words = packing.Words(library.to_str())
    for text in ["one two three", "four five six seven", "one two eight nine ten", "x" * 100 + " one"] * 3:
        assert np.frombuffer(encoded(words, [text])[0], "<u4").tolist() == whole(library, text)
        assert len(words.young) <= 12 and not any(len(w) > packing.MEMO_BYTES for w in words.young)


def test_files_of_odd_documents(spark, library, tmp_path):
    rows = ODD + [(100 + k % 7, f"word {k} again", "en") for k in range(60)]
    path = str(tmp_path / "packed")
    packing.write(documents(spark, rows), path, PATH, end_id=2, file_tokens=50)
    assert len(list(Path(path).glob("part-*"))) > 4
    ids = packing.read(spark, path)
    assert ids.columns == ["doc_id", "start", "n_tokens", "ids"]
    got = ids.orderBy("start").collect()
    assert len(got) == len(rows)
    # Ascending ids, rows without one first; every row keeps its own ids; starts are running sums.
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    want = sorted((i or 0, [*whole(library, t), 2]) for i, t, _ in rows)
    assert sorted((r.doc_id or 0, r.ids) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    crc = {(r.start, r.ids_crc32) for r in packing.read(spark, path, digests=True).collect()}
    assert crc == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    # Random access over files.
    everything = [x for r in got for x in r.ids]
    for lo, hi in [(0, 3), (120, 131), (len(everything) - 2, len(everything) + 9), (77, 77)]:
        taken = packing.take(spark, path, lo, hi).orderBy("position").collect()
        assert [(r.position, r.id) for r in taken] == list(enumerate(everything))[lo:hi]


def test_empty_table_and_other_ids(spark, tmp_path):
    packing.write(documents(spark, []), str(tmp_path / "none"), PATH, end_id=2)
    assert packing.read(spark, str(tmp_path / "none")).count() == 0
    named = spark.createDataFrame([("b", "two words"), ("a", None)], "doc_id string, text string")
    packing.write(named, str(tmp_path / "named"), PATH)
    got = packing.read(spark, str(tmp_path / "named"), "string").orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [("a", 0, 0), ("b", 0, 2)]


def test_words_of_a_run_are_looked_up_once(library, monkeypatch):
    """What is remembered is asked for once for each different word of a run, not for each occurrence."""

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    words, text = packing.Words(library.to_str()), "one two three " * 500 + "w" * 100
    words.young = Counted()
    column = pa.array([text, text])
    for _ in range(2):
        Counted.asked = 0
        (run,) = packing.pieces(column, 1 << 20)
        got = words.encode(*run[2:])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole(library, text)] * 2
        assert 0 < Counted.asked <= 8 and len(words.young) == 3
