import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, SF, documents
from tidemark.llm import alignment
from tidemark.session import stage

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Whole texts through both libraries, and alignments by comparing byte ranges."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        # The usual byte-level alphabet.
        bs = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        cs, n = bs[:], 0
        for x in range(256):
            if x not in bs:
                bs.append(x)
                cs.append(256 + n)
                n += 1
        self.byte = {chr(c): b for b, c in zip(bs, cs)}

    def tokens(self, text):
        if not text:
            return [], []
        raw = (" " + text).encode()
        e = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in e.ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return [], []
        return a, b

    def aligned(self, text):
        a, b = self.tokens(text)

        def spans(tokens):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out

        a, b = spans(a), spans(b)
        links, j = [], 0
        for x, (i, lo, hi) in enumerate(a):
            while j and b[j - 1][2] > lo:
                j -= 1
            while j < len(b) and b[j][1] < hi:
                if b[j][2] > lo:
                    links.append((x, j, min(hi, b[j][2]) - max(lo, b[j][1]), i, b[j][0]))
                j += 1
        both = sorted({hi for *_, hi in a} & {hi for *_, hi in b})
        groups, lo = [], 0
        for hi in both:
            groups.append(
                ",".join(str(i) for i, s, _ in a if lo <= s < hi) + "|" + ",".join(str(i) for i, s, _ in b if lo <= s < hi)
            ) if len(a) < 2000 else groups.append("")
            lo = hi
        return a, b, links, groups


def expected(plain, rows):
    made = [(i, *plain.aligned(t)) for i, t, *_ in rows]
    count = Counter((x[3], x[4]) for _, _, _, links, _ in made for x in links)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    return [
        (
            i or 0,
            len(a),
            len(b),
            len(groups),
            len(links),
            sum(count[x[3], x[4]] == top[x[4]] for x in links),
            sum(count[x[3], x[4]] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
        )
        for i, a, b, links, groups in made
    ]


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def pair():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        return alignment.Pair(f.read(), g.read())


def random_texts(n):
    rnd = random.Random(5)
    parts = ["a", "the", "Ing", "'s", "'re", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "　", "́", "é", "漢字", "🙂", "<|endoftext|>", "<s>", "<0x41>", "!", "12", "\r\n", "­", "ﬁ", "\x00", "ß"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(n)]
    return texts + ["x▁y z", "▁", " ", "  ", "\n", " a", "a ", " a  b "]


def test_words_are_encoded_as_in_the_text(plain, pair):
    assert pair.closed
    for text in random_texts(4000):
        found = pair.encode(pair.words(text))
        a, b = plain.tokens(text)
        if None in found or not text:
            assert not a, repr(text)
        else:
            assert [i for x in found for i in x[0]] == [i for i, _ in a], repr(text)
            assert [i for x in found for i in x[1]] == [i for i, _ in b], repr(text)


def test_all_words_at_once(plain, pair):
    """One text for all words that allow it; the odd ones among them are found."""
    assert pair.marked
    words = sorted({w for t in random_texts(3000) for w in pair.words(t)} | {"word" + m for m in (".", "...", "?!,", ";")})
    a, b, a_at, b_at, which = pair.encode_all(words)
    alone = pair.encode(words)
    assert set(which.tolist()) == {k for k, x in enumerate(alone) if x is not None} and len(set(which.tolist())) == len(which)
    for j, k in enumerate(which.tolist()):
        assert (a[a_at[j] : a_at[j + 1]].tolist(), b[b_at[j] : b_at[j + 1]].tolist()) == alone[k]


def dense(m):
    out = np.zeros((len(m.at) - 1, m.width), np.int64)
    np.add.at(out, (m.rows, m.columns), m.values)
    return out


def test_products_like_dense_matrices():
    rnd = np.random.default_rng(7)
    for _ in range(200):
        n, m, k = rnd.integers(1, 9, 3)
        x, y = rnd.integers(0, 3, (n, m)), rnd.integers(0, 3, (m, k))

        def csr(z):
            rows, columns = np.nonzero(z)
            at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(z)))])
            return alignment.Csr(at, columns, z[rows, columns], z.shape[1])

        got = alignment.product(csr(x), csr(y))
        assert (dense(got) == x @ y).all()
        assert (dense(csr(x).transposed()) == x.T).all()


def test_links_and_groups_of_columns(spark, plain):
    texts = [t for _, t, _ in ODD if not t or len(t) < 5000] + random_texts(300)
    docs = documents(spark, [(k, t, "en") for k, t in enumerate(texts)]).withColumnRenamed("kept", "links")
    path = alignment.load(spark, A, B)
    got = alignment.align(docs, path)
    assert got.columns == [*docs.columns, "a_ids", "b_ids", "links_", "groups"]
    for r in got.collect():
        a, b, links, groups = plain.aligned(r.text)
        assert r.a_ids == [x[0] for x in a] and r.b_ids == [x[0] for x in b]
        assert [tuple(x) for x in r.links_] == [x[:3] for x in links]
        made = [
            ",".join(map(str, r.a_ids[g.a : g.a + g.n_a])) + "|" + ",".join(map(str, r.b_ids[g.b : g.b + g.n_b]))
            for g in r.groups
        ]
        assert made == groups
        if a:
            shared = alignment.group_links(np.array([x[2] - x[1] for x in a]), np.array([x[2] - x[1] for x in b]))
            assert len(shared.columns) == sum(g.n_a * g.n_b for g in r.groups)
            assert shared.columns[: r.groups[0].n_b].tolist() == list(range(r.groups[0].n_b))


@pytest.mark.parametrize("table", [1 << 20, 40, 0])
def test_digests_like_the_definition(spark, plain, table, monkeypatch):
    """With all pairs broadcast, some, and none; the rest is joined."""
    rows = [r for r in ODD if not r[1] or len(r[1]) < 5000]
    rows += [(200 + k, t, "en") for k, t in enumerate(random_texts(60))]
    docs, held = documents(spark, rows), alignment.load(spark, A, B)
    encoded = stage(alignment.encode(docs, held), "test")
    counts = alignment.count_pairs(encoded, held, most=table)
    assert (counts.least == 0) == (table > 10_000)
    got = [(r.doc_id or 0, *tuple(r)[1:]) for r in alignment.digests(encoded, counts).collect()]
    assert sorted(got) == sorted(expected(plain, rows))


def test_given_documents(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = alignment.load(spark, A, B)
    encoded = stage(alignment.encode(docs, held), "test")
    got = {r.doc_id: tuple(r)[1:7] for r in alignment.digests(encoded, alignment.count_pairs(encoded, held)).collect()}
    assert got == {x[0]: x[1:7] for x in expected(plain, rows)}


def test_memory_and_empty_table(spark, pair, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 3)
    alone = {w: alignment.align_words(pair, [w]).groups[0] for w in ["one", "two.", "three", "four", "five!?", "six", "x" * 200]}
    memory = alignment.Memory(
        lambda new: alignment.align_words(pair, new).groups, lambda x, y: x + b";" + y, lambda x, y: x[len(y) + 1 :]
    )
    for words in (["one", "two.", "three", "four"], ["one", "five!?", "x" * 200], ["two.", "six"]):
        long = memory.learn(set(words))
        assert all(memory.young[w] == alone[w] for w in words)
        memory.forget(long)
        assert "x" * 200 not in memory.young
    monkeypatch.undo()
    docs, held = documents(spark, []), alignment.load(spark, A, B)
    encoded = stage(alignment.encode(docs, held), "test")
    assert alignment.digests(encoded, alignment.count_pairs(encoded, held)).count() == 0
    assert alignment.align(docs, held).count() == 0
