"""Alignment of two tokenizers against whole texts encoded by the libraries and groups cut by byte offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from conftest import docs, words
from tokenizers import Tokenizer

from veritab.llm import alignment
from veritab.llm.common import table
from veritab.llm.queries import op12_dangling_suffixes, tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", "\n\n a", "  two  spaces ", "Don't stop 'til you've it's", "naïve café £5 №7", "日本語 の テキスト", "a\tb\r\nc \r\n d\r e", "<|endoftext|> x <s> </s> <unk> <0x0A>", "x" * 3000, " x", "été été 12 3.14 a1b2",
       "…—“q” ‘a’", "🙂 ok 🙂🙂 👩‍👩‍👧", "a\u00a0b \u00a0 c\u3000 d\u2003 e\u2028 f\x85 g\x1c h", "İstanbul ſ ß", "tab\tend ", "end\n ", "\x00\x1f \x7f z", "a▁b ▁ c", "▁", "ÀÉÎ öü × ÷ ф ы", "a" * 77 + " " + "a" * 50, "1,000.50% (a) [b] {c};\r\n\tif x:\r"]


@pytest.fixture(scope="module")
def plain():
    """n_a, n_b, groups of a text: tokens of the whole text, cut where both end at one byte."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()
    spell = {i: bytes(letters[c] for c in p) for p, i in library.get_vocab().items() if all(c in letters for c in p)}

    def piece(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        whole = b" " + text.encode()
        a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        sides = []
        for ids, bytes_of in ((a, spell.__getitem__), (b, piece)):
            parts = [bytes_of(i) for i in ids]
            if b"".join(parts) != whole:
                return []
            at, ends = 0, []
            for p in parts:
                at += len(p)
                ends.append(at)
            sides.append((ids, ends))
        both = sorted(set(sides[0][1]) & set(sides[1][1]))
        return [tuple([i for i, e in zip(ids, ends) if lo < e <= hi] for ids, ends in sides) for lo, hi in zip([0, *both], both)]

    return groups


def said(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(rows, groups):
    per = [(i, groups(t)) for i, t in rows]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in per]
    count = Counter(p for c in linked for p in c)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [
        (i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(said(g).encode()).hexdigest() if g else "")
        for (i, g), c in zip(per, linked)
    ]


def test_groups_of_odd_texts(spark, plain):
    rng = random.Random(6)
    mixed = ["".join(rng.choice("ab é'\n\t .,1▁日🙂\u00a0\u3000\r") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = list(enumerate([*ODD, *mixed, words(rng, 500)]))
    got = {r.doc_id: r.groups for r in alignment.groups(docs(spark, rows), A, B).collect()}
    assert got == {i: said(plain(t)) for i, t in rows}


def test_counts_over_a_corpus(spark, plain, monkeypatch):
    rng = random.Random(7)
    rows = [*enumerate([*ODD, *(words(rng, rng.randint(1, 60)) for _ in range(40))]), (3, "a repeated id"), (None, "no id"), (500, None), (501, "same text"), (502, "same text")]
    want = expected(rows, plain)
    got = alignment.count_links(docs(spark, rows).repartition(3), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert alignment.count_links(docs(spark, []), A, B).count() == 0


def test_words_are_forgotten_and_learned_again(plain, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    k, rng = alignment.Words(A, B), random.Random(8)
    for _ in range(6):
        texts = [words(rng, 30), "one word"]
        assert alignment.spelled(k, [t.encode() for t in texts])[3] == [said(plain(t)).encode() for t in texts]
    assert len(k.said) < 70


def test_long_words_and_large_groups(plain, monkeypatch):
    texts = ["x" * 3000, "ab" * 700 + " c", "日本語" * 200, "word " * 50]
    for long, small in ((5, 1), (10_000, 10_000)):
        monkeypatch.setattr(alignment, "LONG", long)
        monkeypatch.setattr(alignment, "SMALL", small)
        k = alignment.Words(A, B)
        assert alignment.spelled(k, [t.encode() for t in texts])[3] == [said(plain(t)).encode() for t in texts]
        begin, counts, slots, _ = alignment.spelled(k, [t.encode() for t in texts])
        for t, lo, n in zip(texts, begin, counts):
            links = Counter()
            for w in slots[lo : lo + n]:
                for p, m in zip(k.pairs[k.first[w] : k.first[w + 1]].tolist(), k.times[k.first[w] : k.first[w + 1]].tolist()):
                    links[p >> 32, p & 0xFFFFFFFF] += m
            assert links == Counter((x, y) for a, b in plain(t) for x in a for y in b)


def test_transducer():
    t = alignment.Transducer({1: b"ab", 2: b"c", 3: b"abc"}, {1: b"a", 2: b"bc", 3: b"abcab", 4: b"x"})
    assert t.groups([1, 2, 3], [1, 2, 1, 2]) == [(2, 2), (3, 4)]
    assert t.groups([3, 1], [3]) == [(2, 1)]
    assert t.groups([1], [4]) is None and t.groups([1], [1]) is None and t.groups([], [1]) is None and t.groups([], []) == []
    many = [([1, 2, 3], [1, 2, 1, 2]), ([3, 1], [3]), ([1], [4]), ([1], [1]), ([], [1]), ([], []), ([1, 2], [1, 2])]
    flat = lambda side: (np.array([x for p in many for x in p[side]], np.int64), np.array([len(p[side]) for p in many], np.int64))
    word, i, j, good = t.groups_of_many(*flat(0), *flat(1))
    assert [[(x, y) for w, x, y in zip(word, i, j) if w == k] if good[k] else None for k in range(len(many))] == [t.groups(*p) for p in many]
    before = len(t.states)
    assert t.groups([1, 2] * 50, [1, 2] * 50)[-1] == (100, 100) and len(t.states) == before  # transitions are remembered


def test_query(spark, sf_dir, plain):
    rows = [(d.doc_id, d.text) for d in table(spark, sf_dir, "documents").collect()]
    assert sorted(map(tuple, op12_dangling_suffixes(spark, sf_dir).collect())) == sorted(expected(rows, plain))
