"""Token counts and the token store against the tokenizers library, text by text."""

import zlib

import numpy as np
import pytest
from conftest import docs, words  # noqa: F401
from tokenizers import Tokenizer

from veritab.llm import token_cache, token_store
from veritab.llm.pieces import PieceEncoder, ignores_outer_space
from veritab.llm.queries import tokenizer_file

ODD = ["", " ", "\n\n", "  two  spaces ", "Don't stop", "naïve café £5 №7", "日本語のテキスト", "a\tb\r\nc", "<|endoftext|> x <|startoftext|>", "x" * 5000, "été été 12 3.14 a1b2", "…—“q”", "🙂 ok", "A B", "İstanbul ſ ß", "tab\tend ", "end\n", "1,000.50%", "\x00\x1f", "ÀÉÎ öü × ÷"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_the_library(rng, name):
    library = Tokenizer.from_file(tokenizer_file(name))
    texts = [*ODD, *(words(rng, rng.randint(1, 60)) for _ in range(30)), "".join(rng.choice("ab .,\n\t1é'!") for _ in range(3000))]
    flat, counts = PieceEncoder(tokenizer_file(name)).encode([t.encode() for t in texts])
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert flat.tolist() == [x for w in want for x in w]


def test_pieces_that_collide_under_polynomial_hashes(thue_morse):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(tokenizer_file(name))
        texts = [*thue_morse(2048), " ".join(thue_morse(1024))]
        flat, _ = PieceEncoder(tokenizer_file(name)).encode([t.encode() for t in texts])
        assert flat.tolist() == [x for t in texts for x in library.encode(t, add_special_tokens=False).ids]


def test_a_tokenizer_of_another_kind_gets_whole_texts(tmp_path):
    """One that merges across white space and one with another cutter: no cuts are assumed."""
    from tokenizers import Tokenizer as T, models, pre_tokenizers

    t = T(models.BPE(vocab={"a": 0, "b": 1, " ": 2, "a b": 3, "a ": 4}, merges=[("a", " "), ("a ", "b")]))
    t.save(str(tmp_path / "plain.json"))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    t.save(str(tmp_path / "meta.json"))
    for name in ("plain.json", "meta.json"):
        e = PieceEncoder(str(tmp_path / name))
        assert not e.known_cuts and not ignores_outer_space(str(tmp_path / name))
        library = T.from_file(str(tmp_path / name))
        flat, counts = e.encode([b"a b", b"ba  b", b""])
        assert flat.tolist() == [x for s in ("a b", "ba  b", "") for x in library.encode(s).ids] and counts[2] == 0


def test_outer_white_space_counts_where_the_tokenizer_keeps_it(spark, tmp_path):
    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(["  hello  ", "hello", "\n\n", "hello\n"])]
    got = {r.doc_id: r.n_tokens for r in token_cache.count(docs(spark, rows), str(tmp_path / "c"), path).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_counts_come_from_the_cache(spark, rng, tmp_path):
    path, cache = tokenizer_file("word_bpe_49k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate([*ODD, *ODD, words(rng, 3000)])] + [(None, "no id"), (99, None)]
    got = token_cache.count(docs(spark, rows), cache, path).collect()
    want = sorted((i if i is not None else -1, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    stored = token_cache.read_cache(spark, cache).count()
    token_cache.count(docs(spark, rows[:10]), cache, path)
    assert token_cache.read_cache(spark, cache).count() == stored  # nothing was missing
    # what the cache says is what is returned: a text it knows isn't encoded again
    one = str(tmp_path / "one")
    spark.createDataFrame([(token_cache.tokenizer_digest(path), __import__("hashlib").sha256(b"known").hexdigest(), 77)], token_cache.SCHEMA).write.parquet(one)
    assert token_cache.count(docs(spark, [(1, "known")]), one, path).first().n_tokens == 77
    assert token_cache.count(docs(spark, []), str(tmp_path / "empty"), path).count() == 0


def test_elias_fano_round_trip(rng):
    for n in (1, 2, 63, 64, 65, 1000):
        for top in (0, 1, 7, 100_000):
            b = np.sort(np.array([rng.randint(0, top) for _ in range(n)], np.int64))
            low_bits, low, high = token_store.encode_boundaries(b)
            e = token_store.Boundaries(n, low_bits, low, high)
            assert e.all().tolist() == b.tolist()
            assert [e.select(i) for i in range(n)] == b.tolist()
            assert len(low) + len(high) <= n * (2 + max(0, int(top / n).bit_length())) / 8 + top / 4 + 3 if top <= n else True
    dense = np.arange(0, 1 << 20, 500)
    low_bits, low, high = token_store.encode_boundaries(dense)
    assert 8 * (len(low) + len(high)) / len(dense) < 2.1 + np.log2(500)


def test_store_reads_back_what_was_written(spark, rng, tmp_path):
    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i * 3 % 61, t) for i, t in enumerate([*ODD, *(words(rng, rng.randint(1, 50)) for _ in range(40))])] + [(7000, None), (7000, "again"), (None, "first")]
    token_store.write(docs(spark, rows), str(tmp_path / "store"), path, end_id=2, shard_ids=500)
    got = token_store.read(spark, str(tmp_path / "store")).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == sorted((i or -1, crc(t)) for i, t in rows)
    # another order, and the shuffled join for stores of very many shards
    token_store.write(docs(spark, rows), str(tmp_path / "mixed"), path, end_id=2, order=["source", "text"], shard_ids=500)
    token_store.BROADCAST_SHARDS, before = 0, token_store.BROADCAST_SHARDS
    try:
        mixed = sorted(token_store.read(spark, str(tmp_path / "mixed")).collect(), key=lambda r: r.start)
    finally:
        token_store.BROADCAST_SHARDS = before
    want = docs(spark, rows).orderBy("source", "text").select("doc_id").collect()
    assert [r.doc_id for r in mixed] == [r.doc_id for r in want] and sorted(r.ids_crc32 for r in mixed) == sorted(r.ids_crc32 for r in got)
    assert token_store.id_width(path, 2) == 2 and token_store.id_width(path, 70_000) == 4
    token_store.write(docs(spark, []), str(tmp_path / "none"), path, end_id=2)
    assert token_store.read(spark, str(tmp_path / "none")).count() == 0
