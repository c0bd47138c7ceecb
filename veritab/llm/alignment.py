"""Alignment of two tokenizers' tokens, and how often their ids are linked over a corpus.

A text, with a space before it, is cut by tokenizer A and by tokenizer B (which adds that space itself). Where tokens of
both end at the same byte, a group closes; every A token of a group is linked to every B token of it.

`Transducer` reads both token sequences as one: its state is the side that leads and the bytes by which it leads. At an
empty residual A reads its next token, otherwise the side that is behind; the new residual is what then dangles. A state
and a token lead to one state, which is remembered, so that bytes are compared once for each transition ever met. An
empty residual closes a group; a mismatch or a residual at the end means that the sides spell different bytes.

Words. Before a space or newline that follows no white space and precedes a letter or sign, neither tokenizer joins: A's
pattern begins a piece there, and no piece of B has a space after something else, or a newline; nor do they join an ASCII
letter and the sign after it, which no piece of B has (both are read from the files;
without that a text is one word). So tokens and groups of a text are those of its words one after another, and a worker
aligns each distinct word once. After `REMEMBERED` words it keeps those that came in several chunks only.

Counts over the corpus. A chunk of documents is one row: its distinct linked pairs with the number of its documents that
hold each, and for its documents what they consist of. Pairs are counted by shuffle, one row a chunk and pair, and come back
to each chunk as one list, no longer than the chunk's own pairs; so a pair that all documents hold is one row a chunk, and
no table of all pairs is held anywhere. Chunks are written to the shared folder between the two.

Nulls: a null or empty text has no tokens; neither has one whose tokens don't spell it (B's normalisation, U+2581 in the
text): zeros and no groups. A null doc_id stays a row. Repeated rows are documents of their own. Other columns are not
read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from .common import cut, map_arrow, runs
from .pieces import cuts_as_known
from .textstats import utf8

#: Bytes of text in a chunk.
CHUNK = 1 << 20
#: Distinct words, and their bytes, after which a worker starts afresh.
REMEMBERED = 100_000
REMEMBERED_BYTES = 1 << 24
#: Words that are learned at once; the tokens from which a word is read by itself; links of a group up to which they are listed singly.
SLICE = 10_000
LONG = 200
SMALL = 64
SPACE = "▁"
#: A letter with a sign after it, where both tokenizers cut.
LETTER_SIGN = re.compile(r"[A-Za-z][!-/:-@\[-`{-~]")
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteSide:
    """A byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.cuts_at_spaces = cuts_as_known(path)
        letters = byte_letters()
        self.bytes: dict[int, bytes] = {}
        for piece, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        e = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(e.ids, np.int64), np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))


class PieceSide:
    """A sentencepiece model that adds a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in zip(ids, pieces)}
        # no piece goes on over a space, a newline, or from a letter to a sign; and spaces are kept as they are
        own = [p for i, p in zip(ids, pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        whole = all(SPACE not in p.lstrip(SPACE) and "\n" not in p and not LETTER_SIGN.search(p) for p in own)
        self.cuts_at_spaces = whole and self.model.decode(self.model.encode("a  b ")) == "a  b "

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words. The space that a word begins with is left to the model; a newline stands alone after that space, so
        words that begin otherwise are encoded behind one."""
        extra = [0 if w[0] == " " else 1 if w[0] == "\n" else 2 for w in words]
        ids = self.model.encode([(w[1:], w, "\n" + w)[n] for w, n in zip(words, extra)], num_threads=1)
        ids = [x[n:] if n else x for x, n in zip(ids, extra)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


class Transducer:
    """Closes groups of two token sequences that spell the same bytes."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes]):
        self.bytes = (a, b)
        self.states: list[tuple[int, bytes]] = [(1, b"")]  # the side that leads, and by which bytes; at the empty residual A reads next
        self.number = {(1, b""): 0}
        self.next: list[dict[int, int]] = [{}]
        self.keys, self.to = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the same transitions, sorted by state and token
        self.reads_a = np.ones(1, bool)

    def _step(self, state: int, token: int) -> int:
        """The state after the side that is behind reads a token; -1 if the bytes differ."""
        lead, residual = self.states[state]
        piece = self.bytes[1 - lead][token]
        if residual.startswith(piece):
            key = (lead, residual[len(piece) :])
        elif piece.startswith(residual):
            key = (1 - lead, piece[len(residual) :])
        else:
            key = None
        if key and not key[1]:
            key = (1, b"")
        to = -1 if key is None else self.number.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
            self.next.append({})
        self.next[state][token] = to
        return to

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """How many tokens of each are read where groups close; None if the sides spell different bytes."""
        i = j = state = 0
        out = []
        while i < len(a) or j < len(b):
            if self.states[state][0]:
                if i == len(a):
                    return None
                token = a[i]
                i += 1
            else:
                if j == len(b):
                    return None
                token = b[j]
                j += 1
            to = self.next[state].get(token)
            state = self._step(state, token) if to is None else to
            if state < 0:
                return None
            if not state:
                out.append((i, j))
        return None if state else out

    def groups_of_many(self, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """`groups` of many words at once, step by step for all of them: (word, tokens of A read, of B read) of each closed group,
        and which words the sides spell alike."""
        at_a, at_b = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
        n = len(a_size)
        i, j, state, good = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        closed, active = [], np.flatnonzero(a_size + b_size > 0)
        while len(active):
            from_a = self.reads_a[state[active]]
            ready = np.where(from_a, i[active] < a_size[active], j[active] < b_size[active])
            good[active[~ready]] = False
            active, from_a = active[ready], from_a[ready]
            token = np.zeros(len(active), np.int64)
            token[from_a] = a[(at_a + i)[active[from_a]]]
            token[~from_a] = b[(at_b + j)[active[~from_a]]]
            i[active] += from_a
            j[active] += ~from_a
            to = self._steps(state[active], token)
            good[active[to < 0]] = False
            active, to = active[to >= 0], to[to >= 0]
            state[active] = to
            done = active[to == 0]
            closed.append((done, i[done], j[done]))
            active = active[(to != 0) | (i[active] < a_size[active]) | (j[active] < b_size[active])]
        word, i, j = (np.concatenate([np.zeros(0, np.int64), *(c[k] for c in closed)]) for k in range(3))
        kept = np.flatnonzero(good[word])
        order = kept[np.argsort(word[kept], kind="stable")]
        return word[order], i[order], j[order], good

    def _steps(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The states after these states read these tokens, from the sorted table of the transitions met."""
        key = state << 32 | token
        place = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == key[inside]
        if not known.all():
            new = np.array(sorted(set(key[~known].tolist())), np.int64)
            to = [self.next[k >> 32].get(k & 0xFFFFFFFF) for k in new.tolist()]
            to = [self._step(k >> 32, k & 0xFFFFFFFF) if t is None else t for k, t in zip(new.tolist(), to)]
            where = np.searchsorted(self.keys, new)
            self.keys, self.to = np.insert(self.keys, where, new), np.insert(self.to, where, to)
            self.reads_a = np.array([lead == 1 for lead, _ in self.states])
            place = np.searchsorted(self.keys, key)
        return self.to[place]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each row, size numbers long."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of values, which may be empty."""
    total, end = np.concatenate([[0], np.cumsum(values, dtype=np.int64)]), np.cumsum(sizes)
    return total[end] - total[end - sizes]


class Pool:
    """Byte strings by number, one after another."""

    def __init__(self, strings: dict[int, bytes]):
        every = [strings.get(i, b"") for i in range(1 + max(strings))]
        self.bytes = np.frombuffer(b"".join(every), np.uint8)
        self.size = np.array([len(x) for x in every], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def spells(self, ids: np.ndarray, counts: np.ndarray, text: bytes, lengths: np.ndarray) -> np.ndarray:
        """Which stretches of ids, `counts` long, spell their stretch of a text, `lengths` long."""
        good = sums(self.size[ids], counts) == lengths
        own, ids = np.frombuffer(text, np.uint8)[np.repeat(good, lengths)], ids[np.repeat(good, counts)]
        wrong = self.bytes[spread(self.at[ids], self.size[ids])] != own
        good[good] = sums(wrong, lengths[good]) == 0
        return good

    def write(self, ids: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of ids with their last byte replaced, and the size of each."""
        size = self.size[ids]
        out = self.bytes[spread(self.at[ids], size)]
        out[np.cumsum(size) - 1] = last
        return out.tobytes(), size


class Words:
    """What a worker knows of words: their tokens, groups and links, as rows of arrays."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteSide(a_path), PieceSide(b_path)
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.a_spelling = Pool(self.a.bytes)
        self.digits = Pool({i: f"{i},".encode() for i in range(1 + max([*self.a.bytes, *self.b.bytes]))})
        self.cuts = self.a.cuts_at_spaces and self.b.cuts_at_spaces
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.met = np.zeros(0, np.int32)  # in how many chunks
        self.held_bytes = 0
        self.said: list[bytes | None] = []  # the groups as text; None where the sides spell different bytes
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.first = np.zeros(1, np.int64)  # where the pairs of a word begin
        self.pairs = np.zeros(0, np.int64)  # a << 32 | b
        self.times = np.zeros(0, np.int64)

    def keep_frequent(self) -> None:
        """Forgets the words that were met in one chunk only, or all if the others alone are too many."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > REMEMBERED // 2 or self.held_bytes > REMEMBERED_BYTES:
            return self.forget()
        new = np.full(len(self.said), -1, np.int64)
        new[kept] = np.arange(len(kept))
        self.slot = {w: n for w, n in zip(self.slot, new[np.fromiter(self.slot.values(), np.int64, len(self.slot))].tolist()) if n >= 0}
        self.held_bytes = sum(map(len, self.slot))
        self.said = [self.said[x] for x in kept.tolist()]
        size = (self.first[1:] - self.first[:-1])[kept]
        place = spread(self.first[kept], size)
        self.sizes, self.met, self.first = self.sizes[kept], np.ones(len(kept), np.int32), np.append(0, np.cumsum(size))
        self.pairs, self.times = self.pairs[place], self.times[place]

    def learn(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), SLICE):
            self._learn(words[lo : lo + SLICE])

    def _closed(self, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """groups_of_many; words of very many tokens are read one by one."""
        long = np.flatnonzero(a_size + b_size > LONG)
        few = np.where(a_size + b_size > LONG, 0, 1)
        word, i, j, good = self.transducer.groups_of_many(a[np.repeat(few, a_size) > 0], a_size * few, b[np.repeat(few, b_size) > 0], b_size * few)
        more = []
        for w in long.tolist():
            x, y = int(a_size[:w].sum()), int(b_size[:w].sum())
            closed = self.transducer.groups(a[x : x + int(a_size[w])].tolist(), b[y : y + int(b_size[w])].tolist())
            good[w] = closed is not None
            more += [(w, k, m) for k, m in closed or ()]
        if more:
            word, i, j = (np.concatenate([x, y]) for x, y in zip((word, i, j), np.array(more, np.int64).T))
            order = np.argsort(word, kind="stable")
            word, i, j = word[order], i[order], j[order]
        return word, i, j, good

    def _learn(self, words: list[bytes]) -> None:
        spelled = [w.decode() for w in words]
        (a, a_size), (b, b_size) = self.a.encode(spelled), self.b.encode(spelled)
        word, i, j, good = self._closed(a, a_size, b, b_size)
        length = np.fromiter(map(len, words), np.int64, len(words))
        good &= self.a_spelling.spells(a, a_size, b"".join(words), length)
        own = good[word]
        word, i, j = word[own], i[own], j[own]
        a, b = a[np.repeat(good, a_size)], b[np.repeat(good, b_size)]
        a_size, b_size = a_size * good, b_size * good
        # groups: how many tokens each has, and where they begin
        first = np.ones(len(word), bool)
        first[1:] = word[1:] != word[:-1]
        n_a, n_b = (x - np.where(first, 0, np.append(0, x[:-1])) for x in (i, j))
        at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        per_word = np.bincount(word, minlength=len(words))
        # what they say
        place_a = np.arange(len(a)) + np.repeat(at_b, n_a)
        place_b = np.arange(len(b)) + np.repeat(at_a + n_a, n_b)
        token, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        token[place_a], token[place_b] = a, b
        mark[at_a + at_b + n_a - 1] = ord("|")
        mark[at_a + at_b + n_a + n_b - 1] = ord(";")
        said, size = self.digits.write(token, mark)
        cuts = [0, *np.cumsum(sums(size, a_size + b_size)).tolist()]
        # whom they link: pairs of small groups as they come, those of large ones by distinct ids
        links = n_a * n_b
        small = np.flatnonzero(links <= SMALL)
        count = links[small]
        within, group = spread(np.zeros(len(small), np.int64), count), np.repeat(small, count)
        pairs = a[at_a[group] + within // n_b[group]] << 32 | b[at_b[group] + within % n_b[group]]
        of, times = word[group], np.ones(len(pairs), np.int64)
        large = [(word[g], x << 32 | y, n * m) for g in np.flatnonzero(links > SMALL).tolist()
                 for x, n in Counter(a[at_a[g] : at_a[g] + n_a[g]].tolist()).items() for y, m in Counter(b[at_b[g] : at_b[g] + n_b[g]].tolist()).items()]
        if large:
            of, pairs, times = (np.concatenate([x, y]) for x, y in zip((of, pairs, times), np.array(large, np.int64).T))
            order = np.argsort(of, kind="stable")
            of, pairs, times = of[order], pairs[order], times[order]
        self.slot.update(zip(words, range(len(self.said), len(self.said) + len(words))))
        self.held_bytes += int(length.sum())
        self.said += [said[x : y - 1] if ok else None for x, y, ok in zip(cuts, cuts[1:], good.tolist())]
        self.sizes = np.concatenate([self.sizes, np.stack([a_size, b_size, per_word, sums(links, per_word)], axis=1)])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(np.bincount(of, minlength=len(words))))
        self.pairs, self.times = np.append(self.pairs, pairs), np.append(self.times, times)

    def split(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The words of texts, each text with a space before it, and how many each text has; an empty text has none."""
        raw = b"".join(b" " + t for t in texts if t)
        buf = np.frombuffer(raw, np.uint8)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        begin = (np.cumsum(lengths) - lengths)[lengths > 0]
        mark = np.zeros(len(buf), bool)
        if self.cuts:
            # neither white space nor U+2581 (whose last byte is 0x81) before the space; no white space of any script after it
            solid = (buf > 0x20) & (buf < 0x7F) | (buf >= 0xC3) & ~np.isin(buf, (0xE1, 0xE2, 0xE3))
            closed = (buf > 0x20) & (buf != 0x81) & (buf != 0x7F)
            mark[1:-1] = ((buf[1:-1] == 0x20) | (buf[1:-1] == 0x0A)) & solid[2:] & closed[:-2]
            mark[1:] |= _SIGN[buf[1:]] & _LETTER[buf[:-1]]
        mark[begin] = True
        at = np.flatnonzero(mark)
        counts = np.zeros(len(texts), np.int64)
        counts[lengths > 0] = np.diff(np.append(np.searchsorted(at, begin), len(at)))
        at = [*at.tolist(), len(raw)]
        return [raw[x:y] for x, y in zip(at, at[1:])], counts

    def slots(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.slot.get, words))
        if None in found:
            if len(self.said) > REMEMBERED or self.held_bytes > REMEMBERED_BYTES:
                self.keep_frequent()
                found = list(map(self.slot.get, words))
            new = [w for w, x in zip(words, found) if x is None]
            self.learn(list(dict.fromkeys(new)))
            later = map(self.slot.__getitem__, new)
            found = [next(later) if x is None else x for x in found]
        found = np.array(found, np.int64)
        self.met = np.append(self.met, np.zeros(len(self.said) - len(self.met), np.int32))
        self.met += np.bincount(found, minlength=len(self.said)) > 0
        return found


_known: dict[tuple[str, str], Words] = {}


def known_words(a_path: str, b_path: str) -> Words:
    """This worker's words; they live on from task to task."""
    if (a_path, b_path) not in _known:
        _known[a_path, b_path] = Words(a_path, b_path)
    return _known[a_path, b_path]


def spelled(k: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of each text: where its words begin and how many count (none if any word's sides differ); the slots; the groups as text."""
    words, counts = k.split(texts)
    slots = k.slots(words)
    begin = np.cumsum(counts) - counts
    said = k.said
    texts_out = []
    for i, (lo, n) in enumerate(zip(begin.tolist(), counts.tolist())):
        parts = [said[x] for x in slots[lo : lo + n].tolist()]
        if None in parts:
            counts[i] = 0
            parts = []
        texts_out.append(b";".join(parts))
    return begin, counts, slots, texts_out


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and the groups of each text, as `a1,a2|b1;a3|b2,b3`: ids of A and of B in order."""

    def one(batch: pa.RecordBatch):
        texts = utf8(batch.column(1))
        for lo, hi in runs([len(t) for t in texts], CHUNK):
            said = spelled(known_words(a_path, b_path), texts[lo:hi])[3]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(said, pa.binary()).cast(pa.string())], names=["doc_id", "groups"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), one, "doc_id long, groups string")


CHUNKS = """chunk string, pairs array<bigint>, held array<int>, body binary,
            docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>>"""
#: The arrays in a chunk's body, in their order.
BODY = {"doc_words": "<i4", "words": "<i4", "word_times": "<i4", "word_pairs": "<i4", "links": "<i4", "link_times": "<i8"}


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays of a body one after another, compressed, behind their lengths and the size of it all."""
    raw = b"".join(arrays[name].astype(kind).tobytes() for name, kind in BODY.items())
    head = np.array([len(raw), *(len(arrays[name]) for name in BODY)], "<i8").tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(body: bytes) -> dict[str, np.ndarray]:
    size, *lengths = np.frombuffer(body, "<i8", 1 + len(BODY)).tolist()
    raw, at, out = pa.decompress(body[8 * (1 + len(BODY)) :], size, codec="zstd", asbytes=True), 0, {}
    for (name, kind), n in zip(BODY.items(), lengths):
        out[name] = np.frombuffer(raw, kind, n, at).astype(np.int64)
        at += n * np.dtype(kind).itemsize
    return out


def chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for about CHUNK bytes of texts. Of its body, doc_words says how many distinct words each document has, `words` (numbered
    in the chunk) and word_times which and how often; word_pairs, `links` (places in `pairs`) and link_times the same for words."""
    ship(docs.sparkSession)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi in runs(pc.binary_length(batch.column(1)).fill_null(0).to_pylist(), CHUNK):
                k = known_words(a_path, b_path)
                n = hi - lo
                begin, counts, slots, said = spelled(k, utf8(batch.column(1).slice(lo, n)))
                doc = np.repeat(np.arange(n), counts)
                slots = slots[spread(begin, counts)]
                own, place = np.unique(slots, return_inverse=True)
                entry, times = np.unique(doc * len(own) + place, return_counts=True)
                entry_doc, entry_word = np.divmod(entry, max(1, len(own)))
                doc_words = np.bincount(entry_doc, minlength=n)
                total = zip(*(sums(k.sizes[own, c][entry_word] * times, doc_words).tolist() for c in range(4)))
                size = (k.first[1:] - k.first[:-1])[own]
                at = spread(k.first[own], size)
                pairs, link = np.unique(k.pairs[at], return_inverse=True)
                offset = np.cumsum(size) - size
                seen = np.unique(np.repeat(entry_doc, size[entry_word]) * len(pairs) + link[spread(offset[entry_word], size[entry_word])])
                held = np.bincount(seen % max(1, len(pairs)), minlength=len(pairs))
                facts = [
                    {"doc_id": i, "n_a": a, "n_b": b, "n_groups": g, "n_links": m, "groups_sha256": hashlib.sha256(s).hexdigest() if a else ""}
                    for i, (a, b, g, m), s in zip(ids[lo:hi], total, said)
                ]
                body = pack({"doc_words": doc_words, "words": entry_word, "word_times": times, "word_pairs": size, "links": link, "link_times": k.times[at]})
                columns = [pa.array([f"{task}-{number}"]), pa.array([pairs]), pa.array([held.astype(np.int32)]), pa.array([body], pa.binary()), pa.array([facts], DOCS)]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "pairs", "held", "body", "docs"])
        known_words(a_path, b_path).forget()  # the worker may wait for long

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(one, CHUNKS)


DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents of all chunks that hold it linked), best (whether no pair of its A id has more)."""
    held = rows.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))
    held = held.withColumn("a", F.shiftright("pair", 32))
    most = held.groupBy("a").agg(F.max("n").alias("most"))
    return held.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def count_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    rows = cut(chunks(docs, a_path, b_path), "alignment-chunks")
    counts = cut(pair_counts(rows), "alignment-pairs")
    wanted = rows.select("chunk", F.posexplode("pairs").alias("i", "pair"))
    back = wanted.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("i", "n", "best")).alias("counts"))
    facts = rows.drop("pairs", "held").join(back, "chunk", "left")
    facts = facts.select("docs", "body", "counts.i", "counts.n", "counts.best")

    def one(batch: pa.RecordBatch):
        for r in range(batch.num_rows):
            got = lambda name: batch.column(name)[r].values  # noqa: B023, E731
            number = lambda name: np.zeros(0, np.int64) if got(name) is None else got(name).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            x, i = unpack(batch.column("body")[r].as_py()), number("i")
            n, best = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            n[i], best[i] = number("n"), number("best")
            of_word = lambda of_pair: sums(of_pair[x["links"]] * x["link_times"], x["word_pairs"])  # noqa: B023, E731
            count, most = (sums(of_word(c)[x["words"]] * x["word_times"], x["doc_words"]) for c in (n, best))
            known = got("docs").flatten()
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            columns = [*known[:5], pa.array(most), pa.array(count), known[5]]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_best", "count_sum", "groups_sha256"])

    return map_arrow(facts, one, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
