"""Token ids of whole texts, with repeated pieces encoded once.

Tokenizers of two public kinds first cut a text into letters, digits, other signs and white space (a space goes with
what follows), and never merge across those cuts; the tokenizer's file says which kind it is. A task therefore cuts the
texts of a chunk in numpy and asks the tokenizers library only for pieces it has not met. Pieces are told apart by
their bytes: up to eight of them are one number, longer ones are looked up as they are. Texts with anything whose class
could be seen differently (apostrophes, control characters, code points outside Latin letters, special token strings),
and all texts of a tokenizer of another kind, go to the library whole.
"""

from __future__ import annotations

import json

import numpy as np

from .textstats import LETTER, U

#: Pieces that a worker remembers before it starts afresh (about 25 bytes each).
REMEMBERED = 3_000_000
CHUNK = 1 << 21

_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 sign
_KIND[[9, 10, 13, 32]] = 0
_KIND[LETTER] = 1
_KIND[0x80:] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[0x7F] = _ODD[0xC2] = True
_ODD[[9, 10, 13]] = False
_ODD[ord("'")] = True
_ODD[0xC9:] = True


#: The pattern by which lower-casing tokenizers with word ends cut.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def steps_of(path: str) -> tuple[list[dict], list[dict]]:
    """The normalizers and pre-tokenizers that a tokenizer's file names, in their order."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)

    def flat(step: dict | None, name: str) -> list[dict]:
        if not step:
            return []
        return [x for part in step[name] for x in flat(part, name)] if step["type"] == "Sequence" else [step]

    return flat(file.get("normalizer"), "normalizers"), flat(file.get("pre_tokenizer"), "pretokenizers")


def cuts_as_known(path: str) -> bool:
    """Whether the tokenizer cuts texts as `cut` does, or finer at the same places whatever stands around."""
    normalizers, cutters = steps_of(path)
    kinds = [c["type"] for c in cutters]
    if kinds == ["ByteLevel"]:
        return not normalizers and cutters[0].get("use_regex", True) and not cutters[0].get("add_prefix_space")
    plain = all(n["type"] in ("NFC", "Lowercase") or (n["type"], n.get("pattern"), n.get("content")) == ("Replace", {"Regex": "\\s+"}, " ") for n in normalizers)
    split = kinds == ["Split", "ByteLevel"] and cutters[0].get("pattern") == {"Regex": WORD_PATTERN} and cutters[0].get("invert") and cutters[0].get("behavior") == "Removed"
    return bool(plain and split and not cutters[1].get("use_regex", True) and not cutters[1].get("add_prefix_space"))


def ignores_outer_space(path: str) -> bool:
    """Whether white space around a text makes no tokens: the cutter's pattern leaves it out."""
    return cuts_as_known(path) and steps_of(path)[1][0]["type"] == "Split"


def odd_texts(texts: list[bytes], buf: np.ndarray, starts: np.ndarray, specials: list[bytes]) -> np.ndarray:
    """Which texts must be encoded whole."""
    odd = _ODD[buf]
    odd[1:] |= (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
    out = np.logical_or.reduceat(odd, starts)
    for s in specials:
        if s in b"\n".join(texts):
            out |= np.array([s in t for t in texts])
    return out


def cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions where pieces begin. Each text is buf[start:end] and is followed by one newline."""
    kind = _KIND[buf]
    space = kind == 0
    first = np.ones(len(buf), bool)
    # after something else than white space: where the kind changes
    first[1:] = kind[1:] != kind[:-1]
    # in a run of white space the last one parts from the others, if anything follows in the text
    last = np.zeros(len(buf), bool)
    last[:-1] = space[:-1] & ~space[1:]
    tail = ends[(ends > starts)] - 1
    last[tail[space[tail]]] = False
    first |= last
    # a space goes with what follows it
    first[1:] &= ~((buf[:-1] == 32) & ~space[1:])
    first[starts] = True
    first[ends] = True
    return np.flatnonzero(first)


class PieceEncoder:
    """Ids of texts for one tokenizer file."""

    def __init__(self, path: str, kind: str = "<u4"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known_cuts = cuts_as_known(path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype(kind)
        self._forget()

    def _forget(self) -> None:
        self.short = np.zeros(0, U)  # pieces of up to 8 bytes as numbers, sorted, and their slots
        self.short_slot = np.zeros(0, np.int64)
        self.long: dict[bytes, int] = {}  # slots of the others
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by slot: where its ids begin in the pool, and how many there are
        self.pool = [np.zeros(0, self.kind)]

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes new pieces; their slots."""
        sizes = np.zeros(len(pieces), np.int64)
        words = [p.decode() for p in pieces]
        for lo in range(0, len(words), 20_000):
            e = self.tokenizer.encode(words[lo : lo + 20_000], is_pretokenized=True, add_special_tokens=False)
            self.pool.append(np.array(e.ids, self.kind))
            sizes[lo : lo + 20_000] = np.bincount(np.array(e.word_ids, np.int64), minlength=len(words[lo : lo + 20_000]))
        before, first = int(self.size.sum()), len(self.size)
        self.at = np.append(self.at, before + np.cumsum(sizes) - sizes)
        self.size = np.append(self.size, sizes)
        self.pool = [np.concatenate(self.pool)]
        return first + np.arange(len(pieces))

    def _short_slots(self, numbers: np.ndarray) -> np.ndarray:
        distinct, inverse = np.unique(numbers, return_inverse=True)
        found = np.searchsorted(self.short, distinct)
        known = np.zeros(len(distinct), bool)
        inside = found < len(self.short)
        known[inside] = self.short[found[inside]] == distinct[inside]
        new = distinct[~known]
        if len(new):
            slots = self._learn([int(x).to_bytes(8, "little").rstrip(b"\0") for x in new])
            self.short = np.insert(self.short, found[~known], new)
            self.short_slot = np.insert(self.short_slot, found[~known], slots)
            found = np.searchsorted(self.short, distinct)
        return self.short_slot[found][inverse]

    def _long_slots(self, pieces: list[bytes]) -> np.ndarray:
        slots = list(map(self.long.get, pieces))
        if None in slots:
            new = list(dict.fromkeys(p for p, slot in zip(pieces, slots) if slot is None))
            self.long.update(zip(new, self._learn(new).tolist()))
            slots = list(map(self.long.__getitem__, pieces))
        return np.array(slots, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if not self.known_cuts:
            ids = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.concatenate([*ids, np.zeros(0, self.kind)]), np.array([len(x) for x in ids], np.int64)
        if len(self.size) > REMEMBERED:
            self._forget()
        raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(raw, np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        odd = odd_texts(texts, buf, starts, self.specials)
        begin = cut(buf, starts, ends)
        doc = np.searchsorted(starts, begin, "right") - 1
        stop = np.append(begin[1:], len(buf))
        mine = ~odd[doc] & (begin < ends[doc])
        begin, stop, doc = begin[mine], stop[mine], doc[mine]
        # texts that are cut hold no zero byte, so that up to eight bytes of a piece are a number of its own
        length = stop - begin
        slots = np.zeros(len(begin), np.int64)
        eight = np.ndarray(len(buf), "<u8", raw + bytes(8), strides=(1,))
        few = np.flatnonzero(length <= 8)
        slots[few] = self._short_slots(eight[begin[few]] & (U(2**64 - 1) >> (U(8) * (U(8) - length[few].astype(U)))))
        many = np.flatnonzero(length > 8)
        slots[many] = self._long_slots([raw[a:b] for a, b in zip(begin[many].tolist(), stop[many].tolist())])
        at, size = self.at[slots], self.size[slots]
        counts = np.bincount(doc, size, minlength=len(texts)).astype(np.int64)
        flat = self.pool[0][np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        if not odd.any():
            return flat, counts
        whole = np.flatnonzero(odd)
        ids = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast([texts[i].decode() for i in whole], add_special_tokens=False)]
        own = np.split(flat, np.cumsum(counts)[:-1])
        for i, x in zip(whole, ids):
            own[i] = x
            counts[i] = len(x)
        return np.concatenate(own), counts


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str = "<u4") -> PieceEncoder:
    """This worker's encoder; it lives on from task to task."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = PieceEncoder(path, kind)
    return _encoders[path, kind]
