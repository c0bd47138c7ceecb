"""Word lists as patterns, and texts as strings of token classes."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: A line break, a word with its inner signs, or any other single sign.
_TOKEN = r"\n|[\p{L}\p{N}]+(?:['’.&-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"


def any_of(words) -> str:
    """A pattern for any of the words, the longest first, with any white space between their parts."""
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(set(words), key=lambda w: (-len(w), w))) + ")"


def plurals(words) -> list[str]:
    """The words and their regular plurals."""
    many = lambda w: w[:-1] + "ies" if w.endswith("y") else w + "es" if w.endswith(("s", "ch")) else w + "s"
    return [*words, *(many(w) for w in words)]


def near(first: str, second: str, apart: int) -> str:
    """A pattern for first and then second in one sentence, with at most so many words between them."""
    gap = r"[^\w\n.!?]+"
    return rf"\b{first}(?:{gap}[\w.'’-]+){{0,{apart}}}?{gap}{second}(?!\w)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), 0)


def classes(words: Column, rules: list[tuple[str, object]], other: str = "x") -> Column:
    """One letter for each token: that of the first rule (letter, test) that holds for it."""

    def letter(t: Column) -> Column:
        out = None
        for name, test in rules:
            out = F.when(test(t), name) if out is None else out.when(test(t), name)
        return out.otherwise(other)

    return F.array_join(F.transform(words, letter), "")


def places(letters: Column, grammar: list[str], not_after: str) -> Column:
    """array<struct<at, sizes>> where the parts of grammar follow each other in a string of token classes, in order: the
    first token (from 0), and how many tokens each part has. No match begins after one of the classes not_after."""
    whole = "^" + "".join(f"({part})" for part in grammar)
    starts = F.filter(F.sequence(F.lit(0), F.length(letters)), lambda i: F.substr(letters, i + 1).rlike(whole) & ~F.substr(F.concat(F.lit("^"), letters), i + 1, F.lit(1)).rlike(f"[{not_after}]"))
    sizes = lambda i: F.array(*[F.length(F.regexp_extract(F.substr(letters, i + 1), whole, k + 1)) for k in range(len(grammar))])
    return F.transform(starts, lambda i: F.struct(i.alias("at"), sizes(i).alias("sizes")))


def part(words: Column, place: Column, k: int) -> Column:
    """The tokens of part k at a place."""
    before = F.aggregate(F.slice(place["sizes"], 1, k), place["at"], lambda a, n: a + n) if k else place["at"]
    return F.slice(words, before + 1, F.get(place["sizes"], F.lit(k)))
