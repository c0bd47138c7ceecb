"""Chat formatting with spans found by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to one string. For each turn the operator renders the
conversation up to it, and up to it with a private-use sentinel in place of its text. Comparing these outputs with
the one before gives the turn's span and the span of its text, without knowing the template. A template whose
output for a prefix is not a prefix of its next output rewrites history; this is reported, and turns whose spans it
moves have none (-1) and take no part in the loss mask.

Conversations are grouped on conv_id and ordered by turn, then role, then text; a conversation is one training
example and is rendered whole by one task. The work per conversation is the sum of its prefixes' lengths.

Nulls: a null text or role is empty, a null turn comes first, each row with a null conv_id is a conversation of its own.
Repeated rows are repeated turns. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: The strings that mark turns.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[TEXT]")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Breaks control strings by a backslash after their first character; backslashes are doubled."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def instruct(turns: list[Turn]) -> str:
    """<s>, then [SYS], [INST] and plain assistant turns, each closed; other roles are named in theirs."""
    parts = ["<s>"]
    for role, text in turns:
        body = escape(text)
        if role == "assistant":
            parts.append(f"{body}</s>")
        elif role == "user":
            parts.append(f"[INST]{body}[/INST]")
        elif role == "system":
            parts.append(f"[SYS]{body}[/SYS]")
        else:
            parts.append(f"[ROLE]{escape(role)}[TEXT]{body}[/ROLE]")
    return "".join(parts)


def read_role(turn: str) -> str:
    """The role of a turn of `instruct`, from its marks."""
    for mark, role in (("[INST]", "user"), ("[SYS]", "system")):
        if turn.startswith(mark):
            return role
    if turn.startswith("[ROLE]"):
        return unescape(turn[len("[ROLE]") : turn.index("[TEXT]")])
    return "assistant"


def common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:  # a[:lo] == b[:lo] holds
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


#: Where the sign that stands for a text is taken from: code points for private use, then any that a conversation doesn't have.
SENTINELS = (range(0xE000, 0xF900), range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE), range(0xA0, 0xD800), range(0x10000, 0xF0000))


def locate(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """The rendering, (turn start, turn end, text start, text end) of each turn (-1 where history was rewritten
    under it), and the first turn at which the template rewrote history (-1: none)."""
    used = set().union(*(t for _, t in turns)) if turns else set()
    sentinel = next(chr(c) for c in itertools.chain(*SENTINELS) if chr(c) not in used)
    before, spans, rewritten = template([]), [], -1
    for i, (role, _) in enumerate(turns):
        now = template(turns[: i + 1])
        same = common_prefix(before, now)
        if same < len(before):
            rewritten = i if rewritten < 0 else rewritten
            spans = [s if s[1] <= same else (-1, -1, -1, -1) for s in spans]
        probe = template([*turns[:i], (role, sentinel)])
        at = probe.find(sentinel)
        size = len(now) - len(probe) + 1
        whole = at >= 0 and size >= 0 and now[:at] == probe[:at] and now[at + size :] == probe[at + 1 :]
        spans.append((same, len(now), at, at + size) if whole else (-1, -1, -1, -1))
        before = now
    return before, spans, rewritten


def conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, turns array<struct<turn, role, text>> in order."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return named.unionByName(rows.where(F.col("conv_id").isNull()).select("conv_id", F.array(one).alias("turns")))


def format_conversations(rows: DataFrame, template: Template = instruct) -> DataFrame:
    """conv_id, formatted, spans array<struct<turn_start, turn_end, text_start, text_end, in_loss>>, rewrites_at."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        formatted, spans, rewrites = [], [], []
        for turns in batch.column(1).to_pylist():
            own = [(t["role"], t["text"]) for t in turns]
            text, found, at = locate(own, template)
            formatted.append(text)
            spans.append([{"turn_start": a, "turn_end": b, "text_start": c, "text_end": d, "in_loss": role == "assistant" and c >= 0} for (a, b, c, d), (role, _) in zip(found, own)])
            rewrites.append(at)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(formatted, pa.string()), pa.array(spans, SPANS), pa.array(rewrites, pa.int32())], names=["conv_id", "formatted", "spans", "rewrites_at"])

    return map_arrow(conversations(rows), run, "conv_id long, formatted string, spans array<struct<turn_start: int, turn_end: int, text_start: int, text_end: int, in_loss: boolean>>, rewrites_at int")


SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("turn_start", "turn_end", "text_start", "text_end")] + [("in_loss", pa.bool_())]))


def digests(formatted: DataFrame) -> DataFrame:
    """Reads the formatted conversations back: turns and loss text, unescaped from the output by their spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            turns, loss, loss_chars = hashlib.sha256(), hashlib.sha256(), 0
            for s in spans:
                body = unescape(text[s["text_start"] : s["text_end"]]) if s["text_start"] >= 0 else ""
                role = read_role(text[s["turn_start"] : s["turn_end"]]) if s["turn_start"] >= 0 else ""
                turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                if s["in_loss"]:
                    loss.update(body.encode("utf-8", "surrogatepass"))
                    loss_chars += len(body)
            for k, v in zip(out, (len(spans), turns.hexdigest(), loss_chars, loss.hexdigest(), len(text))):
                out[k].append(v)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in out.values()), batch.column(3)], names=["conv_id", *out, "rewrites_at"])

    return map_arrow(formatted.select("conv_id", "formatted", "spans", "rewrites_at"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_at int")
