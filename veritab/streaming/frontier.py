"""The frontier of candidates as a stream: one state a company, merged as sightings arrive, closed for good when done.

A sighting is (key, seq, event, name, domain, source, snippet, source_kind, hopeless); event 'done' closes its key, any
other one is a candidate. What is kept of a key joins like sets do: the sources seen, the domain and the name of the
least seq, the longest snippet, the best kind, whether it was ever done. So the order of arrival, the cut into
micro-batches and replays change nothing, and a late or repeated candidate never opens a key that is done.

A key is open, done, or ruled out: if the candidate of least seq was hopeless (its own excerpt speaks against it).
State: one row a key, which grows with the different sources of a key only. A key with very many sightings is merged
pandas frame by frame. Keys of earlier runs are left out before the state by `jobs.unknown`'s anti join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from ..vocab import SOURCE_KIND_RANK
from .jobs import drain, latest_of

#: What is kept of a key, and what a change of it writes.
STATE = "done boolean, seq long, name string, hopeless string, domain_seq long, domain string, snippet_seq long, snippet string, kind string, sources array<string>"
OUT = "key string, status string, seq long, name string, domain string, snippet string, source_kind string, discovered_via array<string>, reason string"
_NONE = (False, None, None, None, None, None, None, None, None, [])


def _text(v) -> str | None:
    return v if isinstance(v, str) else None


def joined(a: tuple, rows: pd.DataFrame, ranks: dict[str, int]) -> tuple:
    """A key's state with a frame of its sightings."""
    done, seq, name, hopeless, domain_seq, domain, snippet_seq, snippet, kind, sources = a
    done = done or bool((rows["event"] == "done").any())
    seen = rows[rows["event"] != "done"]
    if len(seen):
        first = seen.loc[seen["seq"].idxmin()]
        if seq is None or first["seq"] < seq:
            seq, name, hopeless = int(first["seq"]), _text(first["name"]), _text(first["hopeless"])
        with_domain = seen[seen["domain"].notna()]
        if len(with_domain):
            first = with_domain.loc[with_domain["seq"].idxmin()]
            if domain_seq is None or first["seq"] < domain_seq:
                domain_seq, domain = int(first["seq"]), first["domain"]
        said = seen[seen["snippet"].notna()]
        if len(said):
            size = said["snippet"].str.len()
            best = said[size == size.max()]
            best = best.loc[best["seq"].idxmin()]
            if snippet is None or (-len(best["snippet"]), best["seq"]) < (-len(snippet), snippet_seq):
                snippet_seq, snippet = int(best["seq"]), best["snippet"]
        rank = lambda k: (ranks.get(k, len(ranks)), k)
        kind = min([*seen["source_kind"].dropna().unique(), *([kind] if kind else [])], key=rank, default=None)
        sources = sorted({*sources, *seen["source"].dropna()})
    return done, seq, name, hopeless, domain_seq, domain, snippet_seq, snippet, kind, sources


class Merge(StatefulProcessor):
    """Keeps one joined state a key and writes it whenever it changes."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        before = _NONE if held is None else (*held[:9], list(held[9] or []))
        after = before
        for frame in rows:
            after = joined(after, frame, self.ranks)
        if held is not None and after == before:
            return
        self.entry.update(after)
        done, seq, name, hopeless, _, domain, _, snippet, kind, sources = after
        status = "done" if done else "ruled_out" if hopeless else "open"
        yield pd.DataFrame({"key": [key[0]], "status": [status], "seq": pd.array([seq], "Int64"), "name": [name], "domain": [domain], "snippet": [snippet], "source_kind": [kind], "discovered_via": [sources], "reason": [hopeless]})

    def close(self) -> None:
        pass


def frontier(sightings: DataFrame, path: str) -> DataFrame:
    """key, status, seq, name, domain, snippet, source_kind, discovered_via, reason of every key of a stream of sightings.

    A run goes on where the last one with this path stopped."""
    spark = sightings.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sightings.where("key is not null").select("key", "seq", "event", "name", "domain", "source", "snippet", "source_kind", "hopeless")
    merged = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Merge(dict(SOURCE_KIND_RANK)), outputStructType=OUT, outputMode="Update", timeMode="None")
    return latest_of(drain(merged, path, "update"), "key")


def next_of(entries: DataFrame, promise: Column, n: int) -> DataFrame:
    """The n open keys to work on next: by promise, kind, number of sources, whether there is a domain, then arrival."""
    kind = F.coalesce(*[F.when(F.col("source_kind") == k, r) for k, r in SOURCE_KIND_RANK.items()], F.lit(len(SOURCE_KIND_RANK)))
    return entries.where("status = 'open'").orderBy(F.desc_nulls_last(promise), kind, F.desc(F.size("discovered_via")), F.col("domain").isNull(), "seq", "key").limit(n)
