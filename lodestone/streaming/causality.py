"""What follows what, folded from a stream of events: keyed state in time buckets, emitted and evicted by the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# fixed values: the window in minutes, the sources of an event at most where pairs_of is not asked for all, the upper ends of the lags in minutes
MINUTES, OCCUPANCY = 256, 512
LAGS = (1, 2, 4, 8, 16, 32, 64, 128)

_WIDTH = MINUTES * 60_000_000
_FEW = 1024  # what a search costs at least, in events
_STATE = "entity array<string>, at array<long>, id array<long>, label array<string>, own array<boolean>"
_OUT = "source string, target string, lag int, n long"


def _searched(at: np.ndarray, label: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(source, target, place of the lag, n) of one entity's events in order of time: all pairs within the window, counted by binary search and not formed."""
    targets = np.flatnonzero(own)
    targets = targets[np.argsort(label[targets], kind="stable")]
    kinds, begin = np.unique(label[targets], return_index=True)
    ends = at[targets]
    for source in np.unique(label):
        times = at[label == source]
        newer = np.searchsorted(times, ends)
        for place, minutes in enumerate(LAGS):
            last = place == len(LAGS) - 1
            older = np.searchsorted(times, ends - _WIDTH, side="right") if last else np.searchsorted(times, ends - minutes * 60_000_000)
            for target, n in zip(kinds, np.add.reduceat(newer - older, begin), strict=True):
                if n:
                    yield int(source), int(target), place, int(n)
            newer = older


def pairs_of(at: np.ndarray, ids: np.ndarray, labels: np.ndarray, own: np.ndarray, entities: np.ndarray | None = None, most: int | None = OCCUPANCY) -> pd.DataFrame:
    """(source, target, lag, n) of events (microseconds): each own event with the events of its entity before it that lie within the window, the `most` latest of them or, with None, all; without entities all are one's.

    Events of one time are ordered by id, make no pair and take a place each.
    Memory is that of the events, whatever the number of pairs.  With None an
    entity that has more pairs than events times labels times lags is counted by that many searches.
    """
    who = np.unique(entities, return_inverse=True)[1] if entities is not None else np.zeros(len(at), dtype=np.int64)
    order = np.lexsort((ids, at, who))
    who, at, own = who[order], at[order], own[order]
    names, label = np.unique(labels[order], return_inverse=True)
    kinds, places = len(names), len(LAGS)
    counts: dict[int, int] = {}
    live = np.arange(len(at))  # events that still have one of their entity so far back
    if most is None and len(at):
        # one clock for all: gaps within the window as they are, larger ones and those between entities a window
        step = np.minimum(np.diff(at, prepend=at[0]), _WIDTH)
        step[1:][who[1:] != who[:-1]] = _WIDTH
        clock = np.cumsum(step)
        reach = live - np.searchsorted(clock, clock - _WIDTH, side="right")
        begin = np.flatnonzero(np.diff(who, prepend=-1))
        pairs = np.add.reduceat(np.where(own, reach, 0), begin)
        size = np.bincount(who)
        searches = np.bincount(np.unique(who * kinds + label) // kinds) * places * np.maximum(size, _FEW)
        busy = pairs > searches
        for e in np.flatnonzero(busy):
            part = slice(begin[e], begin[e] + size[e])
            for source, target, place, n in _searched(at[part], label[part], own[part]):
                c = (source * kinds + target) * places + place
                counts[c] = counts.get(c, 0) + n
        live = live[~busy[who]]
    for back in range(1, (len(at) if most is None else most) + 1):
        live = live[live >= back]
        live = live[(who[live - back] == who[live]) & (at[live] - at[live - back] < _WIDTH)]
        if not len(live):
            break  # those further back lie further off
        gap = at[live] - at[live - back]
        take = own[live] & (gap > 0)
        lag = np.minimum(np.searchsorted(np.array(LAGS) * 60_000_000, gap[take]), places - 1)
        cell = (label[live - back][take] * kinds + label[live][take]) * places + lag
        for c, n in zip(*np.unique(cell, return_counts=True), strict=True):
            counts[int(c)] = counts.get(int(c), 0) + int(n)
    rows = [(names[c // places // kinds], names[c // places % kinds], LAGS[c % places], n) for c, n in counts.items()]
    return pd.DataFrame(rows, columns=["source", "target", "lag", "n"])


def causality(events: DataFrame, entity: str, ts: str, order: str, label: str, late: str = "2 hours", windows: int = 6, shards: int = 64) -> DataFrame:
    """A stream of (source, target, lag, n) to be summed: which label follows which, within MINUTES, on one entity; all pairs, however many events lie within.

    An event goes to the time bucket it lies in (so many windows wide, counted
    from the epoch) and, from a bucket's last window, as a source to the next
    one as well: so a bucket holds all sources of its events, and a busy entity
    is spread over its buckets.  Entities share a key by a digest, `shards` keys
    a bucket, as each key costs a call of Python.  A bucket is folded once, when the watermark has passed its end, and its state goes;
    rows later than the watermark are dropped.  Buckets not yet passed stay in
    the state for the next run.  Rows without entity, time, order or label
    take no part.
    """
    width = windows * _WIDTH
    given = events.select(F.col(ts).cast("timestamp").alias("ts"), F.col(entity).cast("string").alias("entity"), F.col(order).cast("long").alias("id"), F.col(label).alias("label"))
    given = given.withWatermark("ts", late).where("entity IS NOT NULL AND ts IS NOT NULL AND id IS NOT NULL AND label IS NOT NULL")
    at = F.unix_micros("ts")
    last = F.pmod(at, F.lit(width)) > width - _WIDTH
    copies = F.when(last, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    dealt = given.withColumn("at", at).withColumn("own", F.explode(copies))
    dealt = dealt.withColumn("bucket", F.floor(F.col("at") / width) + F.when(F.col("own"), 0).otherwise(1))

    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("entity"), F.lit(shards)))

    def folded(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            who, at, ids, labels, own = state.get
            state.remove()
            if len(at) > 1 and any(own):
                yield pairs_of(np.array(at, dtype=np.int64), np.array(ids, dtype=np.int64), np.array(labels, dtype=object), np.array(own, dtype=bool), np.array(who, dtype=object), None)
            return
        kept = [np.asarray(x).tolist() for x in state.get] if state.exists else [[], [], [], [], []]
        for frame in frames:
            for column, name in zip(kept, ("entity", "at", "id", "label", "own"), strict=True):
                column.extend(frame[name].tolist())
        state.update(tuple(kept))
        # never at or before the present watermark, which an own event's bucket end is past and a source's as well
        state.setTimeoutTimestamp(max((int(key[1]) + 1) * width // 1000, state.getCurrentWatermarkMs() + 1))

    return dealt.groupBy("shard", "bucket").applyInPandasWithState(folded, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
