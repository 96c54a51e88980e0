"""Pairwise preferences: who beat whom each day, and the strengths that explain it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items whose strengths one fit finds: their counts of pairs, a square of it at most, reach the driver.
ITEMS = 1024


def daily_outcomes(events: DataFrame, time: str, judge: str, kind: str, value: Column) -> DataFrame:
    """(day, winner, loser, n): on each day a judge's kind of the largest total (of ties the last) beats the judge's others.

    Judges are reduced to one row a day and kind first; a winner meets the
    other kinds of its own judge and day only.
    """
    totals = events.groupBy(F.col(time).cast("date").alias("day"), F.col(judge).alias("judge"), F.col(kind).alias("kind")).agg(F.sum(value).alias("total"))
    seen = totals.groupBy("day", "judge").agg(F.max_by("kind", F.struct("total", "kind")).alias("winner"), F.collect_set("kind").alias("kinds"))
    return seen.select("day", "winner", F.explode("kinds").alias("loser")).where("winner <> loser").groupBy("day", "winner", "loser").agg(F.count(F.lit(1)).alias("n"))


def _reached(beats: np.ndarray) -> int:
    """Items reached from the first one."""
    seen = np.zeros(len(beats), bool)
    seen[0] = True
    while True:
        now = seen | beats[seen].any(axis=0)
        if now.sum() == seen.sum():
            return int(seen.sum())
        seen = now


def fit(wins: np.ndarray, tolerance: float = 1e-9, rounds: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Log strengths of mean 0 and their standard errors, by minorise-maximise steps (Hunter, 2004).

    wins[i, j]: how often i beat j.  Strengths are finite only if every item
    has beaten every other one over some chain, else a ValueError is raised.
    """
    if np.diag(wins).any():
        raise ValueError("an item can't beat itself")
    if len(wins) < 2 or min(_reached(wins > 0), _reached(wins.T > 0)) < len(wins):
        raise ValueError("the wins don't connect all items both ways")
    games, won, p = wins + wins.T, wins.sum(axis=1), np.ones(len(wins))
    for _ in range(rounds):
        new = won / (games / (p[:, None] + p[None, :])).sum(axis=1)
        new /= np.exp(np.log(new).mean())
        moved, p = np.abs(np.log(new / p)).max(), new
        if moved < tolerance:
            break
    chance = p[:, None] / (p[:, None] + p[None, :])
    return np.log(p), 1 / np.sqrt((games * chance * (1 - chance)).sum(axis=1))


def strengths(counts: DataFrame, items: int = ITEMS) -> DataFrame:
    """(item, strength, low, high) of counts (winner, loser, n), strongest first, then by item; more than items are a ValueError.

    low and high: 1.96 standard errors off.  Only summed counts of pairs reach the driver.
    """
    spark = counts.sparkSession
    counts = counts.groupBy(F.col("winner").cast("string").alias("winner"), F.col("loser").cast("string").alias("loser")).agg(F.sum("n").cast("double").alias("n"))
    known = [r[0] for r in counts.select(F.explode(F.array("winner", "loser"))).distinct().limit(items + 1).collect()]
    if len(known) > items:
        raise ValueError(f"more than {items} items")
    known.sort()
    place, wins = {x: i for i, x in enumerate(known)}, np.zeros((len(known), len(known)))
    for r in counts.collect():
        wins[place[r.winner], place[r.loser]] += r.n
    found, error = fit(wins)
    rows = sorted(((x, float(s), float(s - 1.96 * e), float(s + 1.96 * e)) for x, s, e in zip(known, found, error, strict=True)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "item string, strength double, low double, high double")
