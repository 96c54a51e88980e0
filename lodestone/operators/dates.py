"""Dates named in a question: windows, their padding, and whether a date is asked for.

Only absolute dates are read: day month year, ISO, month year, a month alone
and a year alone; of several readings the longest text wins.
"""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = {name.lower(): i for i, name in enumerate(calendar.month_name) if name} | {name.lower(): i for i, name in enumerate(calendar.month_abbr) if name}
_MONTH = "|".join(sorted(_MONTHS, key=len, reverse=True))
#: Most days that a window is widened by.
MOST_PADDING = 10


class Window(NamedTuple):
    """Days from start to end, both in it; month is set if no year was named."""

    start: date
    end: date
    month: int | None = None

    def contains(self, c: Column) -> Column:
        day = F.to_date(c)
        return day.between(F.lit(self.start), F.lit(self.end))

    def padded(self, days: int) -> Window:
        n = min(days, MOST_PADDING)
        return self._replace(start=self.start - timedelta(n), end=self.end + timedelta(n))


def _month(year: int, month: int) -> Window:
    return Window(date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1]))


def parse(question: str) -> Window | None:
    """The window of the longest date text in a question."""
    text, found = question.lower(), []

    def add(match: re.Match[str], make) -> None:
        try:
            found.append((len(match[0]), -match.start(), make()))
        except ValueError:  # no such day
            pass

    for m in re.finditer(r"\b(\d{4})-(\d{2})-(\d{2})\b", text):
        add(m, lambda m=m: Window(*[date(int(m[1]), int(m[2]), int(m[3]))] * 2))
    for m in re.finditer(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({_MONTH})\b,?\s+(\d{{4}})\b", text):
        add(m, lambda m=m: Window(*[date(int(m[3]), _MONTHS[m[2]], int(m[1]))] * 2))
    for m in re.finditer(rf"\b({_MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", text):
        add(m, lambda m=m: Window(*[date(int(m[3]), _MONTHS[m[1]], int(m[2]))] * 2))
    for m in re.finditer(rf"\b({_MONTH})\b,?\s+(?:of\s+)?(\d{{4}})\b", text):
        add(m, lambda m=m: _month(int(m[2]), _MONTHS[m[1]]))
    for m in re.finditer(r"\b(?:19|20)\d{2}\b", text):
        add(m, lambda m=m: Window(date(int(m[0]), 1, 1), date(int(m[0]), 12, 31)))
    for m in re.finditer(rf"\b({_MONTH})\b", text):
        add(m, lambda m=m: _month(2000, _MONTHS[m[1]])._replace(month=_MONTHS[m[1]]))
    return max(found)[2] if found else None


def over_years(window: Window, first: int, last: int) -> list[Window]:
    """One window a year for a month without a year."""
    return [window] if window.month is None else [_month(y, window.month) for y in range(first, last + 1)]


def asks_for_date(c: Column) -> Column:
    """Whether a question asks for a date: pairs of words such as "when did", and "how long ago"."""
    bare = r"[.,!?;:()'\"]*"
    pair = rf"(^| ){bare}(when{bare} {bare}(did|was|will|is)|(what|which){bare} {bare}(date|day|year|month)|how{bare} {bare}long{bare} {bare}ago){bare}( |$)"
    return F.regexp_replace(F.lower(c), " +", " ").rlike(pair)


#: What shows a question to be about a conversation.
CUES = (" said", " says", " told", " asked", " replied", " mentioned", "what did", "who said", "conversation", "transcript", "chat", "session", "meeting", "call with", "discussed")


def about_conversation(c: Column) -> Column:
    text = F.lower(c)
    out = text.rlike('["“”]')
    for cue in CUES:
        out = out | F.contains(text, F.lit(cue))
    return out
