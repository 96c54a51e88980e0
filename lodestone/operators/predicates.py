"""The closed predicate algebra, compiled to Catalyst expressions.

SQL (three-valued) semantics by default; eq and ne take null_safe for the
two-valued ones.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.schema import ABSORBED, ANOMALOUS, CAPTURE, CHANNEL, CONFIDENCE, CONFIRMATION, EXPORTABILITY, KIND, SENSITIVITY, SOURCE_TYPE, STATE, TRUST, VAGUE


def all_of(*ps: Column) -> Column:
    """Conjunction; of nothing, true."""
    return reduce(operator.and_, ps, F.lit(True))


def any_of(*ps: Column) -> Column:
    """Disjunction; of nothing, false."""
    return reduce(operator.or_, ps, F.lit(False))


def negated(p: Column) -> Column:
    return ~p


def eq(c: str, v: object, null_safe: bool = False) -> Column:
    return F.col(c).eqNullSafe(v) if null_safe else F.col(c) == F.lit(v)


def ne(c: str, v: object, null_safe: bool = False) -> Column:
    return ~eq(c, v, null_safe)


def is_null(c: str) -> Column:
    return F.col(c).isNull()


def is_not_null(c: str) -> Column:
    return F.col(c).isNotNull()


def one_of(c: str, values: Sequence[object]) -> Column:
    return F.col(c).isin(list(values)) if values else F.lit(False)


def like(c: str, pattern: str, ignore_case: bool = False) -> Column:
    return F.col(c).ilike(pattern) if ignore_case else F.col(c).like(pattern)


def mask_all(c: str, m: int) -> Column:
    return F.col(c).bitwiseAND(F.lit(m)) == F.lit(m)


def mask_any(c: str, m: int) -> Column:
    return F.col(c).bitwiseAND(F.lit(m)) != 0


def mask_none(c: str, m: int) -> Column:
    return F.col(c).bitwiseAND(F.lit(m)) == 0


def mask_equals(c: str, m: int, expected: int) -> Column:
    return F.col(c).bitwiseAND(F.lit(m)) == F.lit(expected)


def cluster(n: int) -> Column:
    """State cluster: 0 known now, 1 known once, 2 ended."""
    return F.shiftright(STATE.value(), 4) == n


def recall_tier(tier: str) -> Column:
    return {"currentAndVague": mask_none("operational", ABSORBED), "vagueOnly": mask_any("operational", VAGUE), "currentOnly": mask_none("operational", VAGUE | ABSORBED), "all": F.lit(True)}[tier]


#: Filters by name; those that take a value are functions of it.
FILTERS = {
    "currently_believe": lambda: cluster(0),
    "used_to_believe": lambda: cluster(1),
    "knew_once_and_erased": lambda: cluster(2),
    "state": lambda v: STATE.value() == v,
    "state_in_cluster": cluster,
    "trustworthy": lambda: TRUST.value() < 4,
    "requires_confirmation": lambda: TRUST.value() >= 4,
    "trust": lambda v: TRUST.value() == v,
    "trust_at_most": lambda v: TRUST.value() <= v,
    "sensitivity": lambda v: SENSITIVITY.value() == v,
    "sensitivity_at_most": lambda v: SENSITIVITY.value() <= v,
    "exportable": lambda: EXPORTABILITY.value() == 32,
    "contained": lambda: EXPORTABILITY.value() == 0,
    "user_confirmed": lambda: CONFIRMATION.value() >= 1,
    "automated_confirmed_only": lambda: CONFIRMATION.value() == 2,
    "unconfirmed": lambda: CONFIRMATION.value() == 0,
    "source_type": lambda v: SOURCE_TYPE.value() == v,
    "channel": lambda v: CHANNEL.value() == v,
    "confidence_at_least": lambda v: CONFIDENCE.value() >= v,
    "recall_tier": recall_tier,
    "capture_channel": lambda v: CAPTURE.value() == v,
    "content_kind": lambda v: KIND.value() == v,
    "has_feature_flag": lambda m: mask_any("operational", m),
    "in_room": lambda v: F.col("room") == v,
    "in_wing": lambda v: F.col("wing") == v,
    "lineage_id": lambda v: F.col("lineage_id") == v,
    "created_after": lambda t: F.col("filed_at") > t,
    "created_before": lambda t: F.col("filed_at") < t,
    "event_after": lambda t: F.col("event_time") >= t,
    "event_before": lambda t: F.col("event_time") <= t,
    "lattice_anchor": lambda anchor: all_of(*(F.col(c) == v for c, v in anchor.items())),
    "lattice_under": lambda prefix: F.col("udc_code").startswith(prefix),
    "wikidata_concept": lambda q: (F.col("qid") == q) | F.array_contains("qids_secondary", q),
    "content_matches": lambda s: F.contains(F.col("text"), F.lit(s)),
    "anomalous": lambda flag: mask_any("operational", ANOMALOUS) if flag else mask_none("operational", ANOMALOUS),
    "all": lambda *ps: all_of(*ps),
    "any": lambda *ps: any_of(*ps),
    "not": negated,
}
#: The axis a filter speaks for; the defaults stand in on axes left open.
_AXES = {"state": {"currently_believe", "used_to_believe", "knew_once_and_erased", "state", "state_in_cluster"}, "trust": {"trustworthy", "requires_confirmation", "trust", "trust_at_most"}, "sensitivity": {"sensitivity", "sensitivity_at_most"}, "tier": {"recall_tier"}}


def chain(*filters: tuple[str, tuple[object, ...]], defaults: bool = True) -> Column:
    """Conjunction of named filters with their arguments; on axes without one
    the defaults: known now, trust below 4, sensitivity at most elevated, current and vague."""
    built = [FILTERS[name](*args) for name, args in filters]
    if defaults:
        named = {name for name, _ in filters}
        standing = {"state": cluster(0), "trust": TRUST.value() < 4, "sensitivity": SENSITIVITY.value() <= 16, "tier": recall_tier("currentAndVague")}
        built += [p for axis, p in standing.items() if not named & _AXES[axis]]
    return all_of(*built)


def forbidden() -> Column:
    """Secret and public at once."""
    return (SENSITIVITY.value() == 48) & (EXPORTABILITY.value() == 32)


def anomalous_gate(wanted: bool | None) -> Column:
    """No test, only flagged rows, or only the others."""
    return F.lit(True) if wanted is None else FILTERS["anomalous"](wanted)


#: States that may follow each other: within a cluster to the next, from any known state to an ended one.
TRANSITIONS = [(a, b) for a in (0, 1, 2, 3, 16, 17, 18, 19) for b in (0, 1, 2, 3, 16, 17, 18, 19, 32, 33) if a != b and (b >= 16 or a < 16)]


def illegal_transitions(rows: DataFrame, entity: str, order: str, state: str) -> DataFrame:
    """Successive states of an entity that no transition allows: an anti join with the table of transitions (under 100 rows)."""
    after = F.lead(state).over(Window.partitionBy(entity).orderBy(order))
    steps = rows.withColumn("before", F.col(state)).withColumn("after", after).where("after is not null")
    legal = rows.sparkSession.createDataFrame(TRANSITIONS, "before long, after long")
    return steps.join(F.broadcast(legal), ["before", "after"], "left_anti")


def hydrated(rows: DataFrame, level: str) -> DataFrame:
    """Records without their text at level bitmap, whole at structured and full."""
    return rows.drop("text") if level == "bitmap" else rows
