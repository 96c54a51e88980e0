"""Packed bit layouts, and the record table made from the driver's documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Field(NamedTuple):
    """A field of a packed 64-bit column."""

    column: str
    shift: int
    width: int = 6

    def value(self) -> Column:
        return F.shiftrightunsigned(F.col(self.column), self.shift).bitwiseAND(F.lit((1 << self.width) - 1))

    def written(self, value: Column) -> Column:
        """The column with the field set to value."""
        mask = ((1 << self.width) - 1) << self.shift
        return F.col(self.column).bitwiseAND(F.lit(~mask)).bitwiseOR(F.shiftleft(value.cast("long"), self.shift))


# Where each packed field stands.
STATE, SENSITIVITY, EXPORTABILITY, TRUST = (Field("adjective", s) for s in (0, 6, 12, 18))
CAPTURE, KIND = Field("operational", 0), Field("operational", 6)
SOURCE_TYPE, CHANNEL, CONFIRMATION, CONFIDENCE = (Field("provenance", s) for s in (0, 6, 18, 24))
VAGUE, ABSORBED, ANOMALOUS = 1 << 20, 1 << 21, 1 << 26
STATES = (0, 1, 2, 3, 16, 17, 18, 19, 32, 33)
SENSITIVITIES = (0, 16, 32, 48)


def records(documents: DataFrame) -> DataFrame:
    """Documents as records: wing is the source, room the language; the packed
    columns are made from doc_id, as the test tables have none."""
    i = F.col("doc_id")
    pick = lambda values, by: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), (by % len(values)).cast("int") + 1)
    bit = lambda every, b: F.when(i % every == 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long")
    return documents.select(
        "doc_id", F.col("source").alias("wing"), F.col("lang").alias("room"), "n_chars", "text",
        (pick(STATES, i) + F.shiftleft(pick(SENSITIVITIES, i), 6) + F.shiftleft((i % 2) * 32, 12) + F.shiftleft(i % 7, 18)).alias("adjective"),
        (i % 6 + F.shiftleft(i % 8, 6) + pick([1 << b for b in range(12, 19)], i) + bit(11, 20) + bit(13, 21) + bit(17, 26)).alias("operational"),
        (i % 5 + F.shiftleft(i % 3, 6) + F.shiftleft(i % 4, 18) + F.shiftleft(i % 57, 24)).alias("provenance"),
        F.timestamp_add("HOUR", i.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("filed_at"),
        F.timestamp_add("HOUR", (i - i % 48).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("event_time"),
        F.concat(F.lit("l"), (i % 9).cast("string")).alias("lineage_id"),
        F.concat((i % 10).cast("string"), F.lit("."), (i % 7).cast("string")).alias("udc_code"),
        F.concat(F.lit("Q"), (i % 50).cast("string")).alias("qid"),
        F.array(F.concat(F.lit("Q"), (i % 3).cast("string")), F.concat(F.lit("Q"), (i % 4).cast("string"))).alias("qids_secondary"),
    )


#: The same table as SQL, for the oracles.
RECORDS_SQL = """r AS (
  SELECT doc_id, source AS wing, lang AS room, n_chars, text,
    [0,1,2,3,16,17,18,19,32,33][1 + doc_id % 10] + ([0,16,32,48][1 + doc_id % 4] << 6) + (((doc_id % 2) * 32) << 12) + ((doc_id % 7) << 18) AS adjective,
    doc_id % 6 + ((doc_id % 8) << 6) + (CAST(1 AS BIGINT) << (12 + doc_id % 7)) + CASE WHEN doc_id % 11 = 0 THEN 1048576 ELSE 0 END + CASE WHEN doc_id % 13 = 0 THEN 2097152 ELSE 0 END + CASE WHEN doc_id % 17 = 0 THEN 67108864 ELSE 0 END AS operational,
    doc_id % 5 + ((doc_id % 3) << 6) + ((doc_id % 4) << 18) + ((doc_id % 57) << 24) AS provenance,
    TIMESTAMP '2024-01-01' + to_hours(doc_id) AS filed_at, TIMESTAMP '2024-01-01' + to_hours(doc_id - doc_id % 48) AS event_time,
    'l' || (doc_id % 9) AS lineage_id, (doc_id % 10) || '.' || (doc_id % 7) AS udc_code, 'Q' || (doc_id % 50) AS qid, ['Q' || (doc_id % 3), 'Q' || (doc_id % 4)] AS qids_secondary
  FROM documents)"""
