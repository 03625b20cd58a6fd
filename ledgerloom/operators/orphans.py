"""References to records that do not exist.

Reference keys are first made distinct (a combine on the map side takes away hot keys), then references and parent keys
are co-partitioned, sorted and merged linearly: Spark's sort-merge join, which is asked for by hint. A parent's
validity interval (first and last fetch, removal) parts missing, deleted and late ones. Only then are the rows
looked up that hold one of the orphan keys.

Nulls and blanks: a null or blank reference is no case; a null row key is kept as null. Repeated rows give one row.
Extra columns are ignored. Empty tables give an empty result; an empty parent table makes all references orphans.
A tombstone without a time counts as never outlived.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import keys


@dataclass(frozen=True)
class Reference:
    """A foreign key: table.column names a record of parent by its key column."""

    table: str
    row_key: str
    column: str
    parent: str
    parent_key: str
    revived_by_fetch: bool


REFERENCES = (
    Reference("chunks", "chunk_id", "section_id", "sections", "section_id", False),
    Reference("sections", "section_id", "accession", "filings", "accession", True),
    Reference("filings", "accession", "cik", "companies", "cik", True),
)

KEYED = {"sections": keys.section_key, "filings": keys.accession_key, "companies": keys.cik_key}
NEVER = "9999-12-31 00:00:00"


def parent_intervals(parent: DataFrame, tombstones: DataFrame, ref: Reference) -> DataFrame:
    """One row per parent key ever seen: held, first_seen, last_seen, removed_at.

    A section has no fetch time; it counts as held from the beginning. Keys that stand only among the tombstones have
    held false.
    """
    keyed = KEYED[ref.parent]
    seen = F.col("fetched_at").cast("timestamp_ntz") if "fetched_at" in parent.columns else F.lit(None).cast("timestamp_ntz")
    never = F.lit(NEVER).cast("timestamp_ntz")
    held = parent.filter(keys.given(F.col(ref.parent_key))).select(
        keyed(F.col(ref.parent_key)).alias("key"), F.lit(True).alias("held"), seen.alias("seen"), F.lit(None).cast("timestamp_ntz").alias("removed")
    )
    gone = tombstones.filter(F.col("entity") == ref.parent).filter(keys.given(F.col("entity_key"))).select(
        keyed(F.col("entity_key")).alias("key"),
        F.lit(False).alias("held"),
        F.lit(None).cast("timestamp_ntz").alias("seen"),
        F.coalesce(F.col("removed_at").cast("timestamp_ntz"), never).alias("removed"),
    )
    return held.unionByName(gone).groupBy("key").agg(
        F.bool_or("held").alias("held"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.max("removed").alias("removed_at")
    )


def parent_state(ref: Reference) -> Column:
    """'missing', 'deleted' or 'present' from a merged interval."""
    deleted = F.col("removed_at").isNotNull()
    if ref.revived_by_fetch:
        deleted = deleted & ~F.coalesce(F.col("last_seen") > F.col("removed_at"), F.lit(False))
    return (
        F.when(deleted, "deleted").when(~F.coalesce(F.col("held"), F.lit(False)), "missing").otherwise("present")
    )


def merged_keys(child: DataFrame, parent: DataFrame, tombstones: DataFrame, ref: Reference) -> DataFrame:
    """Every distinct reference key with the state of what it names: key, state, first_seen."""
    refs = child.filter(keys.given(F.col(ref.column))).select(KEYED[ref.parent](F.col(ref.column)).alias("key")).distinct()
    intervals = parent_intervals(parent, tombstones, ref)
    return refs.join(intervals.hint("merge"), "key", "left").select("key", parent_state(ref).alias("state"), "first_seen")


def orphans(tables: dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """(table_name, row_key, state, period): rows whose reference names no existing record, each once.

    period is the year of the row's own accession number, null where it has none.
    """
    found = []
    for ref in references:
        child = tables[ref.table]
        bad = merged_keys(child, tables[ref.parent], tables["tombstones"], ref).filter(F.col("state") != "present").select("key", "state")
        rows = child.filter(keys.given(F.col(ref.column))).select(
            F.col(ref.row_key).alias("row_key"), KEYED[ref.parent](F.col(ref.column)).alias("key")
        )
        found.append(rows.join(bad, "key").select(F.lit(ref.table).alias("table_name"), "row_key", "state", period("row_key").alias("period")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def period(row_key: str) -> Column:
    """The year of a key's accession number; its two digits mean 1970 to 2069."""
    yy = F.substring(keys.digits(F.substring_index(F.col(row_key), ":", 1)), 11, 2).try_cast("int")
    return F.when(yy >= 70, yy + 1900).otherwise(yy + 2000)


def reference_report(tables: dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """(table_name, period, state, n_rows): counts of missing, deleted and late references.

    late: the parent exists, but was first fetched after the row that names it; only rows with a fetch time can be late.
    Repeated rows count once per distinct row key, reference and state.
    """
    parts = []
    for ref in references:
        child = tables[ref.table]
        states = merged_keys(child, tables[ref.parent], tables["tombstones"], ref)
        at = F.col("fetched_at").cast("timestamp_ntz") if "fetched_at" in child.columns else F.lit(None).cast("timestamp_ntz")
        rows = child.filter(keys.given(F.col(ref.column))).select(
            F.col(ref.row_key).alias("row_key"), KEYED[ref.parent](F.col(ref.column)).alias("key"), at.alias("at")
        )
        late = (F.col("state") == "present") & F.coalesce(F.col("first_seen") > F.col("at"), F.lit(False))
        parts.append(
            rows.join(states.filter((F.col("state") != "present") | F.col("first_seen").isNotNull()), "key")
            .withColumn("state", F.when(late, "late").otherwise(F.col("state")))
            .filter(F.col("state") != "present")
            .select(F.lit(ref.table).alias("table_name"), period("row_key").alias("period"), "state", "row_key")
        )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct().groupBy("table_name", "period", "state").agg(F.count(F.lit(1)).alias("n_rows"))
