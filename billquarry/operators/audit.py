"""Audit trail: neighbours in an event log, patches, current state, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry.operators.matching import LARGE_GROUP, previous_in_group

# fields of a correction that hold amounts (fixed values)
NUMERIC_FIELDS = ["subtotal", "tax_amount", "discount", "stamp_duty", "additional_tax_total", "total_amount", "net_payable"]


def time_blocks(at: str, second: int) -> tuple[Column, Column]:
    """Days and minutes of a clock with ``second`` ticks a second: the blocks of an invoice with very many events."""
    return F.floor(F.col(at) / (86_400 * second)), F.floor(F.col(at) / (60 * second))


def neighbours(events: DataFrame, large: int = LARGE_GROUP) -> DataFrame:
    """Previous and next action of every event in its invoice, and seconds since the previous one.

    The next action is the previous one on the reversed clock, so both sides use the same block-wise look-back: an invoice
    may hold any share of the log, and a task holds the events of one of its minutes, the minutes of a day or its days.
    """
    cols = ["id", "invoice_id", "action", "at"]
    before = previous_in_group(events.select(*cols), "invoice_id", "at", "id", ["action"], 1, large, blocks=time_blocks("at", 1))
    back = before.select(*cols, F.get("previous", F.lit(0)).alias("_p"))
    mirrored = events.select((-F.col("id")).alias("id"), "invoice_id", "action", (-F.col("at")).alias("at"))
    after = previous_in_group(mirrored, "invoice_id", "at", "id", ["action"], 1, large, blocks=time_blocks("at", 1)).select(
        (-F.col("id")).alias("id"), F.get("previous", F.lit(0))["action"].alias("next")
    )
    return back.join(after, "id").select(
        *cols, F.col("_p.action").alias("previous"), "next", (F.col("at") - F.col("_p.at")).alias("seconds_since")
    )


def merged(before: Column, patch: Column) -> Column:
    """Map of both records; a key of the patch replaces the earlier value, even by NULL."""
    keys = F.array_union(F.map_keys(before), F.map_keys(patch))
    return F.map_from_arrays(
        keys, F.transform(keys, lambda k: F.when(F.map_contains_key(patch, k), F.try_element_at(patch, k)).otherwise(F.try_element_at(before, k)))
    )


def changed_fields(before: Column, after: Column) -> Column:
    """Entries of the new record that differ from the old one; absent and NULL are the same."""
    return F.map_filter(after, lambda k, v: F.coalesce(v, F.lit("")) != F.coalesce(F.try_element_at(before, k), F.lit("")))


def correction(before: Column, after: Column) -> Column:
    """Changed fields only: amounts as plain decimals, the vendor's identifier mirrored to ``tax_id``."""
    parsed = F.transform_values(
        changed_fields(before, after),
        lambda k, v: F.when(k.isin(*NUMERIC_FIELDS), F.translate(F.regexp_replace(v, r"\s", ""), ",", ".").try_cast("decimal(20,3)").cast("string")).otherwise(F.trim(v)),
    )
    mirrored = F.map_from_arrays(F.array(F.lit("tax_id")), F.array(F.try_element_at(parsed, F.lit("vendor_tax_id"))))
    return F.when(F.map_contains_key(parsed, "vendor_tax_id"), merged(parsed, mirrored)).otherwise(parsed)


def with_before(events: DataFrame, payload: str, large: int = LARGE_GROUP) -> DataFrame:
    """Events (``at`` in microseconds) with the payload of the event before them in the same invoice."""
    looked = previous_in_group(events, "invoice_id", "at", "id", [payload], 1, large, blocks=time_blocks("at", 1_000_000))
    return looked.withColumn("before", F.get("previous", F.lit(0))[payload]).drop("previous")


def latest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of the newest version per key: the newest version is a small aggregate joined back."""
    newest = rows.groupBy(F.col(key).alias("_k")).agg(F.max(version).alias("_v"))
    return rows.join(newest, (F.col(key) == F.col("_k")) & (F.col(version) == F.col("_v")), "left_semi")


def drafts(invoices: DataFrame, candidates: DataFrame) -> DataFrame:
    """New draft records with their duplicate flag, candidates (five at most) and creation event."""
    found = candidates.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "candidate_id"))), lambda c: c["candidate_id"]).alias("duplicates")
    )
    return invoices.join(found, "id", "left").withColumn("is_duplicate", F.col("duplicates").isNotNull()).withColumn("action", F.lit("created_draft"))


def current_state(events: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """Latest payload per key as a combinable aggregate."""
    last = F.max_by(F.struct(*payload), F.struct(*order))
    return events.groupBy(key).agg(last.alias("_s")).select(key, *[F.col(f"_s.{p}").alias(p) for p in payload])


def last_non_empty(df: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """Per key the latest value of every column that is not empty."""
    def last(c: str) -> Column:
        filled = F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
        return F.max_by(F.when(filled, F.col(c)), F.when(filled, order)).alias(c)

    return df.groupBy(key).agg(*[last(c) for c in columns])
