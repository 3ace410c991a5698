"""Searches: optional filters, literal case-insensitive text, clamped pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billquarry.functions import text as X
from billquarry.storage import written


def contains_text(columns: list[str], needle: str) -> Column:
    """Any column contains the text; wildcard characters in it mean themselves."""
    lowered = needle.strip().lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(lowered), F.lit(False)) for c in columns])


def where_given(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Conjunction of the conditions that were given."""
    present = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, present)) if present else df


def text_filter(columns: list[str], needle: str | None) -> Column | None:
    return contains_text(columns, needle) if needle and needle.strip() else None


#: Columns that each search looks into.
SEARCHED = {
    "search": ["filename", "supplier_name", "customer_name", "invoice_number", "normalized_json", "extracted_text"],
    "invoice_name": ["filename", "invoice_number"],
    "supplier": ["supplier_name"],
    "company": ["customer_name", "normalized_json"],
    "tax_id": ["normalized_json", "extracted_text"],
}


def search_invoices(
    df: DataFrame,
    *,
    search: str = "",
    invoice_name: str = "",
    supplier: str = "",
    company: str = "",
    tax_id: str = "",
    status: str = "",
) -> DataFrame:
    given = {"search": search, "invoice_name": invoice_name, "supplier": supplier, "company": company, "tax_id": tax_id}
    return where_given(df, *[text_filter(SEARCHED[n], v) for n, v in given.items()], (F.col("status") == status.strip()) if status.strip() else None)


TRIGRAM = 3


def trigrams(text: Column) -> Column:
    """Distinct pieces of three characters of a text in lower case."""
    places = lambda low: F.transform(F.sequence(F.lit(1), F.length(low) - TRIGRAM + 1), lambda i: F.substring(low, i, F.lit(TRIGRAM)))
    # plain ASCII, a byte a character, is walked through once; finding a place in other texts starts at their beginning
    walked = lambda low: F.regexp_extract_all(low, F.lit("(?s)(?=(.{" + str(TRIGRAM) + "}))"), F.lit(1))
    pieces = lambda low: F.when(F.octet_length(low) == F.length(low), walked(low)).otherwise(places(low))
    return X.let(F.lower(text), lambda low: F.when(F.length(low) >= TRIGRAM, F.array_distinct(pieces(low))).otherwise(F.array().cast("array<string>")))


@dataclass(frozen=True)
class TextIndex:
    """Stored postings (``trigram``, ``column``, ``id``) over some columns of a stored table; ``held``: rows of each trigram."""

    rows: DataFrame
    postings: DataFrame
    held: DataFrame
    id_: str

    def candidates(self, columns: list[str], needle: str) -> DataFrame | None:
        """Ids of rows that hold all trigrams of the text in one of the columns; None if it is too short to tell.

        The rarest trigrams are looked up first: as many as make the next one no use, four at most."""
        low = needle.strip().lower()
        wanted = sorted({low[i : i + TRIGRAM] for i in range(len(low) - TRIGRAM + 1)})
        if not wanted:
            return None
        known = {r["trigram"]: r["rows"] for r in self.held.where(F.col("trigram").isin(wanted)).collect()}
        rare = sorted(wanted, key=lambda t: (known.get(t, 0), t))[:4]
        found = self.postings.where(F.col("trigram").isin(rare) & F.col("column").isin(columns))
        return found.groupBy("column", self.id_).agg(F.count_distinct("trigram").alias("_n")).where(F.col("_n") == len(rare)).select(self.id_).distinct()


def text_index(df: DataFrame, id_: str, columns: list[str], path: str | None = None) -> TextIndex:
    """Index of a table by the trigrams of some columns, for searches that are asked again and again. The table is stored
    in the order of ids, so that rows of a few ids are read from the row groups that may hold them."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = written(df.repartitionByRange(int(parts), id_).sortWithinPartitions(id_), "indexed-rows", path and f"{path}/rows")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), trigrams(F.col(c)).alias("found")) for c in columns])
    pieces = rows.select(id_, F.inline(pairs)).select(id_, "column", F.explode("found").alias("trigram"))
    # each file holds the postings of a range of ids, in the order of trigrams: they are neither shuffled nor made twice to find ranges;
    # ids of a trigram need no order, without which rows are compared by a prefix alone
    postings = written(pieces.sortWithinPartitions("trigram"), "trigrams", path and f"{path}/trigrams")
    held = written(postings.groupBy("trigram").agg(F.count(F.lit(1)).alias("rows")), "trigram-rows", path and f"{path}/held")
    return TextIndex(rows, postings, held, id_)


def open_text_index(spark: SparkSession, path: str, id_: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("rows", "trigrams", "held")), id_)


def search_indexed(index: TextIndex, status: str = "", **needles: str) -> DataFrame:
    """The rows of ``search_invoices``; only candidates of the index are read and compared."""
    rows = index.rows
    for name, needle in needles.items():
        if needle.strip() and (found := index.candidates(SEARCHED[name], needle)) is not None:
            rows = rows.join(found, index.id_, "left_semi")
    return search_invoices(rows, status=status, **needles)


def by_parent(df: DataFrame, parent: str, value: int | None = None) -> DataFrame:
    """Rows of one parent when it is given, all rows otherwise."""
    return df if value is None else df.filter(F.col(parent) == value)


#: Rows before a page up to which it is the end of a top-n; pages beyond are located by counts.
SHALLOW = 10_000


def page_of(df: DataFrame, order: list[Column], page: int, page_size: int, max_size: int = 100, ranges: list[Column] | None = None, shallow: int = SHALLOW) -> DataFrame:
    """One page with the total and the page count beside every row.

    The total is a scalar subquery (one partial count per partition); a page near the beginning is a top-n per partition,
    never a full sort on one node. For pages further down ``ranges`` names numbers that grow with the order, coarse ones
    first: counts per range locate the page, only the ranges that hold it are read and sorted, and the millionth page costs
    what the first one does.
    """
    size = min(max_size, max(1, page_size))
    number = max(1, page)
    total = df.agg(F.count(F.lit(1))).scalar()
    before = (number - 1) * size
    here, skipped = located(df, ranges, before, size) if ranges and before > shallow else (df, 0)
    return (
        here.orderBy(*order)
        .offset(before - skipped)
        .limit(size)
        .withColumn("total", total)
        .withColumn("page", F.lit(number))
        .withColumn("total_pages", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / size)))
    )


def located(df: DataFrame, ranges: list[Column], before: int, size: int) -> tuple[DataFrame, int]:
    """The rows of the ranges that hold places ``before`` to ``before + size``, and the number of rows in front of them.

    Each level counts the rows of its ranges inside those chosen so far; if the page lies within one of them, the next level
    cuts that one up. What the driver gets is one number for each range, as many as the level has.
    """
    skipped, here = 0, df
    for level in ranges:
        counts = sorted((r["at"], r["rows"]) for r in here.groupBy(level.cast("long").alias("at")).agg(F.count(F.lit(1)).alias("rows")).collect())
        chosen, upto = [], skipped
        for at, rows in counts:
            if upto + rows > before and upto < before + size:
                chosen.append((at, upto))
            upto += rows
        if not chosen:
            return here.limit(0), before
        skipped = chosen[0][1]
        here = here.where(level.cast("long").between(chosen[0][0], chosen[-1][0]))
        if len(chosen) > 1:
            break
    return here, skipped


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key as a combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    chosen = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
