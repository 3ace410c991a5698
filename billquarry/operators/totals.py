"""Printed amounts: labelled totals, tax rows, discounts, stamp pairs, ambiguous rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry import vocabulary as V
from billquarry.functions import text as X
from billquarry.functions.money import AMOUNT, ocr_amount, strict_amount
from billquarry.operators.lines import first_index

_AMOUNT = r"(?:\d{1,3}(?:[ .]\d{3})+(?:,\d{1,3})?|\d+(?:[,.]\d{1,3})?)"
_HEADER = r"\b(?:code|reference|référence|article|designation|désignation|quantit[ée]|prix|unitaire)\b"
_TAX_CODE = r"\bcode\s+t\.?\s*v\.?\s*a\.?\b|\bt\.?\s*v\.?\s*a\.?\s*:"

_HEADER_STEMS = ("code", "ence", "article", "design", "désign", "quantit", "prix", "unitaire")

# label patterns per amount, and whether the last or the largest match counts (fixed values)
LABELS = {
    "subtotal": ([r"\btotal\s+(?:net\s+)?h\.?\s*t\.?\b", r"\btotal\s+hors\s+taxes\b", r"\bmontant\s+h\.?\s*t\.?\b", r"\bnet\s+h\.?\s*t\.?\b"], "max"),
    "tax_amount": ([r"\bt\.?\s*v\.?\s*a\.?\b", r"\btax\s+amount\b"], "last"),
    "stamp_duty": ([r"\btimbre(?:\s+fiscal)?\b", r"\bstamp\s+duty\b"], "last"),
    "total_amount": (
        [r"\btotal\s+t\.?\s*t\.?\s*c\.?\b", r"\bmontant\s+t\.?\s*t\.?\s*c\.?\b", r"\bmontant\s+total\s+de\s+la\s+facture\b", r"\bnet\s+(?:à|a)\s+payer\b"],
        "max",
    ),
    "net_payable": ([r"\bnet\s+(?:à|a)\s+payer\b", r"\bmontant\s+(?:à|a)\s+payer\b"], "max"),
}
# any label of them; a first letter is looked at before the word border that all begin with
_ANY_LABEL = r"(?=[tmns])\b(?:" + "|".join(p.removeprefix(r"\b") for patterns, _ in LABELS.values() for p in patterns) + ")"
# pieces of which every label holds one
_LABEL_STEMS = ("tota", "mont", "net", "timb", "stamp", "tax", "v")
# amounts a printed label must precede, per field (fixed values); first characters of the labels are looked at first
SOURCE_LABELS = {
    "subtotal": r"(?=[tmhsا])(?:total\s+(?:net\s+)?HT|montant\s+HT|sub[ _]?total|hors\s+taxes?|المبلغ\s+دون\s+احتساب\s+[اأ]ل[اأ]داء)",
    "tax_amount": r"(?=[tvاأ])(?:T\.?V\.?A\.?|VAT|tax(?:\s+amount)?|[اأ]ل[اأ]داء\s+على\s+القيمة\s+المضافة)",
    "stamp_duty": r"(?=[tsم])(?:timbre(?:\s+fiscal)?|stamp(?:\s+duty)?|معلوم\s+الطابع)",
    "total_amount": (
        r"(?=[tmnga\sا])(?:total\s+TTC|montant\s+(?:total\s+(?:de\s+la\s+facture\s+)?)?(?:\(en\s+(?:DT|TND)\s+TTC\)|TTC)|net\s+[aà]\s+payer|total\s+amount|"
        r"grand\s+total|المبلغ\s+الجملي|(?m:^\s*total\b(?!\s*(?:HT|TVA|tax))))"
    ),
}


def _non_blank(text: Column) -> Column:
    return F.filter(X.split_lines(text), lambda s: F.trim(s) != "")


def _tidy(line: Column) -> Column:
    return F.btrim(X.squeeze(line), F.lit(" |:;"))


def tidy_lines(text: Column) -> Column:
    """Non-blank lines, blanks squeezed, edge punctuation removed."""
    # one look at the whole text tells whether any line has blanks to squeeze
    plain = F.transform(F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""), lambda s: F.btrim(s, F.lit(" |:;")))
    return F.when(X.plain_blanks(text), plain).otherwise(F.transform(_non_blank(text), _tidy))


def label_lines(low: Column) -> Column:
    """The lines of a text that name some amount, apart from tax codes and table heads: each with the lines ``above`` and ``below`` it.

    The text comes in lower case (``sought``); lines are as ``tidy_lines`` gives them. They are found once for all fields: each
    then looks at the few lines that are left.
    """
    return _marked(_non_blank(low), _tidy)


def _marked(lines: Column, tidy: Callable[[Column], Column]) -> Column:
    def find(kept: Column) -> Column:
        def mark(line: Column, i: Column) -> Column:
            around = F.struct(tidy(line).alias("line"), tidy(F.get(kept, i + 1)).alias("below"), tidy(F.get(kept, i - 1)).alias("above"))
            # most lines hold no such word, which is cheaper to tell than that they hold no label
            return F.when(X.any_in(line, *_LABEL_STEMS) & line.rlike(X.U + _ANY_LABEL), around)

        return F.array_compact(F.transform(kept, mark))

    def other(line: Column) -> Column:
        return (X.any_in(line, "code", ":") & line.rlike(X.U + _TAX_CODE)) | (X.any_in(line, *_HEADER_STEMS) & line.rlike(X.U + _HEADER))

    return F.filter(X.let(lines, find), lambda m: ~other(m["line"]))


def labelled_money(lines: Column, field: str) -> Column:
    """Amount next to a label: on its line after it, else alone on the next line, else (totals) on the line before."""
    return labelled_among(_marked(F.transform(lines, X.sought), lambda s: s), field)


def labelled_among(marked: Column, field: str) -> Column:
    """The labelled amount of a field, from the lines that ``label_lines`` found."""
    patterns, prefer = LABELS[field]
    any_label = X.any_of(patterns)

    def positive(tokens: Column) -> Column:
        return F.filter(F.transform(tokens, lambda t: ocr_amount(t)), lambda v: v > 0)

    def candidate(m: Column) -> Column:
        line = m["line"]
        after = F.regexp_replace(line, X.U + "^.*?" + any_label, "")
        own = positive(F.regexp_extract_all(after, F.lit("(" + _AMOUNT + ")(?![%0-9])"), F.lit(1)))
        following = F.regexp_replace(m["below"], X.U + r"\s*(?:tnd|dt)\s*$", "")
        below = F.when(following.rlike(f"^{_AMOUNT}$"), positive(F.array(following)))
        above = F.when(
            line.rlike(X.U + r"t\.?\s*t\.?\s*c\.?|net\s+(?:à|a)\s+payer"), positive(F.regexp_extract_all(m["above"], F.lit(_AMOUNT), F.lit(0))),
        )
        return F.when(
            line.rlike(X.U + any_label),
            X.let(own, lambda o: F.when(F.size(o) > 0, F.element_at(o, -1)).otherwise(
                X.let(below, lambda b: F.when(F.size(b) > 0, F.element_at(b, -1)).otherwise(F.try_element_at(above, F.lit(-1))))
            )),
        )

    found = F.array_compact(F.transform(marked, candidate))
    return F.array_max(found) if prefer == "max" else F.try_element_at(found, F.lit(-1))


def tax_rate(text: Column) -> Column:
    """Largest rate in (0, 30] printed near a tax word, else of any percentage; as printed text."""
    return F.when(text.contains("%"), _tax_rate(text))


def _tax_rate(text: Column) -> Column:
    near = X.grab_all(text, r"(?=tva|taxe|vat)(?:tva|taxe|vat)[^0-9\n\r%]{0,20}([0-9]{1,2}(?:[,.][0-9]+)?)\s*%")
    anywhere = X.grab_all(text, r"(?=[0-9])\b([0-9]{1,2}(?:[,.][0-9]+)?)\s*%", flags=X.U)
    chosen = X.let(near, lambda n: F.when(F.size(n) > 0, n).otherwise(anywhere))
    rates = F.filter(F.transform(chosen, lambda r: ocr_amount(r)), lambda r: (r > 0) & (r <= 30))
    shown = F.regexp_replace(F.regexp_replace(F.array_max(rates).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(F.translate(shown, ".", ","), F.lit("%"))


TAX_ROW = r"(?=[ftv])\b(FODEC|TVA|VAT)\b[ \t|:]*\(?[ \t]*(\d+(?:[.,]\d+)?)[ \t]*%[ \t]*\)?[ \t|:]*(" + V.STRICT_NUMBER + r")(?![\d.,])"


def tax_rows(text: Column) -> Column:
    """Labelled taxes printed with a rate and an amount: label, rate, amount, line, line text."""

    def of_line(line: Column, i: Column) -> Column:
        parts = [F.regexp_extract_all(line, F.lit(X.IU + TAX_ROW), F.lit(g)) for g in (1, 2, 3)]
        # most lines hold no tax, which one look tells instead of three
        return F.transform(
            F.when(line.rlike(X.IU + TAX_ROW), F.arrays_zip(parts[0].alias("a"), parts[1].alias("b"), parts[2].alias("c"))).otherwise(
                F.array().cast("array<struct<a:string,b:string,c:string>>")
            ),
            lambda z: F.struct(
                F.upper(z["a"]).alias("label"), strict_amount(z["b"]).alias("rate"), strict_amount(z["c"]).alias("amount"),
                (i + 1).alias("line_id"), line.alias("source"),
            ),
        )

    return F.flatten(F.transform(X.split_lines(text), of_line))


# printed taxable base (fixed value)
TAX_BASE = r"\bbase(?:\s+(?:HT|imposable))?[ \t:|=]*(" + V.STRICT_NUMBER + ")"


def printed_base(text: Column) -> Column:
    """The first taxable base that a text prints."""
    return strict_amount(X.grab(text, TAX_BASE))


def supported_tax(proposed: DataFrame, printed: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """Proposed tax rows for which exactly one printed row has the same rate and amount.

    A proposed ``base`` that is not missing must be the one that ``bases`` (doc_id, printed_base) has for the document; a
    base is never inferred from a rate or from other totals.
    """
    keys = ["doc_id", "rate", "amount"]
    counted = printed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("label"), F.min("line_id").alias("line_id"))
    found = proposed.join(counted.filter(F.col("_n") == 1).drop("_n"), keys, "left")
    if bases is None:
        return found.withColumn("supported", F.col("label").isNotNull())
    based = F.col("base").isNull() | F.coalesce(F.col("base") == F.col("printed_base"), F.lit(False))
    return found.join(bases, "doc_id", "left").withColumn("supported", F.col("label").isNotNull() & based)


_DISCOUNT_CELL = r"^(?:remise|discount|rabais)(?:\s+\d+(?:[.,]\d+)?\s*%)?$"
_DISCOUNT_TABLE = r"designation|désignation|description|article|quantit|quantity|prix|unit\s*price|MT\s*HT"
_DISCOUNT_LINE = (
    r"(?=[rd])\b(?:remise|discount|rabais)[ \t:|=]*(?:\(?[ \t]*(\d+(?:[.,]\d+)?)[ \t]*%[ \t]*\)?[ \t:|=]*)?(?:\(-\)[ \t]*)?("
    + V.STRICT_NUMBER + r")(?![\d.,]|[ \t]*%)"
)
_DISCOUNT_TYPE = f"array<struct<scope:string,amount:{AMOUNT},rate:{AMOUNT},line_id:int,row_text:string>>"


def discounts(text: Column, low: Column | None = None) -> Column:
    """Discount cells of article rows and discount lines of the invoice, with their scope."""

    def cells(line: Column) -> Column:
        return F.transform(F.split(line, r"\|"), lambda c: F.trim(c))

    def entry(scope: str, amount: Column, rate: Column, line_id: Column, row: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), amount.alias("amount"), rate.alias("rate"), line_id.cast("int").alias("line_id"), row.alias("row_text"))

    def read(line: Column, i: Column) -> Column:
        """What a line is by itself, found once: its cells, whether it is a head and which column it names, an invoice discount."""

        def of_cells(found: Column) -> Column:
            marks = F.transform(found["cells"], lambda c: c.rlike(X.IU + _DISCOUNT_CELL))
            return X.let(marks, lambda m: F.struct(
                found["cells"].alias("cells"), F.size(m).alias("width"), (F.array_position(m, True) - 1).cast("int").alias("column"),
                ((F.size(m) >= 3) & (F.size(F.filter(m, lambda x: x)) == 1) & line.rlike(X.IU + _DISCOUNT_TABLE)).alias("head"),
            ))

        def judged(f: Column) -> Column:
            other = ~f["head"] & line.rlike(X.IU + _DISCOUNT_LINE) & ~line.rlike(X.IU + r"designation|désignation|description|quantit|quantity|prix\s+unitaire")
            return F.struct(
                line.alias("line"), (i + 1).alias("line_id"), f["cells"].alias("cells"), f["width"].alias("width"), f["column"].alias("column"), f["head"].alias("head"),
                F.when(other, strict_amount(F.regexp_extract(line, X.IU + _DISCOUNT_LINE, 2))).alias("invoice"),
            )

        return X.let(X.let(F.struct(cells(line).alias("cells")), of_cells), judged)

    def walk(lines: Column) -> Column:
        """One pass: a table head sets the column, rows of the same width add items, other lines end the table."""
        start = F.struct(
            F.lit(0).alias("width"), F.lit(-1).alias("column"), F.lit(None).cast(AMOUNT).alias("rate"), F.array().cast(_DISCOUNT_TYPE).alias("found")
        )

        def step(acc: Column, x: Column) -> Column:
            def moved(amount: Column) -> Column:
                in_row, head, line = amount.isNotNull(), x["head"], x["line"]
                wrapped = (acc["width"] > 0) & (x["width"] == 1) & ~line.rlike(X.IU + "total|montant|taxe|TVA|FODEC")
                invoice_rate = strict_amount(F.regexp_extract(line, X.IU + _DISCOUNT_LINE, 1))
                added = F.when(in_row, entry("item", amount, acc["rate"], x["line_id"], line)).when(
                    x["invoice"].isNotNull(), entry("invoice", x["invoice"], invoice_rate, x["line_id"], line)
                )
                return X.let(F.struct((in_row | wrapped).alias("keep"), added.alias("added")), lambda n: F.struct(
                    F.when(head, x["width"]).when(n["keep"], acc["width"]).otherwise(0).alias("width"),
                    F.when(head, x["column"]).when(n["keep"], acc["column"]).otherwise(-1).alias("column"),
                    F.when(head, strict_amount(F.regexp_extract(F.get(x["cells"], x["column"]), r"(\d+(?:[.,]\d+)?)\s*%", 1))).when(n["keep"], acc["rate"]).alias("rate"),
                    F.when(n["added"].isNotNull(), F.concat(acc["found"], F.array(n["added"]))).otherwise(acc["found"]).alias("found"),
                ))

            cell = F.when(~x["head"] & (acc["width"] > 0) & (x["width"] == acc["width"]), strict_amount(F.get(x["cells"], acc["column"])))
            return X.let(cell, moved)

        return F.aggregate(F.transform(lines, read), start, step, lambda acc: acc["found"])

    # a text without a discount word has none
    if low is None:
        return X.let(X.sought(text), lambda made: discounts(text, made))
    return X.let(text, lambda t: F.when(X.any_in(low, "remise", "discount", "rabais"), X.let(X.split_lines(t), walk)).otherwise(F.array().cast(_DISCOUNT_TYPE)))


def invoice_discount(entries: Column) -> Column:
    """The invoice's own discount when it is the only one, else a lone item discount."""

    def choose(all_entries: Column) -> Column:
        own = F.filter(all_entries, lambda e: e["scope"] == "invoice")
        return X.let(F.when(F.size(own) > 0, own).otherwise(all_entries), lambda kept: F.when(F.size(kept) == 1, F.get(kept, F.lit(0))))

    return X.let(entries, choose)


def stamp_pairs(text: Column) -> Column:
    """A stamp label line followed by a line that is one amount."""

    def pairs(lines: Column) -> Column:
        return F.array_compact(
            F.transform(
                lines,
                lambda line, i: F.when(
                    line.rlike(X.IU + r"^\s*(?:timbre(?:\s+fiscal)?|stamp(?:\s+duty)?)[\s:|=().%]*$") & strict_amount(F.get(lines, i + 1)).isNotNull(),
                    F.struct(strict_amount(F.get(lines, i + 1)).alias("amount"), (i + 1).alias("line_id")),
                ),
            )
        )

    return X.let(X.split_lines(text), pairs)


def source_amounts(text: Column, field: str, lowered: bool = False) -> Column:
    """Amounts printed right after the field's own label; rates are skipped. A text ``lowered`` by ``sought`` is searched as it is."""
    western = X.western_digits(text)
    pattern = (
        SOURCE_LABELS[field].lower() + r"(?:[\s|]*\(?\d{1,2}(?:[.,]\d+)?\s*%\)?)*[\s:|=]*(?:tnd|usd|eur|\$|€)?\s*(" + V.STRICT_NUMBER + r")(?![\d.,]|\s*%)"
    )
    found = F.transform(X.grab_all(western, pattern, flags=X.U if lowered else X.IU), lambda t: strict_amount(t))
    return F.concat(found, F.transform(stamp_pairs(text), lambda p: p["amount"])) if field == "stamp_duty" else found


def money_in_source(field: Column, value: Column, text: Column, lowered: bool = False) -> Column:
    """The value follows its own label somewhere in the text."""
    out = F.lit(False)
    for name in SOURCE_LABELS:
        out = F.when(field == name, F.exists(source_amounts(text, name, lowered), lambda a: a == value)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def ambiguous_amount(field: str, value: Column, text: Column) -> Column:
    """Line number of a labelled value that an orphan amount follows, NULL when there is none."""

    def scan(lines: Column) -> Column:
        def hit(line: Column, i: Column) -> Column:
            first = F.trim(F.get(F.split(F.get(lines, i + 1), r"\|"), F.lit(0)))
            others = F.filter(F.split(F.get(lines, i + 1), r"\|"), lambda _, n: n > 0)
            # an amount begins with a digit, which most lines do not
            orphan = F.left(first, F.lit(1)).between("0", "9") & strict_amount(first).isNotNull() & first.rlike(r"[.,]\d{2,3}$") & (strict_amount(first) != value)
            return F.when(
                # few lines stand before an orphan, so labels are looked for last
                orphan & F.exists(source_amounts(line, field), lambda a: a == value) & ~F.exists(others, lambda c: F.trim(c).rlike(X.IU + V.NEW_LABEL)), i + 1
            )

        return F.array_min(F.transform(lines, hit))

    return X.let(X.split_lines(text), scan)
