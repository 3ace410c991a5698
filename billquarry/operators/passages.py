"""Documents to pages, chunks and passages. A document stays one row until its pieces are exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry import vocabulary as V
from billquarry.functions import text as X
from billquarry.functions.text import strip
from billquarry.operators.lines import page_number, table_border

#: Pieces gathered in an inner array before it is put away: appending to a fold copies at most so many references.
_INNER = 256


def _no_pieces(kind: str) -> list[Column]:
    """Fields of a fold that gathers pieces of a type: full inner arrays, and the one being filled."""
    return [F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("filling")]


def _with_piece(acc: Column, piece: Column, ready: Column) -> list[Column]:
    """The two fields after ``piece``, which counts where ``ready`` holds."""
    turn = ready & (F.size(acc["filling"]) >= _INNER)
    return [
        F.when(turn, F.concat(acc["full"], F.array(acc["filling"]))).otherwise(acc["full"]).alias("full"),
        F.when(turn, F.array(piece)).when(ready, F.concat(acc["filling"], F.array(piece))).otherwise(acc["filling"]).alias("filling"),
    ]


def _pieces(acc: Column, last: Column, ready: Column) -> Column:
    """All pieces in order, and the last one where ``ready`` holds."""
    rest = F.when(ready, F.concat(acc["filling"], F.array(last))).otherwise(acc["filling"])
    return F.flatten(F.concat(acc["full"], F.array(rest)))


def pages_of(text: Column) -> Column:
    """Array of (page, text); without markers one page without a number; empty pages are dropped."""
    marker = X.IU + r"---\s*Page\s+\d+\s*---"

    def paired(parts: Column) -> Column:
        numbers = F.regexp_extract_all(text, F.lit(X.IU + r"---\s*Page\s+(\d+)\s*---"), F.lit(1))
        marked = F.zip_with(
            numbers, F.slice(parts, 2, F.size(parts)), lambda n, t: F.struct(n.try_cast("int").alias("page"), strip(t).alias("text"))
        )
        single = F.array(F.struct(F.lit(None).cast("int").alias("page"), strip(text).alias("text")))
        return F.when(F.size(parts) == 1, single).otherwise(F.filter(marked, lambda p: p["text"] != ""))

    return X.let(F.split(text, marker), paired)


def chunk_texts(text: Column, size: int = V.CHUNK_CHARS, overlap: int = V.CHUNK_OVERLAP) -> Column:
    """Blank-line paragraphs packed up to the size; longer blocks cut into overlapping windows."""
    paragraphs = F.filter(F.transform(F.split(text, X.U + r"\n\s*\n"), strip), lambda p: p != "")
    start = F.struct(*_no_pieces("string"), F.lit("").alias("current"))

    def pack(acc: Column, p: Column) -> Column:
        fits = F.length(acc["current"]) + F.length(p) + 2 <= size
        return F.struct(
            *_with_piece(acc, acc["current"], (acc["current"] != "") & ~fits),
            F.when(acc["current"] == "", p).when(fits, F.concat(acc["current"], F.lit("\n\n"), p)).otherwise(p).alias("current"),
        )

    blocks = F.aggregate(paragraphs, start, pack, lambda acc: _pieces(acc, acc["current"], acc["current"] != ""))
    step = size - overlap

    def cut(block: Column) -> Column:
        windows = F.greatest(F.ceil((F.length(block) - size) / step), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), windows), lambda k: strip(F.substring(block, k * step + 1, F.lit(size))))

    return F.filter(F.flatten(F.transform(blocks, cut)), lambda c: c != "")


def chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, chunk_index, page, text) of every document; empty documents give no chunk."""
    pieces = F.flatten(
        F.transform(
            pages_of(F.col(text)),
            lambda p: F.transform(chunk_texts(p["text"]), lambda t: F.struct(p["page"].alias("page"), t.alias("text"))),
        )
    )
    return docs.select(doc, F.posexplode(pieces).alias("chunk_index", "_c")).select(
        doc, "chunk_index", F.col("_c.page").alias("page"), F.col("_c.text").alias("text")
    )


#: A passage as its place among the non-blank lines of its document: index of its first line, number of lines, its page, lines
#: before that page, and whether it lies in an article table.
_RUN = "struct<first:int,n:int,page:int,base:int,tab:boolean>"


def line_passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", max_chars: int = V.PASSAGE_CHARS) -> DataFrame:
    """Passages of whole lines: at most six lines or about 450 characters, one line of overlap,
    broken where an article table opens or closes and at page markers.

    Lines are walked through once, carrying numbers only; passages are then cut out of the lines by their places.
    """
    def read(plain: Column) -> Column:
        return F.transform(
            X.split_lines(F.col(text)),
            lambda s, i: F.struct(
                # only spaces stand at the ends of a line where a text has no other white space
                F.length(s).alias("chars"), F.when(plain, F.trim(s)).otherwise(strip(s)).alias("text"), (i + 1).alias("gl"),
                page_number(s).alias("marker"), table_border(s).alias("border"),
            ),
        )

    lines = F.filter(X.let(X.plain_spaces(F.col(text)), read), lambda x: x["text"] != "")
    # place of the line and of the first pending one, whose side of a table's border all pending lines share; cost of them and of the last one
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("used"), F.lit(0).alias("last"), F.lit(False).alias("tab"),
        F.lit(1).alias("page"), F.lit(0).alias("base"), F.struct(*_no_pieces(_RUN)).alias("runs"),
    )
    goes_on, at_marker, at_border = F.lit(0), F.lit(1), F.lit(2)

    def run(acc: Column) -> Column:
        return F.struct(
            acc["first"].alias("first"), (acc["i"] - acc["first"]).alias("n"), acc["page"].alias("page"), acc["base"].alias("base"), acc["tab"].alias("tab")
        )

    def ends(acc: Column, x: Column) -> Column:
        """Which rule, found once, ends the pending lines before a line."""
        n = acc["i"] - acc["first"]
        return (
            F.when(x["marker"].isNotNull(), at_marker).when(n == 0, goes_on).when(x["border"] != acc["tab"], at_border)
            .when((n >= V.PASSAGE_LINES) | (acc["used"] + x["chars"] > max_chars), F.lit(3)).otherwise(goes_on)
        )

    def step(acc: Column, x: Column) -> Column:
        cost = F.length(x["text"]) + 1

        def state(first: Column, used: Column, page: Column, base: Column, runs: Column) -> Column:
            return F.struct(
                (acc["i"] + 1).alias("i"), first.alias("first"), used.alias("used"), cost.alias("last"), F.coalesce(x["border"], acc["tab"]).alias("tab"),
                page.alias("page"), base.alias("base"), runs.alias("runs"),
            )

        def next_state(e: Column) -> Column:
            put = F.struct(*_with_piece(acc["runs"], run(acc), F.lit(True)))
            first = F.when(e == at_marker, acc["i"] + 1).when(e == at_border, acc["i"]).otherwise(acc["i"] - 1)
            used = F.when(e == at_marker, 0).when(e == at_border, cost).otherwise(acc["last"] + cost)
            broken = state(
                first, used, F.coalesce(x["marker"], acc["page"]), F.when(e == at_marker, x["gl"]).otherwise(acc["base"]),
                F.when(acc["i"] > acc["first"], put).otherwise(acc["runs"]),
            )
            return F.when(e == goes_on, state(acc["first"], acc["used"] + cost, acc["page"], acc["base"], acc["runs"])).otherwise(broken)

        return X.let(ends(acc, x), next_state)

    def cut(xs: Column) -> Column:
        runs = F.aggregate(xs, start, step, lambda acc: _pieces(acc["runs"], run(acc), acc["i"] > acc["first"]))
        # lines are taken one by one: a slice would copy all lines of the document for every passage
        return F.transform(runs, lambda r: F.struct(r.alias("run"), F.transform(F.sequence(r["first"], r["first"] + r["n"] - 1), lambda k: F.get(xs, k)).alias("lines")))

    rows = docs.select(doc, F.posexplode(X.let(lines, cut)).alias("chunk_index", "_p"))
    first, last = F.get("_p.lines", F.lit(0))["gl"], F.element_at("_p.lines", -1)["gl"]
    base = F.col("_p.run.base")
    return rows.select(
        doc, "chunk_index", F.col("_p.run.page").alias("page"),
        F.concat(F.lit("P"), F.col("_p.run.page").cast("string"), F.lit(":L"), (first - base).cast("string"), F.lit("-"), (last - base).cast("string")).alias("source_id"),
        F.when(F.col("_p.run.tab"), "table").otherwise("text").alias("kind"),
        first.alias("line_start"), last.alias("line_end"),
        F.array_join(F.col("_p.lines.text"), "\n").alias("text"),
    )


def section_passages(lines: DataFrame, doc: str = "doc_id", max_chars: int = V.CHUNK_CHARS) -> DataFrame:
    """Consecutive lines grouped by page, layout block and announced section, cut at line ends.

    Input: one row per line (doc, line_id, page, text, block). A line without a
    hint stays in the current section of its block; a split article table repeats
    its header line. Ids are content hashes.
    """
    ordered = lines.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("line_id", "page", "block", "text"))).alias("_lines"))
    line_type = "struct<line_id:int,page:int,block:string,text:string>"
    hinted = F.transform(
        "_lines",
        lambda r: F.struct(
            F.struct(r["line_id"].alias("line_id"), r["page"].alias("page"), r["block"].alias("block"), r["text"].alias("text")).alias("line"),
            X.section_hint(r["text"]).alias("hint"),
        ),
    )
    part = f"struct<section:string,group:int,lines:array<{line_type}>>"
    start = F.struct(
        F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("block"), F.lit(0).alias("page"), F.lit(0).alias("group"),
        F.array().cast(f"array<{line_type}>").alias("header"), F.array().cast(f"array<{line_type}>").alias("pending"), F.lit(0).alias("size"),
        *_no_pieces(part),
    )

    def piece(acc: Column) -> Column:
        return F.struct(acc["section"].alias("section"), acc["group"].alias("group"), acc["pending"].alias("lines"))

    def step(acc: Column, x: Column) -> Column:
        line, hint = x["line"], x["hint"]
        same = (F.size(acc["pending"]) > 0) & acc["block"].eqNullSafe(line["block"]) & (acc["page"] == line["page"])
        section = F.coalesce(hint, F.when(same, acc["section"]), F.lit("other"))
        new_group = ~same | (hint.isNotNull() & ((section != acc["section"]) | (hint == "other")))
        full = ~new_group & (acc["size"] + F.length(line["text"]) > max_chars)
        none = F.array().cast(f"array<{line_type}>")
        header = F.when(new_group, F.when(hint == "line_items", F.array(line)).otherwise(none)).otherwise(acc["header"])
        pending = F.when(new_group, F.array(line)).when(full, F.concat(acc["header"], F.array(line))).otherwise(F.concat(acc["pending"], F.array(line)))
        size = F.when(new_group, F.length(line["text"]) + 1).when(
            full, F.aggregate(acc["header"], F.lit(0), lambda a, h: a + F.length(h["text"]) + 1) + F.length(line["text"]) + 1
        ).otherwise(acc["size"] + F.length(line["text"]) + 1)
        return F.struct(
            section.alias("section"), line["block"].alias("block"), line["page"].alias("page"),
            F.when(new_group, acc["group"] + 1).otherwise(acc["group"]).alias("group"), header.alias("header"), pending.alias("pending"),
            size.alias("size"), *_with_piece(acc, piece(acc), (new_group | full) & (F.size(acc["pending"]) > 0)),
        )

    found = F.aggregate(hinted, start, step, lambda acc: _pieces(acc, piece(acc), F.size(acc["pending"]) > 0))
    rows = ordered.select(doc, F.posexplode(found).alias("chunk_index", "_p"))
    payload = F.array_join(F.transform("_p.lines", lambda r: r["text"]), "\n")
    ids = F.array_join(F.transform("_p.lines", lambda r: r["line_id"].cast("string")), ",")
    return rows.select(
        doc, "chunk_index", F.col("_p.section").alias("section"), F.get("_p.lines", F.lit(0))["page"].alias("page"),
        F.concat(F.lit("C"), F.substring(F.sha2(F.concat_ws("|", F.col(doc).cast("string"), F.col("_p.group").cast("string"), ids, payload), 256), 1, 20)).alias("chunk_id"),
        ids.alias("line_ids"), payload.alias("text"),
    )
