"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything runs on SQL expressions and Spark's own forest. A candidate is a value after a secret's name and ``=`` or ``:``,
or a run of sixteen or more key characters with a digit or in capitals. The forest sees its length and characters,
the changes between kinds of characters, how much of it the corpus's own words cover, the document's path and the words
beside it, and is trained from labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry.llm.shared import stash

NAMES = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
ASSIGNED = NAMES + r"""["']?[ \t]{0,3}[=:][ \t]{0,3}["']?"""
RUN = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*[0-9]|[A-Z0-9]{16})[A-Za-z0-9_+/\-]{16,}={0,2}"
CANDIDATE = ASSIGNED + r"""[^\s"']{6,}|""" + RUN
#: Paths of text that is no secret of its own, and words beside a candidate that speak for one.
HARMLESS_PATH, SECRET_WORDS = r"(?i)test|example|sample|mock|fixture|doc", r"(?i)pass|pwd|secret|token|key|credential|auth|login|bearer"
#: Characters of text looked at on either side; times a word must occur to be in the dictionary.
BESIDE, COMMON = 40, 3
#: Documents that labelled findings are derived from, at most; a bounded sample for training alone.
TRAINING_DOCUMENTS = 3000
#: Score from which a candidate is a secret; trees and depth of the forest.
THRESHOLD, TREES, DEPTH = 0.5, 24, 7
REDACTED = "[secret]"

FEATURES = [
    "length", "digits", "capitals", "distinct", "marks", "digit_changes", "case_changes", "longest_letters", "longest_digits", "only_hex",
    "named", "assigned", "quoted", "word_before", "harmless_path", "covered",
]


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = "source") -> DataFrame:
    """One row for each candidate: ``doc_id``, ``text_hash``, ``nth`` in its text, ``start`` and ``length`` of the value in characters,
    ``value``, ``before``, ``after``, ``path``. Rows of ``docs`` with the same id and text count once."""
    value = F.col(text)
    where_from = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    found = docs.where(value.rlike(CANDIDATE)).select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(value).alias("text_hash"), where_from.alias("path"),
        F.split(value, CANDIDATE, -1).alias("gaps"), F.regexp_extract_all(value, F.lit(CANDIDATE), F.lit(0)).alias("hits"),
    )
    each = found.select(
        "doc_id", "text_hash", "path",
        F.posexplode(
            F.expr(
                f"transform(hits, (h, i) -> struct(h AS hit, length(gaps[i]) AS gap, right(gaps[i], {BESIDE}) AS before, left(gaps[i + 1], {BESIDE}) AS after))"
            )
        ).alias("nth", "c"),
    ).groupBy("doc_id", "text_hash", "nth", "c").agg(F.min("path").alias("path"))
    name = F.regexp_extract("c.hit", f"^(?:{ASSIGNED})?", 0)
    # running lengths within one text: the window is never longer than the text
    ends = "SUM(length(c.hit) + c.gap) OVER (PARTITION BY doc_id, text_hash ORDER BY nth)"
    return each.withColumn("name", name).selectExpr(
        "doc_id", "text_hash", "nth", f"CAST({ends} - length(c.hit) + length(name) AS BIGINT) AS start", "CAST(length(c.hit) - length(name) AS BIGINT) AS length",
        "substring(c.hit, length(name) + 1) AS value", "c.before || name AS before", "c.after AS after", "path",
    )


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Words of four letters or more that occur ``COMMON`` times in all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"\P{L}+")).alias("word")).where(F.length("word").between(4, 60))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).select("word")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the columns of FEATURES; needs ``value``, ``before``, ``path``."""
    runs = F.expr("array_distinct(regexp_extract_all(lower(value), '[a-z]{4,}', 0))")
    known = (
        found.select(F.explode(runs).alias("word")).distinct().join(words, "word", "left_semi")
    )
    values = found.select("value", F.explode(runs).alias("word")).distinct()
    covering = values.join(known, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covering"))
    covering = stash(covering, "covered-values")  # the join below is then fed by shuffles alone, and a hot value can be split

    def count(pattern: str) -> Column:
        return F.regexp_count("value", F.lit(pattern)).cast("double")

    def longest(kind: str) -> Column:
        return F.expr(f"COALESCE(array_max(transform(regexp_extract_all(value, '{kind}+', 0), r -> length(r))), 0)").cast("double")

    def says(column: str, pattern: str) -> Column:
        return F.coalesce(F.col(column).rlike(pattern), F.lit(False)).cast("double")

    size = F.greatest(F.length("value"), F.lit(1))
    return found.join(covering, "value", "left").select(
        *found.columns,
        F.length("value").cast("double").alias("length_"), (count("[0-9]") / size).alias("digits"), (count("[A-Z]") / size).alias("capitals"),
        (F.size(F.array_distinct(F.split("value", ""))) / size).cast("double").alias("distinct"), (count("[^A-Za-z0-9]") / size).alias("marks"),
        (count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])") / size).alias("digit_changes"), (count("(?<=[a-z])(?=[A-Z])") / size).alias("case_changes"),
        longest("[A-Za-z]").alias("longest_letters"), longest("[0-9]").alias("longest_digits"), says("value", "^[0-9a-fA-F]+$").alias("only_hex"),
        says("before", ASSIGNED + "$").alias("named"), says("before", "[=:][ \t]{0,3}[\"']?$").alias("assigned"), says("before", "[\"']$").alias("quoted"),
        says("before", SECRET_WORDS).alias("word_before"), says("path", HARMLESS_PATH).alias("harmless_path"),
        F.least(F.coalesce("covering", F.lit(0)) / size, F.lit(1.0)).cast("double").alias("covered"),
    )


_INPUTS = ["length_", *FEATURES[1:]]


def train(findings: DataFrame, words: DataFrame) -> RandomForestClassificationModel:
    """A forest from labelled findings: ``value``, ``before``, ``path``, ``label`` (0.0 or 1.0), a bounded number of rows."""
    rows = VectorAssembler(inputCols=_INPUTS, outputCol="features").transform(with_features(findings, words)).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=0.8)
    return forest.fit(rows.coalesce(1).sortWithinPartitions("label", F.col("features").cast("string")))


def derived_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labelled findings derived from up to ``TRAINING_DOCUMENTS`` texts, those with the smallest hashes.

    Secrets are digests of a text in the usual alphabets, bare or after a name; what is none are long words of the text,
    plain, in capitals or joined, runs of digits, versions and paths. The words beside them are the text's own.
    """
    texts = docs.where(F.length(text) > 0).select(F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    smallest = stash(texts.select("h").distinct().orderBy("h").limit(TRAINING_DOCUMENTS), "training-texts")
    sample = texts.join(smallest, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    parts = sample.select(
        "h", F.sha2("text", 512).alias("hex"), F.base64(F.unhex(F.sha2("text", 512))).alias("b64"),
        F.expr("filter(split(substring(text, 1, 4000), '[^A-Za-z]+'), w -> length(w) > 5)").alias("words"), F.expr("split(left(text, 300), '\\\\s+')").alias("near"),
    ).select(
        "h", "hex", F.regexp_replace("b64", "[^A-Za-z0-9]", "").alias("key"), "b64", F.concat_ws(" ", F.slice("near", 2, 4)).alias("beside"),
        F.expr("concat_ws('', slice(words, 1, 4)) || 'and'").alias("joined"), F.expr("concat_ws('-', slice(words, 2, 3)) || '-' || (abs(h) % 3000)").alias("dashed"),
        F.expr("concat_ws('/', slice(words, 3, 3)) || '/' || (abs(h) % 90000)").alias("route"), F.expr("translate(substring(hex, 20, 40), 'abcdef', '123456')").alias("numbers"),
    )
    names = F.expr("element_at(array('password=', 'token = \"', 'secret: ', 'api_key = ', 'access-key: '), CAST(pmod(h, 5) + 1 AS INT))")
    made = [
        (1.0, "substring(hex, 1, 40)", True), (1.0, "substring(hex, 41, 16 + abs(h) % 8)", True), (1.0, "substring(hex, 1, 32 + 8 * (abs(h) % 5))", False),
        (1.0, "substring(key, 1, 20 + abs(h) % 25)", True), (1.0, "'AKIA' || upper(substring(key, 20, 16))", False), (1.0, "substring(b64, 30, 36)", True),
        (1.0, "substring(key, 30, 32 + abs(h) % 9)", False), (1.0, "upper(substring(hex, 60, 32))", False),
        (0.0, "joined", False), (0.0, "upper(joined)", False), (0.0, "upper(left(joined, 16 + abs(h) % 6))", False), (0.0, "substring(numbers, 1, 16)", False), (0.0, "substring(numbers, 1, 16 + abs(h) % 8)", False),
        (0.0, "dashed", False), (0.0, "route", False), (0.0, "'version-' || (abs(h) % 10) || '-' || left(joined, 12)", False), (0.0, "'<' || left(joined, 9) || '>'", True),
    ]
    return parts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(label).alias("label"), F.expr(value).alias("value"), F.concat("beside", F.lit(" "), names if named else F.lit("")).alias("before"))
                    for label, value, named in made
                ]
            )
        ).alias("f")
    ).select("f.*", F.lit(None).cast("string").alias("path")).where(F.length("value") >= 6)


def scan(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", path: str | None = "source") -> DataFrame:
    """Candidates of all texts with their ``score`` and ``secret`` (a score of ``THRESHOLD`` or more).

    ``findings``: labelled findings to train from (``value``, ``before``, ``path``, ``label``); without them, or with fewer
    than two labels in them, they are derived from the texts. Missing and empty texts hold no candidate; texts of any
    length are searched whole; rows with the same id and text count once; rows without an id are scanned; if no text has
    words at all there is nothing to train from, and a candidate is a secret where a name is before it. Other columns are not used.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(path) if path and path in docs.columns else F.lit(None)).cast("string").alias("source"))
    found = stash(candidates(narrow), "candidates")
    words = stash(dictionary(narrow), "dictionary")
    if findings is None or findings.select("label").distinct().count() < 2:
        findings = derived_findings(narrow)
    rows = stash(findings, "findings")
    featured = with_features(found, words)
    if rows.select("label").distinct().count() < 2:
        return featured.withColumn("score", F.col("named")).withColumn("secret", F.col("named") > 0).select(*found.columns, "score", "secret")
    scored = train(rows, words).transform(VectorAssembler(inputCols=_INPUTS, outputCol="features").transform(featured))
    return scored.withColumn("score", F.round(vector_to_array("probability")[1], 6)).withColumn("secret", F.col("score") >= THRESHOLD).select(*found.columns, "score", "secret")


def redact(docs: DataFrame, text: str = "text", characters: str = "n_chars", path: str | None = "source") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``REDACTED``; names before it and all other columns stay.

    A column named ``characters`` is set to the new length of texts that change. Rows are told apart by their text alone.
    """
    numbered = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(path) if path and path in docs.columns else F.lit(None)).cast("string").alias("source"))
    secrets = scan(numbered, path="source").where("secret").groupBy("text_hash").agg(F.collect_set("nth").alias("places"))
    known = stash(secrets, "secrets").select(F.col("text_hash").alias("secret_hash"), F.col("places").alias("secret_places"))
    value = F.col("`" + text.replace("`", "``") + "`")
    row = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"), value.alias("text"))
    joined = row.join(known, F.xxhash64("text") == F.col("secret_hash"), "left")
    hits = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    parts = joined.withColumn("hits", F.when(F.col("secret_hash").isNotNull(), hits)).withColumn("gaps", F.when(F.col("secret_hash").isNotNull(), F.split("text", CANDIDATE, -1)))
    named = f"^(?:{ASSIGNED})?"
    between = F.transform(
        "hits",
        lambda h, i: F.concat(F.col("gaps")[i], F.when(F.array_contains("secret_places", i), F.concat(F.regexp_extract(h, named, 0), F.lit(REDACTED))).otherwise(h)),
    )
    cleaned = F.concat(F.array_join(between, ""), F.element_at("gaps", -1))
    renewed = parts.withColumn("cleaned", F.when(F.col("secret_hash").isNotNull(), cleaned).otherwise(F.col("text")))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.col("cleaned").alias(c))
        elif c == characters:
            kind = docs.schema[c].dataType
            out.append(F.when(F.col("secret_hash").isNotNull(), F.length("cleaned").cast(kind)).otherwise(F.col("row")[c]).alias(c))
        else:
            out.append(F.col("row")[c].alias(c))
    return renewed.select(*out)
