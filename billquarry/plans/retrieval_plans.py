"""Retrieval queries: documents as corpus, benchmark passages as questions, rendered invoices for fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from billquarry.operators import hybrid as H
from billquarry.operators import passages as P
from billquarry.operators import ranking as K
from billquarry.operators import retrieval as T
from billquarry.operators import vectors as VI
from billquarry.plans import bindings as B
from billquarry.plans import rendering as R
from billquarry.plans.join_plans import CHUNK_ROWS
from billquarry.plans.registry import query
from billquarry.storage import written

FOLD = "replace(translate(lower({0}), 'àáâäãåçèéêëìíîïñòóôöõùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ß', 'ss')"
WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}\p{{M}}_]+')"


def folded_words(column: str) -> str:
    return WORDS.format(FOLD.format(column))


def corpus(spark, d):
    return P.chunks(B.documents(spark, d).select("doc_id", "text")).drop("page")


def questions(spark, d):
    return B.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


HASH = "CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 384 AS dim, CASE WHEN CAST('0x' || substr(md5(t), 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s"


def hash_sql(name: str, keys: str, source: str, text: str = "text") -> str:
    return f"""{name}_t AS (SELECT {keys}, unnest({WORDS.format(f'lower({text})')}) AS t FROM {source}),
 {name} AS (SELECT {keys}, dim, CAST(sum(s) AS BIGINT) AS weight FROM (SELECT {keys}, {HASH} FROM {name}_t) GROUP BY {keys}, dim HAVING sum(s) <> 0)"""


@query("ret_hash_embedding", B.with_ctes(hash_sql("h", "doc_id", "documents"), body="SELECT doc_id, dim, weight, CAST(sum(weight * weight) OVER (PARTITION BY doc_id) AS BIGINT) AS norm2 FROM h"))
def ret_hash_embedding(spark, d):
    weights = T.hash_weights(B.documents(spark, d), ["doc_id"])
    return weights.join(T.squared_norms(weights, ["doc_id"]), "doc_id")


@query("ret_cosine", """SELECT qid, vec_id, round(c, 4) AS cosine, r AS rank FROM (SELECT qid, vec_id, c, row_number() OVER (PARTITION BY qid ORDER BY round(c, 6) DESC, vec_id) AS r FROM
    (SELECT q.vec_id AS qid, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS c FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE r <= 10""")
def ret_cosine(spark, d):
    """Every fiftieth vector as a query against all vectors: the ten nearest, through the index, none missed."""
    vectors = B.table(spark, d, "embeddings")
    found = VI.search(VI.build(vectors, "vec_id", "embedding"), vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return found.select("qid", F.col("id").alias("vec_id"), F.round("cosine", 4).alias("cosine"), "rank")


@query("ret_cosine_probes")
def ret_cosine_probes(spark, d):
    """The same queries, of which each reads the twelve nearest cells only."""
    vectors = B.table(spark, d, "embeddings")
    found = VI.search(VI.build(vectors, "vec_id", "embedding"), vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, probes=12)
    return found.select("qid", F.col("id").alias("vec_id"), F.round("cosine", 4).alias("cosine"), "rank")


@query("ret_cosine_label", """WITH q AS (SELECT label, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 4) AS cosine FROM embeddings e JOIN q ON e.label = q.label""")
def ret_cosine_label(spark, d):
    """Every vector against the first vector of its label."""
    vectors = B.table(spark, d, "embeddings")
    firsts = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return vectors.join(firsts, "label").select("vec_id", F.round(T.dense_cosine(F.col("embedding"), F.col("q")), 4).alias("cosine"))


LEXICAL = f"""asked AS (SELECT item_id AS qid, list_filter({folded_words('text')}, lambda x: length(x) > 1) AS tok FROM benchmark),
 qt AS (SELECT qid, unnest(tok) AS token, len(tok) AS n FROM asked), qn AS (SELECT qid, token, n, count(*) AS repeats FROM qt GROUP BY ALL),
 ct AS (SELECT DISTINCT doc_id, chunk_index, unnest({folded_words('text')}) AS token FROM chunks),
 lex AS (SELECT qid, doc_id, chunk_index, least(1.0, CAST(sum(repeats) AS DOUBLE) / min(n)) AS lexical FROM qn JOIN ct USING (token) GROUP BY 1, 2, 3)"""


@query("ret_lexical_overlap", B.with_ctes(CHUNK_ROWS, LEXICAL, body="""SELECT qid, doc_id, chunk_index, round(lexical, 6) AS lexical, r AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, doc_id, chunk_index) AS r FROM lex) WHERE r <= 20"""))
def ret_lexical_overlap(spark, d):
    best = H.lexical(questions(spark, d), corpus(spark, d), ["doc_id", "chunk_index"], 20)
    return best.withColumn("lexical", F.round("lexical", 6))


HYBRID = f"""{hash_sql('hq', 'qid', '(SELECT item_id AS qid, text FROM benchmark)')}, {hash_sql('hc', 'doc_id, chunk_index', 'chunks')},
 nq AS (SELECT qid, CAST(sum(weight * weight) AS BIGINT) AS n FROM hq GROUP BY 1), nc AS (SELECT doc_id, chunk_index, CAST(sum(weight * weight) AS BIGINT) AS n FROM hc GROUP BY 1, 2),
 dots AS (SELECT qid, doc_id, chunk_index, CAST(sum(hq.weight * hc.weight) AS BIGINT) AS dot FROM hq JOIN hc USING (dim) GROUP BY 1, 2, 3),
 sem AS (SELECT dots.qid, dots.doc_id, dots.chunk_index, dot / sqrt(CAST(nq.n AS DOUBLE) * nc.n) AS semantic FROM dots JOIN nq USING (qid) JOIN nc USING (doc_id, chunk_index))"""


@query("ret_hybrid", B.with_ctes(CHUNK_ROWS, LEXICAL, HYBRID, body="""SELECT qid, doc_id, chunk_index, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_index) AS r FROM
    (SELECT qid, doc_id, chunk_index, round(coalesce(semantic, 0) * 0.75 + lexical * 0.25, 4) AS score FROM lex LEFT JOIN sem USING (qid, doc_id, chunk_index))) WHERE r <= 5"""))
def ret_hybrid(spark, d):
    return H.search(questions(spark, d), corpus(spark, d), ["doc_id", "chunk_index"], 5)


@query("topk_retrieval", B.with_ctes(CHUNK_ROWS, LEXICAL, HYBRID, body="""SELECT qid, doc_id, chunk_index, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_index) AS r FROM
    (SELECT qid, doc_id, chunk_index, round(coalesce(semantic, 0) * 0.75 + lexical * 0.25, 4) AS score FROM lex LEFT JOIN sem USING (qid, doc_id, chunk_index))) WHERE r <= 20"""))
def topk_retrieval(spark, d):
    """The requested 50 is clamped to 20."""
    return H.search(questions(spark, d), corpus(spark, d), ["doc_id", "chunk_index"], 50)


@query("ret_index_documents", B.with_ctes(CHUNK_ROWS, body="""SELECT d.doc_id, d.source AS filename, length(d.text) AS text_length, count(c.chunk_index) AS chunks FROM documents d JOIN chunks c ON d.doc_id = c.doc_id GROUP BY 1, 2, 3"""))
def ret_index_documents(spark, d):
    """Index entry per document with text: name, length, number of chunks."""
    docs = B.documents(spark, d)
    counted = corpus(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return docs.select("doc_id", F.col("source").alias("filename"), F.length("text").alias("text_length")).join(counted, "doc_id")


#: The question of each document: one of the benchmark items in turn.
ASKED = "asked_of AS (SELECT doc_id, item_id AS qid FROM documents JOIN benchmark ON item_id = doc_id % (SELECT count(*) FROM benchmark))"


def asked_of(spark, d):
    count = B.table(spark, d, "benchmark").select(F.count("*").alias("n"))
    numbered = B.documents(spark, d).select("doc_id", (F.col("doc_id") % count.scalar()).alias("qid"))
    return numbered.join(questions(spark, d).select("qid"), "qid")


def bm25_sql(scope: str) -> str:
    """BM25 over chunks; statistics over the corpus when the scope is a constant, otherwise per document for the document's own question."""
    own = scope == "doc_id"
    terms = f"SELECT DISTINCT item_id AS qid, unnest({folded_words('text')}) AS term FROM benchmark"
    if own:
        terms = f"SELECT doc_id AS scope, qid, term FROM ({terms}) JOIN asked_of USING (qid)"
    return f"""{ASKED + ', ' if own else ''}pt AS (SELECT doc_id, chunk_index, {folded_words('text')} AS tok FROM chunks),
 pl AS (SELECT doc_id, chunk_index, {scope} AS scope, len(tok) AS plen, tok FROM pt),
 st AS (SELECT scope, count(*) AS n, sum(plen) AS total FROM pl GROUP BY 1),
 tf AS (SELECT doc_id, chunk_index, scope, plen, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, scope, plen, unnest(tok) AS term FROM pl) GROUP BY ALL),
 qterm AS ({terms}),
 dfs AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY 1, 2),
 bm AS (SELECT qid, doc_id, chunk_index, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * plen / (CAST(total AS DOUBLE) / n)))) AS bm25
   FROM qterm JOIN tf USING ({'scope, ' if own else ''}term) JOIN dfs USING (scope, term) JOIN st USING (scope) GROUP BY 1, 2, 3)"""


@query("ret_bm25", B.with_ctes(CHUNK_ROWS, bm25_sql("1"), body="""SELECT qid, doc_id, chunk_index, round(bm25, 4) AS bm25, r AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, doc_id, chunk_index) AS r FROM bm) WHERE r <= 20"""))
def ret_bm25(spark, d):
    """Corpus-wide statistics; the twenty best chunks per question."""
    index = K.build(corpus(spark, d), ["doc_id", "chunk_index"])
    best = K.search(index, questions(spark, d).withColumnRenamed("question", "query"), 20)
    return best.withColumn("bm25", F.round("bm25", 4))


def document_scores(spark, d):
    asked = questions(spark, d).withColumnRenamed("question", "query")
    return T.bm25(asked, corpus(spark, d), ["doc_id", "chunk_index"], ["doc_id"], asked_of(spark, d))


@query("win_topk_per_query", B.with_ctes(CHUNK_ROWS, bm25_sql("doc_id"), body="""SELECT qid, doc_id, chunk_index, round(bm25, 4) AS bm25, r AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY doc_id, qid ORDER BY round(bm25, 6) DESC, chunk_index) AS r FROM bm) WHERE r <= 3"""))
def win_topk_per_query(spark, d):
    """Statistics of one document each; the three best passages of every document for its question."""
    best = T.top_k(document_scores(spark, d), ["doc_id", "qid"], [F.desc(F.round("bm25", 6)), F.col("chunk_index")], 3)
    return best.withColumn("bm25", F.round("bm25", 4))


FUSED = """fu AS (SELECT qid, doc_id, chunk_index, round(coalesce(bm25, 0), 6) AS b, round(coalesce(semantic, 0), 6) AS s FROM bm FULL JOIN (SELECT sem.* FROM sem JOIN asked_of USING (doc_id, qid)) AS own USING (qid, doc_id, chunk_index) WHERE coalesce(bm25, 0) > 0 OR coalesce(semantic, 0) >= 0.35),
 rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, qid ORDER BY b DESC, chunk_index) AS lexical_rank, row_number() OVER (PARTITION BY doc_id, qid ORDER BY s DESC, chunk_index) AS semantic_rank FROM fu)"""


def fused_scores(spark, d):
    chunks = corpus(spark, d)
    asked = questions(spark, d)
    keys = ["doc_id", "chunk_index"]
    weights = asked_of(spark, d).join(T.hash_weights(asked, ["qid"], "question"), "qid")
    semantic = T.sparse_cosine(weights, T.hash_weights(chunks, keys, deal=["doc_id"]), ["doc_id", "qid"], keys, ["doc_id"])
    return T.fused(document_scores(spark, d), semantic, keys, ["doc_id", "qid"])


@query("win_rrf_ranks", B.with_ctes(CHUNK_ROWS, HYBRID, bm25_sql("doc_id"), FUSED, body="SELECT qid, doc_id, chunk_index, lexical_rank, semantic_rank FROM rk"))
def win_rrf_ranks(spark, d):
    return fused_scores(spark, d).select("qid", "doc_id", "chunk_index", "lexical_rank", "semantic_rank")


@query("ret_rrf", B.with_ctes(CHUNK_ROWS, HYBRID, bm25_sql("doc_id"), FUSED, body="""SELECT qid, doc_id, chunk_index, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, qid ORDER BY score DESC, chunk_index) AS r FROM
    (SELECT *, round(CAST(1 AS DOUBLE) / (60 + lexical_rank) + CAST(1 AS DOUBLE) / (60 + semantic_rank), 6) AS score FROM rk)) WHERE r <= 3"""))
def ret_rrf(spark, d):
    best = T.top_k(fused_scores(spark, d), ["doc_id", "qid"], [F.desc("score"), F.col("chunk_index")], 3)
    return best.select("qid", "doc_id", "chunk_index", "score", "rank")


def invoice_passages(spark, d):
    return P.line_passages(R.texts(spark, d).select("doc_id", "text"))


@query("ret_field_queries")
def ret_field_queries(spark, d):
    """The fixed field queries against the passages of every invoice."""
    return T.field_bm25(invoice_passages(spark, d))


@query("ret_field_overrides")
def ret_field_overrides(spark, d):
    found = written(T.field_words(invoice_passages(spark, d), keep=["kind"]), "field-words")
    return T.with_field_overrides(T.field_bm25(found), found)


def overlap_sql() -> str:
    from billquarry.vocabulary import FIELD_PHRASES

    parts = []
    for field, phrases in FIELD_PHRASES.items():
        words = sorted({w for p in phrases for w in p.split() if len(w) > 1})
        hits = " + ".join(f"CAST(contains(low, '{p}') AS INTEGER)" for p in phrases)
        parts.append(f"SELECT doc_id, chunk_index, '{field}' AS field, digit, len(list_intersect(tok, {words!r})) AS common, {hits} AS hits FROM low")
    return f"""low AS (SELECT doc_id, chunk_index, lower(text) AS low, list_distinct({WORDS.format('lower(text)')}) AS tok, CAST(regexp_matches(text, '[0-9]') AS INTEGER) AS digit FROM chunks),
 sc AS ({' UNION ALL '.join(parts)}),
 top AS (SELECT doc_id, field, chunk_index, r AS rank, CAST(s AS DOUBLE) / 10 AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY s DESC, chunk_index) AS r FROM
   (SELECT *, (common + hits * 3) * 10 + digit * 2 AS s FROM sc WHERE common > 0 OR hits > 0)) WHERE r <= 3)"""


@query("ret_field_overlap", B.with_ctes(CHUNK_ROWS, overlap_sql(), body="SELECT * FROM top"))
def ret_field_overlap(spark, d):
    return T.field_overlap(corpus(spark, d))


@query("ret_evidence_dedup", B.with_ctes(CHUNK_ROWS, overlap_sql(), body="SELECT doc_id, chunk_index, string_agg(field, ',' ORDER BY field) AS fields FROM top GROUP BY 1, 2"))
def ret_evidence_dedup(spark, d):
    shared = T.shared_evidence(T.field_overlap(corpus(spark, d)))
    return shared.select("doc_id", "chunk_index", F.array_join("fields", ",").alias("fields"))


@query("win_round_robin_budget")
def win_round_robin_budget(spark, d):
    found = invoice_passages(spark, d).withColumn("chars", F.length("text"))
    return T.round_robin(T.field_bm25(found, keep=["chars"]), None)


QUESTIONS = ["Quel est le total TTC ?", "total HT ?", "TVA ?", "total HT et TTC ?", "ما هو المبلغ باحتساب الأداء"]


@query("ret_labelled_answer", R.sheets_sql("""SELECT doc_id, q AS question_no, CASE q WHEN 0 THEN ttc WHEN 1 THEN ht WHEN 2 THEN CASE WHEN order_id % 4 <> 3 THEN tva END WHEN 4 THEN ttc END AS milli FROM sheets, (SELECT unnest(range(0, 5)) AS q)"""))
def ret_labelled_answer(spark, d):
    """Five questions about every invoice; the one naming two amounts is not answered."""
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_no int, question string").select("question_no", T.asked_amount(F.col("question")).alias("asked"))
    # what a question names is found once for all invoices, an amount once for all questions about an invoice
    names = [F.struct(F.lit(n).alias("named"), T.labelled_answer(F.lit(n), F.col("text")).alias("answer")) for n in T.ANSWER_PATTERNS]
    told = R.texts(spark, d).select("doc_id", F.array(*names).alias("told"))
    rows = told.join(F.broadcast(asked))
    amount = F.get(F.filter("told", lambda t: t["named"] == F.col("asked")), F.lit(0))["answer"]
    return rows.select("doc_id", "question_no", (amount.try_cast("decimal(20,3)") * 1000).cast("long").alias("milli"))


@query("ret_number_grounding", R.sheets_sql("SELECT doc_id, order_id % 3 <> 1 AS grounded FROM sheets"))
def ret_number_grounding(spark, d):
    """Answers quoting an amount of the invoice, a changed one, or Arabic digits."""
    key = F.col("order_id") % 3
    shown = R.milli_text(F.col("ttc"))
    answer = (
        F.when(key == 0, F.concat(F.lit("Le total est "), shown, F.lit(" [12]"))).when(key == 1, F.concat(F.lit("Total "), shown, F.lit("9 [1]")))
        .otherwise(F.translate(F.concat(F.lit("المجموع "), F.translate(shown, ",", "٫")), "0123456789", "٠١٢٣٤٥٦٧٨٩"))
    )
    return R.texts(spark, d).select("doc_id", T.numbers_grounded(answer, F.col("text")).alias("grounded"))
