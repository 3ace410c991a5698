"""Queries of the pipeline operators over the shared tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billquarry.llm import decontamination, licenses, manifest, minhash, packing, phrases, quality, secrets, simhash, spans, tokens, urls, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(builder):
        QUERIES[name] = builder
        if sql is not None:
            SQL[name] = sql
        return builder

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _quality_sql() -> str:
    bucket = "CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END"
    value = {m: e[0].replace("DIV", "//") for m, e in quality.MEASURES.items()}
    rows = " UNION ALL ".join(f"SELECT rid, lang, source, '{m}' AS m, CASE WHEN n_words > 0 THEN {v} END AS v FROM counts" for m, v in value.items())
    lower = ", ".join(f"'{m}'" for m, e in quality.MEASURES.items() if e[3])
    factor = "CASE m {} END".format(" ".join(f"WHEN '{m}' THEN {e[1]}" for m, e in quality.MEASURES.items()))
    step = "CASE m {} END".format(" ".join(f"WHEN '{m}' THEN {e[2]}" for m, e in quality.MEASURES.items()))
    up, down = quality.SHARES, [100 - k for k in quality.SHARES]
    top = " ".join(f"WHEN q{b} > factor * q{a} + step THEN q{a}" for a, b in zip(up, up[1:]))
    bottom = " ".join(f"WHEN q{b} < q{a} - step THEN q{a}" for a, b in zip(down, down[1:]))
    quantiles = ", ".join(f"MIN(CASE WHEN 100 * upto >= {k} * total THEN bucket END) AS q{k}" for k in sorted({*up, *down}))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, COALESCE(text, '') AS text FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts
),
windows AS (SELECT rid, p, array_to_string(ws[p:p + {quality.WINDOW - 1}], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS p FROM split)),
twice AS (SELECT rid, p FROM windows QUALIFY COUNT(*) OVER (PARTITION BY rid, win) > 1),
covered AS (SELECT rid, COUNT(*) AS n FROM (SELECT DISTINCT rid, p + k AS at FROM twice, range({quality.WINDOW}) AS r(k)) GROUP BY rid),
counts AS (
  SELECT s.rid, doc_id, lang, source, len(ws) AS n_words, CAST(COALESCE(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    COALESCE(c.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_doubled
  FROM split s LEFT JOIN covered c ON s.rid = c.rid
),
measured AS ({rows}),
fine AS (SELECT lang, source, m, {bucket} AS bucket, COUNT(*) AS n FROM measured WHERE v IS NOT NULL GROUP BY ALL),
levels AS (
  SELECT 2 AS level, lang, source, m, bucket, n FROM fine
  UNION ALL SELECT 1, lang, NULL, m, bucket, SUM(n) FROM fine GROUP BY lang, m, bucket
  UNION ALL SELECT 0, NULL, NULL, m, bucket, SUM(n) FROM fine GROUP BY m, bucket
),
running AS (
  SELECT *, SUM(n) OVER (PARTITION BY level, lang, source, m ORDER BY bucket) AS upto, SUM(n) OVER (PARTITION BY level, lang, source, m) AS total FROM levels
),
quantiles AS (SELECT level, lang, source, m, {factor} AS factor, {step} AS step, MAX(total) AS total, {quantiles} FROM running GROUP BY ALL),
bodies AS (SELECT *, CASE {top} ELSE q{up[-1]} END AS body_top, CASE {bottom} ELSE q{down[-1]} END AS body_bottom FROM quantiles),
chosen AS (
  SELECT x.rid, x.m, x.v, q.q50, q.factor * q.body_top + q.step AS most, q.body_bottom - q.step AS least FROM measured x JOIN bodies q ON q.m = x.m AND (
    q.level = 2 AND q.lang IS NOT DISTINCT FROM x.lang AND q.source IS NOT DISTINCT FROM x.source AND q.total >= {quality.GROUP}
    OR q.level = 1 AND q.lang IS NOT DISTINCT FROM x.lang AND q.total >= {quality.GROUP} OR q.level = 0)
  QUALIFY row_number() OVER (PARTITION BY x.rid, x.m ORDER BY q.level DESC) = 1
),
outliers AS (
  SELECT DISTINCT l.rid FROM chosen l JOIN counts c ON l.rid = c.rid
  WHERE v IS NOT NULL AND ((v - q50) * n_words > (most - q50) * (n_words + {quality.SLACK}) OR m IN ({lower}) AND (q50 - v) * n_words > (q50 - least) * (n_words + {quality.SLACK}))
)
SELECT doc_id, {", ".join(quality.COUNTS)}, base_failed, outlier, NOT base_failed AND NOT outlier AS kept FROM (
  SELECT c.*, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed, o.rid IS NOT NULL AS outlier
  FROM counts c LEFT JOIN outliers o ON c.rid = o.rid)"""


@query("op1_quality_rules", _quality_sql())
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document and the verdict of limits adapted to its language and source."""
    return quality.judge(table(spark, folder, "documents"))


@query("op4_wrapper_induction")
def op4_wrapper_induction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page: what varies between pages of its host and is no menu, notice, advert or the like."""
    return wrappers.extract(table(spark, folder, "pages"))


#: Rules of the URL query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH rules(h, p, v) AS (VALUES {rules}),
places AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(COALESCE(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(COALESCE(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages
)
SELECT page_id, host, path, h || p AS rule, COALESCE(v, 'allow') AS verdict
FROM places LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC, v DESC) = 1"""


@query("op5_url_filters", _url_sql())
def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of the longest rule that fits the URL of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, folder, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate of every document with the forest's score and verdict."""
    return secrets.scan(table(spark, folder, "documents")).select("doc_id", "nth", "start", "length", "value", "score", "secret")


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary, by rank-synchronous merging."""
    counted = tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op8_simhash_components")
def op8_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of at most 4 of 64 differing fingerprint bits."""
    return simhash.near_duplicates(table(spark, folder, "documents"), simhash.EXACT)


@query("op2_retrieval_packing")
def op2_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens, filled with lexical neighbours."""
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, with the best passage of each."""
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


def _license_sql() -> str:
    of_templates, of_phrases = licenses.postings()
    rows = lambda values: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in values)
    needed = [(n, p, len(ps)) for n, (_, _, ps) in enumerate(licenses.TEMPLATES) for p in ps]
    return f"""
WITH postings(template, label, size, word, spot) AS (VALUES {rows(of_templates)}),
phrases(phrase, words, word, spot) AS (VALUES {rows(of_phrases)}),
needed(template, phrase, needs) AS (VALUES {rows(needed)}),
base(phrase, base_label) AS (VALUES {rows(licenses.BASE_PHRASES.items())}),
texts AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
),
everywhere AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM texts),
places AS (SELECT * FROM everywhere WHERE word IN (SELECT word FROM postings UNION SELECT word FROM phrases)
  AND rid IN (SELECT rid FROM everywhere JOIN (SELECT word FROM postings UNION SELECT word FROM phrases) USING (word) WHERE length(word) >= {licenses.LETTERS})),
held AS (SELECT word, COUNT(DISTINCT rid) AS held_by FROM places GROUP BY word),
ranked AS (SELECT p.*, row_number() OVER (PARTITION BY template ORDER BY COALESCE(held_by, 0), spot) AS rank FROM postings p LEFT JOIN held USING (word)),
rare AS (SELECT *, COUNT(*) OVER (PARTITION BY template) AS of_all FROM ranked WHERE rank <= {licenses.RARE}),
votes AS (SELECT rid, template, label, size, of_all, place - spot AS start, COUNT(*) AS votes FROM places JOIN rare USING (word) GROUP BY ALL),
found AS (SELECT rid, phrase, words, place - spot AS start FROM places JOIN phrases USING (word) GROUP BY ALL HAVING COUNT(*) = words),
verified AS (
  SELECT v.rid, v.label FROM votes v JOIN needed n ON n.template = v.template JOIN found f ON f.rid = v.rid AND f.phrase = n.phrase
    AND f.start >= v.start - {licenses.SLACK} AND f.start + f.words <= v.start + v.size + {licenses.SLACK}
  WHERE 100 * v.votes >= {licenses.SHARE} * v.of_all GROUP BY v.rid, v.template, v.label, v.start, n.needs HAVING COUNT(DISTINCT n.phrase) = n.needs
),
of_base AS (SELECT rid, COUNT(*) AS n_base, MIN(start) AS first_word, MAX(start) AS last_word FROM found JOIN base USING (phrase) GROUP BY rid),
base_labels AS (SELECT rid, string_agg(DISTINCT base_label, ',' ORDER BY base_label) AS base_labels FROM found JOIN base USING (phrase) GROUP BY rid),
all_labels AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, base_label AS label FROM found JOIN base USING (phrase) UNION SELECT rid, label FROM verified) GROUP BY rid),
shares AS (SELECT rid, MAX(votes / of_all) AS share FROM votes GROUP BY rid)
SELECT t.doc_id, len(t.ws) AS n_words, COALESCE(n_base, 0) AS n_base, first_word, last_word, COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE COALESCE(share, 0.0) END::DOUBLE AS score
FROM texts t LEFT JOIN of_base USING (rid) LEFT JOIN base_labels USING (rid) LEFT JOIN all_labels USING (rid) LEFT JOIN shares USING (rid)"""


@query("op10_license_scan", _license_sql())
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses of every document by phrases and by rare words in place."""
    return licenses.scan(table(spark, folder, "documents"))


@query("op3_sentence_spans")
def op3_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Text of every document without the passages that an earlier place holds."""
    return spans.remove_repeats(table(spark, folder, "documents"))


#: Lower-case letters and no others, as the contracts ask for.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MINHASH_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
),
shingles AS (
  SELECT DISTINCT rid, array_to_string(ws[p:p + 3], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS p FROM texts)
),
sizes AS (SELECT rid, COUNT(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM shingles GROUP BY rid),
nodes AS (SELECT k, MIN(rid) AS node, MAX(n) AS n FROM sizes GROUP BY k),
held AS (SELECT s, rid AS node FROM shingles WHERE rid IN (SELECT node FROM nodes)),
common AS (SELECT a.node AS a, b.node AS b, COUNT(*) AS c FROM held a JOIN held b ON a.s = b.s AND a.node < b.node GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reached r JOIN ways l ON r.b = l.a),
rows_of AS (SELECT s.rid, n.node, t.doc_id FROM sizes s JOIN nodes n USING (k) JOIN texts t ON t.rid = s.rid),
lowest AS (SELECT node, MIN(doc_id) AS first_id FROM rows_of GROUP BY node),
roots AS (SELECT a AS node, MIN(first_id) AS component_id FROM reached JOIN lowest ON node = b GROUP BY a)
SELECT t.doc_id, COALESCE(s.n, 0) AS n_shingles, CASE WHEN s.rid IS NULL THEN t.doc_id ELSE component_id END AS component_id,
  t.doc_id IS NOT DISTINCT FROM CASE WHEN s.rid IS NULL THEN t.doc_id ELSE component_id END AS kept
FROM texts t LEFT JOIN sizes s USING (rid) LEFT JOIN nodes n USING (k) LEFT JOIN roots r ON r.node = n.node"""


@query("op11_minhash_components", _MINHASH_SQL)
def op11_minhash_components(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of four-word shingle sets with 80 percent of their union in common."""
    return minhash.near_duplicates(table(spark, folder, "documents"), minhash.FOUR_WORDS)


def _phrases_sql() -> str:
    plan = phrases.COLLOCATIONS
    return f"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
),
split AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, SUM(len(ws))::BIGINT AS n FROM split GROUP BY lang),
placed AS (SELECT pid, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM split),
grown AS (SELECT lang, w AS p1, {", ".join(f"p{k - 1} || ' ' || w{k} AS p{k}" for k in range(2, plan.longest + 1))} FROM (
  SELECT lang, w AS p1, w, {", ".join(f"LEAD(w, {k - 1}) OVER o AS w{k}" for k in range(2, plan.longest + 1))} FROM placed WINDOW o AS (PARTITION BY pid ORDER BY p))),
often AS (
  {" UNION ALL ".join(f"SELECT lang, {k} AS size, p{k} AS phrase, COUNT(*)::BIGINT AS f FROM grown WHERE p{k} IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= {plan.least}" for k in range(1, plan.longest + 1))}
),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM often WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.ws, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
  FROM candidates c JOIN range(1, {plan.longest}) AS t(k) ON k < c.size
  JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ') JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')
),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(ws[p:p + n - 1], ' ') AS phrase FROM candidates, range(2, {plan.longest}) AS s(n), range(1, {plan.longest}) AS t(p) WHERE n < size AND p + n - 1 <= size
),
longer AS (SELECT lang, phrase, MAX(a) AS most FROM inner_parts GROUP BY ALL)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, w.phrase) AS rank, w.phrase, w.a, l, r, n, score::BIGINT AS score
FROM worst w JOIN totals USING (lang) LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase
WHERE most IS NULL OR 100::HUGEINT * most < {plan.contained}::HUGEINT * w.a
QUALIFY rank <= {plan.top}"""


@query("op12_phrase_mining", _phrases_sql())
def op12_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of two to four words of every language."""
    return phrases.collocations(table(spark, folder, "documents"))


def _manifest_sql(levels: int = 12, over: int = 4) -> str:
    """Levels are written out one by one: ``levels`` in a language and ``over`` of languages suffice for 8 to their power."""
    encoded = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(encoded(text if c == "text" else c) for c in manifest.COLUMNS) + ")"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda crc, byte: "
        "list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
    )
    steps = [f"""
leaves AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE('=' || lang, '') AS tree, {leaf('text')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS claimed FROM documents),
n0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, COUNT(*) OVER (PARTITION BY tree) AS total, leaf AS h, rid FROM leaves),
w0 AS (SELECT rid, tree, pos, '' AS proof, COALESCE(claimed, leaf) AS folded FROM n0 JOIN leaves USING (rid, tree))"""]

    def level(nodes: str, paths: str, name: str, top: int) -> None:
        """From nodes of a level and paths up to it to those of the next; a tree of one node stays as it is."""
        steps.append(f"{name}n AS (SELECT tree, CASE WHEN total > 1 THEN pos // 8 ELSE pos END AS pos, (MAX(total) + 7) // 8 AS total, CASE WHEN MAX(total) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE MAX(h) END AS h FROM {nodes} GROUP BY tree, CASE WHEN total > 1 THEN pos // 8 ELSE pos END)")
        steps.append(f"""{name}r AS (SELECT tree, pos // 8 AS run, MAX(total) AS total, string_agg(h, '' ORDER BY pos) AS hs FROM {nodes} GROUP BY ALL)""")
        steps.append(f"""{name}w AS (SELECT rid, tree, CASE WHEN total > 1 THEN pos // 8 ELSE pos END AS pos,
  CASE WHEN total > 1 THEN proof || substr(hs, 1, 64 * (pos % 8)) || substr(hs, 64 * (pos % 8) + 65) ELSE proof END AS proof,
  CASE WHEN total > 1 THEN sha256(substr(hs, 1, 64 * (pos % 8)) || folded || substr(hs, 64 * (pos % 8) + 65)) ELSE folded END AS folded
  FROM {paths} p JOIN {name}r r USING (tree) WHERE r.run = p.pos // 8)""")

    level("n0", "w0", "a0", 0)
    for n in range(1, levels):
        level(f"a{n - 1}n", f"a{n - 1}w", f"a{n}", n)
    steps.append(f"t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, COUNT(*) OVER () AS total, h, tree AS of_tree FROM a{levels - 1}n)")
    steps.append(f"u0 AS (SELECT rid, '' AS tree, t0.pos, proof, folded FROM a{levels - 1}w w JOIN t0 ON t0.of_tree = w.tree)")
    level("t0", "u0", "b0", 0)
    for n in range(1, over):
        level(f"b{n - 1}n", f"b{n - 1}w", f"b{n}", n)
    return "WITH " + ",\n".join(steps) + f"""
SELECT l.doc_id, l.leaf, t0.h AS subroot, b{over - 1}n.h AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = b{over - 1}n.h AS verified
FROM leaves l JOIN b{over - 1}w u USING (rid) JOIN t0 ON t0.of_tree = l.tree CROSS JOIN b{over - 1}n"""


@query("op13_merkle_manifest", _manifest_sql(7, 2))
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and witness digest of every document; of every third one a tampered leaf is verified."""
    columns = [F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in manifest.COLUMNS]
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, manifest.leaf_of(columns))
    return manifest.manifest(table(spark, folder, "documents"), claimed, keep_witness=False).drop("witness")
