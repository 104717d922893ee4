"""The operators as queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanworks.llm import (
    backoff_lm, bpe, fill_middle, hard_negatives, inner_product, licenses, line_dedup, line_labels, near_dedup, packing, quality_model, site_tree, warc,
)

Query = Callable[[SparkSession, str], DataFrame]

#: A word is a maximal run of characters other than space and 0x09-0x0D.
WORDS_SQL = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


#: crc32 of an id as text: bit by bit, over its characters.
CRC_SQL = """xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [1::UBIGINT, 1, 1, 1, 1, 1, 1, 1],
      lambda d, one: xor(d >> 1, 3988292384::UBIGINT * (d & one)))), 4294967295::UBIGINT)"""


def op1_backoff_lm(spark: SparkSession, directory: str) -> DataFrame:
    return backoff_lm.score(table(spark, directory, "documents"))


OP1_SQL = f"""
WITH texts AS (
  SELECT doc_id, {CRC_SQL.format(id="doc_id")} % 10 = 0 AS held_out, {WORDS_SQL.format(text=LOWER_SQL)} || [''] AS w FROM documents
), tokens AS (
  SELECT doc_id, held_out, unnest(w) AS token, unnest([chr(1)] || w[:len(w) - 1]) AS before FROM texts
), single AS (SELECT token, count(*) FILTER (NOT held_out) AS c FROM tokens GROUP BY token),
double AS (SELECT before, token, count(*) FILTER (NOT held_out) AS c2 FROM tokens GROUP BY before, token),
sums AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) FILTER (c > 0) AS v FROM single),
parts AS (
  SELECT doc_id, held_out, s.c, c2, coalesce(h.c, 0) AS ch, n, (s.c + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS p
  FROM tokens JOIN single s USING (token) JOIN double USING (before, token)
    LEFT JOIN single h ON h.token = CASE WHEN before = chr(1) THEN '' ELSE before END, sums
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens,
  sum(log10(p)) AS base_score, sum(log10((c2 + 500 * p) / (ch + 500))) AS score
FROM parts GROUP BY doc_id, held_out
"""


def op2_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Each document's text without its repeated lines, and how many lines it had and lost."""
    out = line_dedup.dedup_lines(table(spark, directory, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op3_line_crf(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    return line_labels.verdicts(docs, line_labels.fit(docs, table(spark, directory, "labels")))


def op4_inner_product_top_k(spark: SparkSession, directory: str) -> DataFrame:
    return inner_product.top_k(table(spark, directory, "embeddings"))


OP4_SQL = """
WITH numbers AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM numbers q JOIN numbers v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op5_minhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, directory, "documents"))


OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS line FROM documents
), words AS (
  SELECT doc_id, k, line,
    {WORDS_SQL.format(text="translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM lines
), variants AS (
  SELECT doc_id, k, len(w) AS n, 'same' AS kind, 0 AS i, array_to_string(w, ' ') AS x FROM words WHERE len(w) >= 1
  UNION ALL
  SELECT doc_id, k, len(w), 'without', unnest(range(1, len(w) + 1)),
    unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[:i - 1] || w[i + 1:], ' '))) FROM words WHERE len(w) >= 5
), repeats AS (
  SELECT DISTINCT b.doc_id, b.k FROM variants a JOIN variants b ON a.x = b.x AND (a.doc_id, a.k) < (b.doc_id, b.k)
  WHERE a.kind = 'same' OR b.kind = 'same' OR (a.n = b.n AND a.i = b.i)
), kept AS (
  SELECT doc_id, count(*) FILTER (repeats.k IS NOT NULL) AS n_dropped,
    string_agg(line, chr(10) ORDER BY k) FILTER (repeats.k IS NULL) AS text
  FROM lines LEFT JOIN repeats USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, coalesce(kept.text, '') AS text
FROM documents d JOIN kept USING (doc_id)
"""

OP5_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS_SQL.format(text=LOWER_SQL)} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sets
  UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON u = doc_id
"""


def op6_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.digests(table(spark, directory, "documents"))


def op7_mil_quality(spark: SparkSession, directory: str) -> DataFrame:
    return quality_model.predictions(table(spark, directory, "documents"), table(spark, directory, "labels"))


def op8_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack(table(spark, directory, "documents"))


def op9_licenses(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as files of the directories source/language."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    files = table(spark, directory, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files)


def op10_site_tree(spark: SparkSession, directory: str) -> DataFrame:
    return site_tree.extract(table(spark, directory, "pages"))


#: For pages whose main text is an article of headings and paragraphs.
OP10_SQL = r"""
WITH inner_html AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS h FROM pages
), marked AS (
  SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(h[1-6]|p)>', chr(1), 'g'), '<[^>]*(>|$)', ' ', 'g') AS h FROM inner_html
), decoded AS (
  SELECT page_id, url, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
    '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#0*39;|&#x0*27;|&apos;', '''', 'g'), '&nbsp;', ' ') AS h FROM marked
), blocks AS (
  SELECT page_id, url, list_filter(list_transform(string_split(regexp_replace(h, '&amp;?', '&', 'g'), chr(1)),
    lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> '') AS b FROM decoded
)
SELECT page_id, url, array_to_string(b, chr(10) || chr(10)) AS text,
  CAST(length(array_to_string(b, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM blocks
"""

def op11_warc_transactions(spark: SparkSession, directory: str) -> DataFrame:
    return warc.round_trip(table(spark, directory, "pages"))


OP11_SQL = """
WITH captures AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), groups AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM captures)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM groups
"""


def op12_piece_table(spark: SparkSession, directory: str) -> DataFrame:
    return fill_middle.digests(table(spark, directory, "documents"))


#: Units of a text, and the numbers that decide how it is cut and arranged.
OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), numbers AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM texts
), parts AS (
  SELECT doc_id, text, n,
    CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM numbers
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
    AS output_sha256, sha256(text) AS restored_sha256 FROM parts
"""

def op13_hard_negatives(spark: SparkSession, directory: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved on by one first, so that some positives are false."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, directory, "embeddings").withColumn("label", moved))


OP13_SQL = """
WITH numbers AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM numbers a JOIN numbers v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM positives JOIN scores USING (anchor_id)
  WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_backoff_lm": (op1_backoff_lm, OP1_SQL),
    "op2_line_dedup": (op2_line_dedup, OP2_SQL),
    "op3_line_crf": (op3_line_crf, None),
    "op4_inner_product_top_k": (op4_inner_product_top_k, OP4_SQL),
    "op5_minhash_near_dedup": (op5_minhash_near_dedup, OP5_SQL),
    "op6_byte_bpe": (op6_byte_bpe, None),
    "op7_mil_quality": (op7_mil_quality, None),
    "op8_best_fit_packing": (op8_best_fit_packing, None),
    "op9_licenses": (op9_licenses, None),
    "op10_site_tree": (op10_site_tree, OP10_SQL),
    "op11_warc_transactions": (op11_warc_transactions, OP11_SQL),
    "op12_piece_table": (op12_piece_table, OP12_SQL),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
}


def llm_queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in QUERIES.items()}


def llm_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
