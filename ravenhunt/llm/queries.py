"""The registered corpus queries: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravenhunt.llm import decontamination, extraction, nearest, packing, ranked, sharding, simhash, substrings, suffixes, surrogates, tokens, toxicity, variants
from ravenhunt.llm.common import documents
from ravenhunt.session import ensure_on_workers, read_table

#: Surrogates depend on a key that is not in the data; a job of one's own passes its own.
SURROGATE_KEY = "registered-query"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_on_workers(spark)
        return f(spark, sf_dir)

    run.__doc__ = f.__doc__
    QUERIES[f.__name__] = run
    return run


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose counts are at most one apart."""
    placed = sharding.balanced_shards(documents(spark, sf_dir), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 35-word windows that occur again."""
    rows = substrings.deduplicated(documents(spark, sf_dir), window=35)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, distance=4)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


@query
def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    return surrogates.anonymised(documents(spark, sf_dir), SURROGATE_KEY)


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return decontamination.contaminated(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities along the chain of categories."""
    rows = toxicity.toxic_documents(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
    return rows.select("_row.doc_id", "p_quality", "p_toxic", "is_toxic")


@query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, every=50, k=5)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return tokens.token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), limit=1024)


@query
def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier."""
    rows = suffixes.deduplicated(documents(spark, sf_dir), window=100)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return ranked.ranked_search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), k=20)


@query
def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, its form and root."""
    return variants.spelling_variants(documents(spark, sf_dir))


ORACLE_SQL["op2_substrings"] = r"""WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (
  SELECT doc_id, i, unnest(range(0, 35)) AS k FROM win SEMI JOIN again USING (h))),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL["op8_nearest"] = """WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
WHERE rank <= 5"""

ORACLE_SQL["op11_ranked"] = r"""WITH t AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
docs AS (SELECT d, doc_id, CAST(len(ws) AS BIGINT) AS n, ws FROM t WHERE len(ws) > 0),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ws) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY term, nn),
items AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
asked AS (SELECT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
scores AS (SELECT i, item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (d), totals GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0) WHERE rank <= 20"""

#: The pages of the test tables mark their main text by an ``article`` element; SQL takes its blocks.
ORACLE_SQL["op12_extraction"] = r"""WITH a AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS blocks FROM pages),
t AS (SELECT page_id, url, list_transform(blocks, lambda b: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(
  regexp_replace(replace(b, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'),
  '[\s\x0B\x1C-\x1F\x85\x{A0}]+', ' ', 'g'))) AS blocks FROM a),
m AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10)) AS text FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM m"""
