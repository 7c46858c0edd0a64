"""The registered queries opN_<name> of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recospark.llm import decontamination, html, langid, language_model, packing, secrets, simhash, substrings, topk, toxicity
from recospark.llm.common import read, remainder


def tokenizer_path() -> str:
    """The public vocabulary that documents are packed with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is, learned from labelled ones whose remainder modulo 5 is not 0."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.drawn(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0))
    found = toxicity.score(docs, model, ["doc_id"])
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that windows of 50 repeat from a smaller document."""
    found = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and its group of near-duplicates."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 20 of every twentieth vector against all vectors."""
    return topk.search(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20, F.col("vec_id") % 20 == 0, scale=64.0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens at most."""
    return packing.digest(packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path()))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and a digest of the base kinds, and all spans."""
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents contain, to four fifths of their 5-word shingles."""
    return decontamination.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose remainder modulo 4 is not 2."""
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(langid.sample(docs, remainder("doc_id", 4) != 2))
    found = langid.predict(docs, model, ["doc_id"])
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document, learned from those whose remainder modulo 7 is not 2."""
    docs = read(spark, sf_dir, "documents")
    model = language_model.fit(docs, remainder("doc_id", 7) != 2)
    found = language_model.score(docs, model)
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substrings": op2_substrings,
    "op3_simhash": op3_simhash,
    "op4_topk": op4_topk,
    "op5_packing": op5_packing,
    "op6_html": op6_html,
    "op7_secrets": op7_secrets,
    "op8_decontamination": op8_decontamination,
    "op9_langid": op9_langid,
    "op10_language_model": op10_language_model,
}

ORACLES = {
    "op2_substrings": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM w, unnest(range(1, len(ws) - 48)) AS t(i)
), m AS (
  SELECT win, min(doc_id) AS least FROM s GROUP BY win
), r AS (
  SELECT s.doc_id, list(s.i) AS starts FROM s JOIN m USING (win) WHERE s.doc_id > m.least GROUP BY s.doc_id
), g AS (
  SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 50)))) AS gone FROM r
), k AS (
  SELECT w.doc_id, ws, coalesce(g.gone, []) AS gone FROM w LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM k
""",
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op8_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), q AS (
  SELECT item_id, least(5, len(ws)) AS k, unnest(list_distinct(list_transform(range(1, len(ws) - least(5, len(ws)) + 2),
    lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ')))) AS s
  FROM b WHERE len(ws) > 0
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM q GROUP BY item_id
), x AS (
  SELECT doc_id, kk.k, unnest(list_distinct(list_transform(range(1, len(ws) - kk.k + 2), lambda i: array_to_string(ws[i:i + kk.k - 1], ' ')))) AS s
  FROM d, (SELECT DISTINCT k FROM q) AS kk WHERE len(ws) >= kk.k
), f AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM x JOIN q ON x.k = q.k AND x.s = q.s GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles
""",
}
