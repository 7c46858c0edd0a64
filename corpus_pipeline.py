"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last
returns the pieces of packed sequences. Null and empty texts, repeated rows and null ids are treated as the operators'
modules say; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recospark.llm import decontamination, langid, packing, secrets, simhash, verify
from recospark.llm.common import bound_batches, columns_of, materialise, read
from recospark.llm.registry import tokenizer_path

#: A text of at least so many characters whose cost in bits a symbol exceeds GIBBERISH_BITS is in none of the languages.
LONG_ENOUGH, GIBBERISH_BITS = 64, 8.0
#: Candidates for near copies share a word-level fingerprint to DISTANCE bits in one of VIEWS views. One word in 45 changed
#: (a five-word shingle similarity of 0.8) turns some four bits of 64, so several views are needed to catch it surely.
VIEWS, DISTANCE = 4, 4
#: Near copies are candidates whose sets of SHINGLE words have this Jaccard similarity at least.
SHINGLE, SIMILAR = 5, 0.8
#: What takes a secret's place.
REDACTED = "[secret]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter at all, or long texts that no learned language explains."""
    bound_batches(spark)
    model = langid.fit(langid.sample(docs, F.lit(True)))
    # The documents' own columns travel as one, so that none clashes with a prediction's.
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), "text")
    found = langid.predict(rows, model, ["row"])
    gibberish = (F.length("row.text") >= LONG_ENOUGH) & (F.col("bits") > GIBBERISH_BITS)
    kept = found.filter(F.coalesce((F.col("lang_pred") != langid.UNDETERMINED) & ~gibberish, F.lit(False)) if model.languages else F.lit(True))
    return kept.select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest id, once; documents without id all stay.

    SimHash finds candidates; only those whose shingles are similar enough are linked.
    """
    own = docs.filter(F.col("doc_id").isNotNull())
    found = simhash.near_duplicates(own, shingle=1, distance=DISTANCE, views=VIEWS, distinct=True)
    dropped = verify.duplicates(own.withColumn("doc_id", F.col("doc_id").cast("long")), found, SHINGLE, SIMILAR)
    # Of rows repeated under a kept id one stays; every id is a group of its own, so no group is large.
    named = own.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.select(columns_of(docs)).union(docs.filter(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item to four fifths of its 5-word shingles."""
    return decontamination.without_items(docs, read(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows the text."""
    into = "spans"
    while into in (c.lower() for c in docs.columns):
        into += "_"
    found = secrets.scan(docs, redact=REDACTED, into=into)
    return found.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else own for c, own in zip(docs.columns, columns_of(docs), strict=True)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents packed into sequences of 2048 tokens at most."""
    return packing.digest(packing.pack_documents(docs, tokenizer_path()))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", redact),
    ("packing", pack),
]

#: SQL can express neither the language model nor the tokenizer; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table; each is written to the shared folder before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
