"""The corpus operators over their whole tables, as checked queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import (
    divergence,
    forest,
    interaction,
    langid,
    licences,
    mixing,
    outliers,
    packing,
    pieces,
    simhash,
    tokens,
    urls,
    warc,
)
from presswork.llm.common import prepare, table
from presswork.llm.oracles import ORACLES  # noqa: F401  (part of what the entry point adds)
from presswork.session import stored

# Production parameters.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0}
MIX_OTHER = 1.0
MIX_SEED = 7
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 1024
NEIGHBOURS = 20
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return run


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


@query
def op1_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.replicate(docs, MIX_WEIGHTS, MIX_OTHER, seed=MIX_SEED)


@query
def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_licence_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op4_quality(spark, sf_dir):
    return outliers.assess(table(spark, sf_dir, "documents"))


@query
def op5_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op6_fixity(spark, sf_dir):
    """Audit of a replica in which a known part of the records has been damaged.

    The tables hold no second replica, so one is made here: a record whose number (a hash
    of its bytes) is divisible by 97 gains a byte, one divisible by 193 is lost. What the audit finds is the result.
    """
    kept = stored(warc.to_records(table(spark, sf_dir, "pages")), "replica")
    number = F.conv(F.substring(F.md5("record"), 1, 12), 16, 10).cast("long")
    damaged = F.concat(F.col("record"), F.lit("?"))
    replica = kept.filter(number % 193 != 0).withColumn(
        "record", F.when(number % 97 == 0, damaged).otherwise(F.col("record"))
    )
    found = warc.audit(kept, replica)
    return found.join(kept.select("file", "offset", "page_id"), ["file", "offset"], "left")


@query
def op7_tokens(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary(), TOKEN_LIMIT)


@query
def op8_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(tokens.with_token_counts(docs, vocabulary()))


@query
def op9_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, F.col("id") % 20 == 0, NEIGHBOURS)


@query
def op10_url_filter(spark, sf_dir):
    return urls.judge_pages(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op11_filter_audit(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return interaction.audit_documents(docs, labels)


@query
def op12_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query
def op13_pieces(spark, sf_dir):
    """Digests of the ids and of the decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path(PIECES)
    encoded = pieces.encode(docs, path, keep_text=False)
    n_bytes = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("n_bytes")
    decoded = pieces.decode(encoded.select("doc_id", "ids", n_bytes), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_bytes",
    )


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
