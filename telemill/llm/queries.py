"""Queries over the driver tables: one thin ``opN_<name>`` each, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, linededup, merkle, minhash, ogg, packing, pieces, pii, quality, sharding, spelling, sql, vectors
from .workspace import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """The path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f, oracle: str | None = None):
    QUERIES[f.__name__] = f
    if oracle:
        ORACLES[f.__name__] = oracle
    return f


def with_oracle(oracle: str):
    return lambda f: query(f, oracle)


@with_oracle(sql.sharding(sharding.round_keys(), sharding.SHARDS))
def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")


@query
def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digest(table(spark, sf_dir, "documents"))


@query
def op10_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op7_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("digest")


@query
def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.concat_ws(";", F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["stop"].cast("string"), s["edits"].cast("string")))))


#: For these public test tables; real runs pass a secret of their own.
PII_KEY = b"telemill public test key"


@query
def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), PII_KEY)


@query
def op9_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), equal=1).select("doc_id", "n_lines", "n_repeats", "text")


@query
def op3_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op4_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@with_oracle(sql.MERKLE)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query
def op13_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@with_oracle(sql.SPELLING)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
