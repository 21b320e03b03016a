"""The contract's queries: each runs one operator over its whole table and derives the digest columns from its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, imatch, licenses, mixing, orc_ids, packing, quality, secrets, sharding, simhash
from .common import cut, shared_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.detect(_documents(spark, sf_dir).select("doc_id", "text"))
    spans, base = F.col("secrets"), F.filter("secrets", lambda x: x["rank"] < len(secrets.BASE))
    of = lambda rank: F.size(F.filter("secrets", _of_rank(rank))).cast("long")
    return found.select(
        "doc_id",
        *(of(i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(secrets.BASE)),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(spans).alias("spans"),
        of(len(secrets.BASE)).alias("n_entropy"),
        F.array_max(F.transform(spans, lambda x: x["bits"])).alias("most_bits"),
    )


def _of_rank(rank: int):
    return lambda x: x["rank"] == rank


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = mixing.sizes(_documents(spark, sf_dir))
    found = mixing.copies(slim, cut(mixing.targets(slim)), ["size", "id", "hash"])
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    lexicon = imatch.fit_lexicon(docs)
    pairs = imatch.edited_pairs(docs).withColumn("sha", F.sha2("edited", 256))
    keys = ["key", "hash", "id", "n", "before_key", "before_hash", "sha"]
    found = cut(imatch.fingerprints(pairs, keys, {"own": "text", "edited": "edited"}, lexicon))
    after = found.select(F.col("before_key").alias("key"), F.col("before_hash").alias("hash"), F.col("own").alias("next")).dropDuplicates(["key", "hash"])
    own, edited, following = F.col("own"), F.col("edited"), F.col("next")
    return found.join(after, ["key", "hash"]).select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        imatch.text_of(own).alias("fingerprint"),
        imatch.text_of(edited).alias("edited_fingerprint"),
        imatch.likeness(own, edited).alias("near_edited"),
        imatch.likeness(own, following).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(simhash.with_fingerprint(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fingerprint"))
    return simhash.cluster(found).withColumn("fingerprint", simhash.hex_digits(F.col("fingerprint")))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "licenses.*").withColumn("n_found", F.size("found").cast("long")).drop("found")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the features are a few numbers a document, so they are written once and read for the references and for the verdicts
    found = cut(quality.features(_documents(spark, sf_dir).select("doc_id", "text", "lang")).drop("text"))
    return quality.judge(found, quality.references(found)).select("doc_id", "quality.*")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return classifier.classify(docs, labels)


def op9_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(_documents(spark, sf_dir))
    return found.select("doc_id", "size", F.col("crc32").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_orc_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = shared_path(spark, "token-ids")
    orc_ids.write(_documents(spark, sf_dir), path, tokenizer, end_id=1)
    return orc_ids.digest(orc_ids.read(spark, path))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scans, op2_source_mixing, op3_imatch_fingerprints, op4_simhash_near_duplicates, op5_license_scans, op6_quality_rules, op7_packing, op8_quality_classifier, op9_balanced_sharding, op10_orc_token_ids, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": mixing.SQL}
