"""Exact deduplication as a stateful stream.

The rows are staged once with a digest. A streaming aggregation then keeps, per digest and without
expiry, the identifier of the first row, where its content lies (its row of the staged table) and the
number of rows; the state lives in RocksDB on disk, and its snapshots in the shared folder. A digest
that was hit more than once is only a claim, so the full texts of all its rows are compared before
the claim is believed; rows that share a digest but not a text are grouped by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, fresh_path, hot_keys, keep, materialise, min_by_order, scratch, settings, split_join

#: Keyed state on disk; many small stores shouldn't each reserve disk ahead of need.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: Bits of a locator that number the rows of a part, as Spark's increasing ids do.
PART_BITS = 33


def normalised(text: Column) -> Column:
    """``text`` with every run of white space as one space, null as empty; a lone space is left as it is."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def stage(docs: DataFrame, path: str, text: str = "text", digest: Callable[[Column], Column] = sha256_digest) -> None:
    """Adds to the staged table at ``path``: the columns of ``docs`` under ``row`` and, beside them, locator and digest.

    A row keeps its locator for good, and later calls go on behind the greatest part (the upper 31
    bits) of those before, so locators tell the rows of all calls apart. Calls follow one another.
    """
    spark = docs.sparkSession
    before = spark.read.schema("locator long").parquet(path).agg(F.max("locator")).first()[0] if exists(spark, path) else None
    start = 0 if before is None else ((before >> PART_BITS) + 1) << PART_BITS
    sha = F.sha2(normalised(F.col(text)), 256)
    key = sha if digest is sha256_digest else digest(normalised(F.col(text)))
    docs.select(
        (F.monotonically_increasing_id() + F.lit(start).cast("long")).alias("locator"),
        key.alias("digest"),
        sha.alias("text_sha256"),
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
    ).write.mode("append").parquet(path)


def update_state(spark: SparkSession, staged: str, state: str, doc_id: str = "doc_id") -> DataFrame:
    """Streams what is new in ``staged`` through the keyed state at ``state``; returns the whole state.

    A later call with the same paths takes in only the files that have come since. One row per
    digest: digest, first (struct: doc_id and locator of the row that stays), group_size.
    """
    schema = spark.read.parquet(staged).schema
    with settings(spark, STATE):
        kept = (
            spark.readStream.schema(schema)
            .parquet(staged)
            .groupBy("digest")
            .agg(min_by_order(F.col(f"row.{doc_id}"), F.col("locator")).alias("first"), F.count(F.lit(1)).alias("n"))
        )
        query = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        raw = spark.read.format("statestore").load(state)
    first, n = (raw.schema["value"].dataType.fieldNames())[:2]
    return raw.select(
        F.col("key.digest").alias("digest"),
        F.struct(F.col(f"value.{first}.key_0").alias("doc_id"), F.col(f"value.{first}.key_1").alias("locator")).alias("first"),
        F.col(f"value.{n}").alias("group_size"),
    )


def compare_bytes(rows: DataFrame, state: DataFrame, hot: DataFrame | None, text: str = "text") -> DataFrame:
    """The rows whose full text differs from that of the row their digest stands for.

    Only rows of digests with several hits are compared. The texts of a ``hot`` digest are dealt over
    several tasks, and the row that it stands for goes to each of them.
    """
    hits = state.where("group_size > 1").select("digest", F.col("first.locator").alias("keeper"))
    texts = rows.select("digest", "locator", normalised(F.col(f"row.{text}")).alias("full"))
    full = materialise(split_join(texts, hits, ["digest"], "locator", hot), "dedup-hits")
    keepers = full.where(F.col("locator") == F.col("keeper")).select("digest", F.col("full").alias("kept_full"))
    others = full.where(F.col("locator") != F.col("keeper")).drop("keeper")
    return materialise(split_join(others, keepers, ["digest"], "locator", hot).where(F.col("full") != F.col("kept_full")).select("digest", "locator", "full"), "dedup-differing")


def decide(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row per row of ``docs``: row (its columns), keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the smallest ``doc_id`` stays (null last);
    of repeated rows with one ``doc_id`` and text exactly one stays. Other columns, whatever their
    names, are carried inside ``row``. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    staged = fresh_path(spark, "dedup-staged")
    stage(docs, staged, text, digest)
    rows = spark.read.parquet(staged)
    with scratch(spark):
        state = materialise(update_state(spark, staged, fresh_path(spark, "dedup-state"), doc_id), "dedup-groups")
        hot = hot_keys(state.select("digest", F.col("group_size").alias("n")), ["digest"])
        differing = compare_bytes(rows, state, hot, text)
        places = rows.select("locator", "digest")
        decided = split_join(places, state, ["digest"], "locator", hot).select("locator", "first", "group_size")
        if not differing.isEmpty():
            # Digests that stand for more than one text: their rows are grouped by the text itself.
            several = differing.select("digest").distinct()
            full = rows.join(several, "digest").select("digest", "locator", F.col(f"row.{doc_id}").alias("doc_id"), normalised(F.col(f"row.{text}")).alias("full"))
            split = full.groupBy("digest", "full").agg(min_by_order(F.col("doc_id"), F.col("locator")).alias("m"), F.count(F.lit(1)).alias("group_size"))
            split = split.select("digest", "full", F.struct(F.col("m.key_0").alias("doc_id"), F.col("m.key_1").alias("locator")).alias("first"), "group_size")
            apart = full.join(split, ["digest", "full"]).select("locator", "first", "group_size")
            decided = decided.join(apart.select("locator"), "locator", "left_anti").unionByName(apart)
        decided = keep(decided, "dedup-decided")
    return rows.join(decided, "locator").select(
        "row",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("locator") == F.col("first.locator")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256 (see ``decide``)."""
    return decide(docs).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row already has; the columns stay as they are."""
    return decide(docs).where("kept").select("row.*")


SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
