"""Exact deduplication as a stateful stream.

The content of each run has a digest and a row number; its locator is (run, row), and where runs go
on from one another the content is written under it.  A narrow table of (digest, identifier, locator) is read as a stream and aggregated by digest
without a watermark: the state, kept on disk by RocksDB, never expires and holds, for each digest,
the stable identifier that stays, the locator of its content and the number of copies.
Micro-batches are bounded in bytes, a batch is committed under its number, so that a replay
overwrites itself.  A later run under the same ``place`` goes on from the same state; a run that
failed goes on where it stopped, and one that is repeated under its number counts once.

Equal digests are only hits: the full bytes of every hit, also of those between runs, are compared
(smallest and largest text of a digest, combined before the shuffle), and a digest whose texts
differ is regrouped by the texts themselves.

Scale: a digest that a third of all rows share is one row per task before any shuffle; the
join of rows to the state is a plain shuffle join whose hot partitions adaptive execution
splits.  Texts move for hits alone where these are few enough to be broadcast (their number is
checked); beyond that texts are joined to the hits by a shuffle.

Defined results: null counts as an empty text; of equal texts the row with the largest id
stays (a null id is below all others); of repeated rows with that id exactly one stays; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Marked, exists, release, shared_dir, stored, text_or_empty

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State on local disk, its changes (not whole snapshots) logged with each commit.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # One cache for all partitions of an executor: each with its own takes memory by their number.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
BATCH_BYTES = 1 << 34
#: Digests of hits (some 100 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000
OUT = ["id", "row", "digest", "keep_id", "group_size", "kept"]


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def run_state(spark, source: str, schema, place: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Feed the digests under ``source`` that are new since the last run into the state under
    ``place``; return the state: digest, keep (id, run, row), n."""
    out = f"{place}/state"
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(source)
    kept = stream.groupBy("digest").agg(F.max(F.struct("id", "run", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = kept.writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not exists(spark, out):
        return spark.createDataFrame([], kept.schema)  # the stream was empty
    updates = spark.read.schema(T.StructType([*kept.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    if updates.where("batch > 0").isEmpty():
        return updates.drop("batch")
    last = updates.groupBy("digest").agg(F.max(F.struct("batch", "keep", "n")).alias("last"))
    return stored(last.select("digest", "last.keep", "last.n"), "dedup-state")


def _grouped(rows: DataFrame, place: str, run: int, batch_bytes: int, broadcast_rows: int, keep_content: bool) -> DataFrame:
    """``rows``: id, text, digest.  With ``keep_content`` the texts are written next to their
    digests, for the runs that come after."""
    spark, named = rows.sparkSession, rows.withColumns({"row": F.monotonically_increasing_id(), "run": F.lit(run)})
    if keep_content:
        path = f"{place}/content/run-{run}"
        if not exists(spark, f"{path}/_SUCCESS"):
            named.write.mode("overwrite").parquet(path)
        texts = spark.read.schema(named.schema).parquet(f"{place}/content/*")
        named = spark.read.schema(named.schema).parquet(path)
    else:
        texts = rows.withColumn("run", F.lit(run))
    narrow, path = named.select("digest", "id", "run", "row"), f"{place}/digests/run-{run}"
    if not exists(spark, f"{path}/_SUCCESS"):
        narrow.write.mode("overwrite").parquet(path)
    state = run_state(spark, f"{place}/digests/*", narrow.schema, place, batch_bytes)
    own = spark.read.schema(narrow.schema).parquet(path)
    keep = F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("keep.run") == F.col("run")) & (F.col("keep.row") == F.col("row"))).alias("kept")
    out = own.join(state, "digest").select("id", "row", "digest", *keep)

    hits = state.where("n > 1").select("digest")
    if run:
        hits = hits.join(own.select("digest").distinct(), "digest", "left_semi")
    hits = stored(hits, "dedup-hits")
    few = hits.limit(broadcast_rows + 1).count() <= broadcast_rows
    met = texts.select("digest", "text").join(F.broadcast(hits) if few else hits, "digest", "left_semi")
    unlike = met.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("digest")
    unlike = stored(unlike, "dedup-collisions")
    release(hits)
    if unlike.isEmpty():
        return out
    # A row number of its own here, as texts that were not written have none.
    every = texts.join(unlike, "digest", "left_semi").select("digest", "id", "text", "run").withColumn("row", F.monotonically_increasing_id())
    every = stored(every, "dedup-regrouped")
    best = stored(every.groupBy("digest", "text").agg(F.max(F.struct("id", "run", "row")).alias("keep"), F.count(F.lit(1)).alias("n")), "dedup-regrouped")
    again = every.where(F.col("run") == run).join(best, ["digest", "text"]).select("id", "row", "digest", *keep)
    return out.join(unlike, "digest", "left_anti").select(OUT).unionByName(again)


def exact_groups(docs: DataFrame, id_col="doc_id", text_col="text", digest=sha256, place: str | None = None, run: int = 0, batch_bytes: int = BATCH_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each input row: id, row, digest, keep_id, group_size, kept.

    With ``place``, a folder that all executors share, runs 0, 1, 2 ... go on from one another:
    the result is that of this run's rows among all rows so far."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", digest(F.col("text")))
    return _grouped(rows, place or shared_dir(docs.sparkSession, "dedup"), run, batch_bytes, broadcast_rows, bool(place)).select(OUT)


def drop_exact_copies(docs: DataFrame, id_col="doc_id", text_col="text", digest=sha256, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    marked = Marked(docs, id_col, text_col, digest)
    return marked.kept(exact_groups(marked.rows, "id", "text", digest, **options))
