"""Structured Streaming jobs: intake, growing n-gram counts, telemetry, contamination flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.storage import fresh_path, written


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows, written to shared storage batch by batch.

    A batch that is run again writes over its own folder. In complete mode each batch has the whole result so far, and
    the last one counts.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, name)

    last = {"number": -1}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        last["number"] = number

    job = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    if last["number"] < 0:
        return spark.createDataFrame([], stream.schema)
    folder = f"{path}/out" if mode == "append" else f"{path}/out/batch={last['number']}"
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(folder)


class GrownCounts:
    """A table (key, n) on shared storage that batches of new keys are added to, changed buckets alone being written.

    Keys are dealt to ``buckets`` by a hash. A batch is counted, joined with the rows of the buckets it touches and
    written as their next version; a manifest per batch names each bucket's version, and nothing is ever written over
    but what a batch that is run again wrote itself. So a lost job goes on from the last whole batch, counts are exact
    and there is no state in the stream.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str = "string", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = f"`{key}` {kind}, n long"

    def versions(self, number: int) -> dict[int, int]:
        """Bucket -> version after batch ``number``; before the first batch nothing."""
        if number < 0:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/{number}").collect()}

    def read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{version}/bucket={bucket}" for bucket, version in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def add(self, batch: DataFrame, number: int) -> None:
        before = self.versions(number - 1)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = written(batch.groupBy(self.key).agg(F.count("*").alias("n")), "counted-batch")
        changed = {r["bucket"] for r in new.select(bucket.alias("bucket")).distinct().collect()}
        old = self.read({b: v for b, v in before.items() if b in changed})
        both = new.unionByName(old).groupBy(self.key).agg(F.sum("n").alias("n"))
        if changed:
            both.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
        after = before | {b: number for b in changed}
        self.spark.createDataFrame(sorted(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")


def drain_counts(stream: DataFrame, key: str, name: str, path: str | None = None, buckets: int = 64) -> DataFrame:
    """(key, n): how often each key came along in the whole stream; a given ``path`` goes on from what is there."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)
    table = GrownCounts(spark, path, key, stream.schema[key].dataType.simpleString(), buckets)
    last = {"number": -1}

    def add(batch: DataFrame, number: int) -> None:
        table.add(batch, number)
        last["number"] = number

    job = stream.select(key).writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return table.read(table.versions(last["number"]))


def intake(items: DataFrame, known: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """New items only: known questions excluded by normal form, repeated ones dropped.

    With a watermark the state of repeats is bounded by it; without one it grows with the distinct items.
    ``key`` is a hash of the normal form, so the state of an item is of one width whatever its length.
    """
    keyed = items.withColumn("key", T.norm_key(F.col("question"))).where("key <> ''")
    seen = known.select(T.norm_key(F.col("question")).alias("key")).distinct()
    fresh = keyed.join(seen, "key", "left_anti")
    return fresh.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["key"]) if watermark else fresh.dropDuplicates(["key"])


def ngrams_of(docs: DataFrame, order: int) -> DataFrame:
    """(gram) of every document; n-grams are cut inside each row, as streams have no row windows."""
    from corpuslab.operators.corpus import windows_of

    return docs.select(F.explode(windows_of(T.word_tokens(F.col("text")), order)).alias("gram"))


def telemetry(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) per window of event time, appended once the watermark has passed its end.

    Then its state goes; rows that come later than the watermark allows are dropped. Windows that are still open
    when the stream stops have no row yet. Rows without a time are left out.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null").withWatermark("ts", watermark)
    out = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def telemetry_whole(events: DataFrame, unit: str = "hour") -> DataFrame:
    """(start, event_type, n, total) of every unit of event time, for complete mode: open ones and late rows count too.

    Rows without a time have a row of their own, with start null. The state is one row per unit and type.
    """
    start = F.date_trunc(unit, F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("start")
    return events.groupBy(start, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def flag_contaminated(docs: DataFrame, items: DataFrame, words: int = 8) -> DataFrame:
    """(doc_id, item_id): arriving documents that share a run of ``words`` words with a benchmark item."""
    from corpuslab.operators.corpus import windows_of

    theirs = items.select("item_id", F.explode(windows_of(T.word_tokens(F.col("text")), words)).alias("w"))
    ours = docs.select("doc_id", F.explode(F.array_distinct(windows_of(T.word_tokens(F.col("text")), words))).alias("w"))
    return ours.join(theirs, "w").select("doc_id", "item_id").dropDuplicates()
