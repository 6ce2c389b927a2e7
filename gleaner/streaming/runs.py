"""Running a stream to the end of what is there, and state kept as a table between micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.inbox import merge_pending
from gleaner.operators.lifecycle import closures, last_fields, merge_state, patched_fields
from gleaner.session import ensure_checkpoint_dir
from gleaner.sources.parts import Files, PartTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful operators with TTL or timers keep their state in RocksDB, off the JVM heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def run_to_table(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Process everything available, exactly once, into a parquet table; a second call with the same folder
    reads only what arrived since."""
    spark = stream.sparkSession
    folder = folder or run_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").queryName(f"{name}-{uuid.uuid4().hex[:6]}")
        .option("checkpointLocation", f"{folder}/offsets").option("path", f"{folder}/rows")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


class StateTable:
    """A keyed table that grows by what changes: a base in buckets of keys, and one small delta a micro-batch.

    Batch N reads the base and the deltas below N and writes delta N: its changed rows, and the keys that are gone. The
    newest row of a key wins. After ``fold`` deltas the buckets that they touch are written anew, all others stay as they
    are. A batch that is replayed sees what it saw before and replaces its own delta.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = 16, fold: int = 8):
        self.spark, self.folder, self.schema, self.keys, self.fold = spark, folder, schema, keys, fold
        self.bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")
        self.base = PartTable(spark, f"{folder}/base", schema, self.bucket)
        self.files = Files(spark, folder)

    def deltas(self) -> list[int]:
        """Finished deltas, read from the folder, so a restarted driver goes on where it stopped."""
        names = [n for n in self.files.names(f"{self.folder}/deltas") if n.startswith("batch=")]
        return sorted(int(n.removeprefix("batch=")) for n in names if self.files.exists(f"{self.folder}/deltas/{n}/_SUCCESS"))

    def before(self, batch: int, keys: DataFrame | None = None) -> DataFrame:
        """The table as batch ``batch`` finds it, or only its rows for ``keys``: then only their buckets are read."""
        if keys is None:
            return self._rows(batch)
        return self._rows(batch, self.base.names_of(keys)).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def beside(self, batch: int, keyed: DataFrame, buckets: list[str]) -> DataFrame:
        """``keyed``, a row a key, with the row that batch ``batch`` finds for it, if any; ``buckets`` are those of its keys."""
        return keyed.join(self._rows(batch, buckets), self.keys, "left")

    def _rows(self, batch: int, buckets: list[str] | None = None) -> DataFrame:
        upto = max((v for v in self.base.versions() if v <= batch), default=None)  # version N holds the deltas below N
        rows = self.base.read(buckets, upto) if upto is not None else self.spark.createDataFrame([], self.schema)
        later = [n for n in self.deltas() if (upto or 0) <= n < batch]
        if not later:
            return rows
        folders = [f"{self.folder}/deltas/batch={n}" for n in later]
        changed = self.spark.read.schema(f"{self.schema}, _gone boolean, _batch bigint").parquet(*folders)
        both = rows.withColumns({"_gone": F.lit(False), "_batch": F.lit(-1).cast("bigint")}).unionByName(changed)
        if buckets is not None:
            both = both.filter(self.bucket.isin(buckets))
        newest = both.groupBy(*self.keys).agg(F.max_by(F.struct(*both.columns), "_batch").alias("_row"))
        return newest.filter("NOT _row._gone").select("_row.*").drop("_gone", "_batch")

    def start(self, rows: DataFrame) -> None:
        """The table before batch 0."""
        self.base.commit(append=rows, version=0)

    def write(self, changed: DataFrame, batch: int, touched: DataFrame | None = None) -> None:
        """Delta ``batch``: ``changed`` rows, and as gone the keys of ``touched`` that are not among them.

        Or ``changed`` says itself, in a column ``_gone``, which keys are gone.
        """
        rows = changed if "_gone" in changed.columns else changed.withColumn("_gone", F.lit(False))
        if touched is not None:  # the changed rows are worked out once
            rows = rows.join(touched.select(*self.keys).distinct(), self.keys, "full").withColumn("_gone", F.coalesce("_gone", F.lit(True)))
        rows.withColumn("_batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        upto = max(self.base.versions(), default=0)
        if len([n for n in self.deltas() if upto <= n <= batch]) >= self.fold and batch + 1 not in self.base.versions():
            self._fold(upto, batch)

    def _fold(self, upto: int, batch: int) -> None:
        folders = [f"{self.folder}/deltas/batch={n}" for n in self.deltas() if upto <= n <= batch]
        touched = self.spark.read.schema(f"{self.schema}, _gone boolean, _batch bigint").parquet(*folders)
        buckets = self.base.names_of(touched)
        rows = self.before(batch + 1).filter(self.bucket.isin(buckets))
        self.base.commit(replace=rows, parts=buckets, version=batch + 1)
        # the version before this one, and its deltas, stay for a batch that is replayed
        self.base.vacuum(keep=2)
        for n in self.deltas():
            if n < upto:
                self.files.delete(f"{self.folder}/deltas/batch={n}")

    def latest(self) -> DataFrame:
        return self.before(max(self.deltas(), default=-1) + 1)


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], folder: str) -> None:
    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/offsets")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def pending_after(notified: DataFrame) -> DataFrame:
    """Pending badge rows (mailbox, id, label, at) after every scan in the stream."""
    spark = notified.sparkSession
    folder = run_folder(spark, "pending")
    table = StateTable(spark, f"{folder}/state", "mailbox bigint, id bigint, label string, at bigint", ["mailbox", "id"])

    def step(batch: DataFrame, n: int) -> None:
        table.write(merge_pending(table.before(n, batch), batch), n)

    run_batches(notified, step, folder)
    return table.latest()


STATE = "url string, status string, note string, updated_at timestamp"


def state_after_patches(patches: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """State table (url, status, note, updated_at) after an ordered patch stream (url, ord, status, note, at)."""
    spark = patches.sparkSession
    folder = run_folder(spark, "job-state")
    table = StateTable(spark, f"{folder}/state", STATE, ["url"])
    if state is not None:
        table.start(state)

    def step(batch: DataFrame, n: int) -> None:
        # one pass for what the whole batch decides, one for its patches; each entry is read beside them
        newest, buckets = batch.agg(F.max(F.unix_micros("at")), F.collect_set(table.bucket)).first()
        named = table.beside(n, last_fields(batch), buckets)
        merged = named.select("url", *patched_fields(), F.timestamp_micros(F.lit(newest).cast("bigint")).alias("updated_at"))
        table.write(merged.withColumn("_gone", F.expr("status IS NULL AND note IS NULL")), n)

    run_batches(patches, step, folder)
    return table.latest()


def state_after_closures(found: DataFrame, state: DataFrame) -> DataFrame:
    """State after a stream of closures (url, at): each is decided against the state as it is by then."""
    spark = found.sparkSession
    folder = run_folder(spark, "closures")
    table = StateTable(spark, f"{folder}/state", STATE, ["url"])
    table.start(state)

    def step(batch: DataFrame, n: int) -> None:
        now = table.before(n, batch)
        patch = closures(batch.groupBy("url").agg(F.max("at").alias("at")), now).select(
            "url", F.lit(1).alias("ord"), F.lit("closed").alias("status"), F.lit(None).cast("string").alias("note")
        )
        merged = merge_state(now.join(patch.select("url"), "url", "left_semi"), patch, batch.agg(F.max("at")).scalar())
        table.write(merged, n)

    run_batches(found, step, folder)
    return table.latest()
