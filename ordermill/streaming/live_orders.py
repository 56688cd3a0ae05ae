"""Live orders: append incoming orders, one row per order, under replayed input."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructType

from ordermill.contracts import LIVE_ORDERS, LIVE_REJECTS
from ordermill.operators.quality import conform
from ordermill.session import remove, scratch_path
from ordermill.sinks.append import append_missing
from ordermill.sinks.counted import write_counted
from ordermill.sinks.layers import Layers, PathLayers
from ordermill.sources.files import path_exists


def file_stream(
    spark: SparkSession, path: str, schema: StructType, max_files: int | None = None
) -> DataFrame:
    """Parquet files as a stream: a folder that fills up, or one file.

    ``max_files`` bounds the files of one micro-batch.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rstrip("/").rpartition("/")
    if _is_file(spark, path):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return file_system.getFileStatus(hadoop_path).isFile()


def live_orders(incoming: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Incoming orders in the declared shape, absent times being now, and columns to keep."""
    return conform(incoming, LIVE_ORDERS, keep)


def unique_orders(orders: DataFrame) -> DataFrame:
    """One row per order id for the life of the stream.

    Exact. The state holds every key ever seen, spread by key over the state store. All
    repeats of one id meet in one state task; where a single id may repeat without
    bound, use ``upsert_stream``, which drops repeats before they move.
    """
    return orders.dropDuplicates(["order_id"])


def unique_orders_within(
    incoming: DataFrame, delay: str, time_column: str = "order_timestamp"
) -> DataFrame:
    """One row per order id among repeats that arrive within ``delay`` of each other.

    Takes the orders as received, before absent times default to now: the watermark follows
    received times only. Keys older than the watermark are forgotten and rows older than it
    are dropped as late, so this is exact only if nothing arrives later than the delay. Orders
    without a time never move the watermark; their ids, which should be few, are kept for
    good. An order that comes once with a time and once without counts as two.
    """
    timed = incoming.filter(F.col(time_column).isNotNull())
    untimed = incoming.filter(F.col(time_column).isNull())
    recent = timed.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["order_id"])
    return recent.union(untimed.dropDuplicates(["order_id"]))


# The shape of orders as received: all but the time of processing.
INCOMING = StructType([f for f in LIVE_ORDERS.schema if f.name != "processed_at"])
# How a stream is driven: everything available, then stop; or ``{"processingTime": "1 minute"}``.
ONCE = {"availableNow": True}


def append_stream(
    orders: DataFrame, path: str, checkpoint: str, trigger: Mapping = ONCE
) -> StreamingQuery:
    """Append everything available to Parquet, exactly once."""
    return (
        orders.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )


REJECTED_COLUMNS = "_rejected_columns"


def rejected_columns() -> Column:
    """Of an order received as text, the columns whose cell is no value of the declared type.

    An absent id is at fault as well: an order without one can be told from no other.
    """
    reasons = [
        F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f.name))
        for f in INCOMING
        if not isinstance(f.dataType, StringType)
    ]
    reasons.append(F.when(F.col("order_id").isNull(), F.lit("order_id")))
    return F.filter(F.array(*reasons), lambda c: c.isNotNull())


def upsert_text_stream(
    incoming: DataFrame,
    name: str,
    target: PathLayers,
    checkpoint: str,
    trigger: Mapping = ONCE,
    tell: Callable[[int, int, int], None] | None = None,
) -> StreamingQuery:
    """``upsert_stream`` for orders received as text; those that do not cast go to ``live_rejects``.

    The stream goes on past an order with a cell that is no value of its type or without an id:
    its text and the columns at fault are kept. A batch is read once, into the shared scratch folder,
    from where both sinks take their rows; received and rejected orders are counted on that way
    and told as (batch, received, rejected). The rejects of a batch are a part named after stream
    and batch, so a replayed batch writes them in their place.
    """
    text = incoming.select(*[F.col(f.name).cast("string") for f in INCOMING])
    bad = F.size(REJECTED_COLUMNS) > 0

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = scratch_path(spark, f"{name}-{batch_id}")
        checked = batch.withColumn(REJECTED_COLUMNS, rejected_columns())
        seen = write_counted(
            checked, lambda d: d.write.parquet(staged), {"rejected": F.count_if(bad)}
        )
        rows = spark.read.schema(checked.schema).parquet(staged)
        rejects = rows.filter(bad).select(
            F.to_json(F.struct(*INCOMING.names)).alias("raw_order"),
            F.col(REJECTED_COLUMNS).alias("rejected_columns"),
            F.current_timestamp().alias("rejected_at"),
        )
        target.write_part(rejects, LIVE_REJECTS, f"{name}-{batch_id}")
        _append(rows.filter(~bad).drop(REJECTED_COLUMNS), target)
        remove(spark, staged)
        if tell:
            tell(batch_id, seen.rows, seen.metrics["rejected"])

    return (
        text.writeStream.queryName(name)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _append(batch: DataFrame, target: Layers) -> None:
    shaped = live_orders(batch)
    if isinstance(target, PathLayers):
        day = F.to_date(F.col("order_timestamp").cast("timestamp"))
        received = batch.withColumn(LIVE_ORDERS.stored_by, day)
        shaped = live_orders(received, keep=[LIVE_ORDERS.stored_by])
    append_missing(shaped, LIVE_ORDERS, target)


def upsert_stream(
    incoming: DataFrame, target: Layers, checkpoint: str, trigger: Mapping = ONCE
) -> StreamingQuery:
    """Append to any target the orders it does not hold yet; takes orders as received.

    Without stream state: the target's keys take its place, for the life of the target and
    whatever the times. Of an order sent again, with the same or another day or none, the one
    that was stored first stays. Repeats within a batch are dropped map-side first, so a hot id
    moves as one row per task. A batch that is replayed after its write finds its rows in the
    target and adds nothing. Parquet targets keep a folder per day of the received time, one for
    orders without a time, and Bloom filters of the ids: see ``held_keys`` for what a batch costs.
    """

    return (
        incoming.writeStream.foreachBatch(lambda batch, _: _append(batch, target))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
