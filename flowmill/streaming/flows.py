"""Flow summaries and sequence health while packets arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.operators.flows import flow_summary, joined_health, sequence_ranges


def run_updates(stream: DataFrame, keys: list[str], where: str) -> DataFrame:
    """Runs a stream in update mode over what is there, writes each batch's changes, and returns each key's last row."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/rows/batch={number}")

    q = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{where}/checkpoint").foreachBatch(put).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{where}/rows").drop("batch")
    w = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_batch")


def stream_flow_summary(packets: DataFrame, where: str) -> DataFrame:
    """flow_summary of a stream of packets; equal to the batch result over all that has arrived."""
    return run_updates(flow_summary(packets), ["capture_id", "spi_int"], where)


def windowed_volume(packets: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Packets and bytes of each capture in tumbling windows of ts, for append mode: state ends with the watermark."""
    return packets.withWatermark("ts", delay).groupBy("capture_id", F.window("ts", width)).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


def closed_windows(packets: DataFrame, where: str, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """windowed_volume of a stream, in append mode, over all that has arrived: for each window that is closed capture_id, start,
    packets, bytes and late, the packets that came when it was closed and are not counted. Windows end with the watermark,
    the latest ts so far less delay; those after it are open and not given. A window all of whose packets were late has 0
    packets. Packets without ts have no window.

    Spark keeps the open windows as its state and no others. How many packets came is counted batch by batch beside it
    (a batch that is run again overwrites its own), and what is missing in a closed window was late."""
    spark = packets.sparkSession
    counted = windowed_volume(packets, delay, width).select("capture_id", F.col("window.start").alias("start"), "packets", "bytes")
    schema = counted.schema

    def put(batch: DataFrame, number: int) -> None:
        came = batch.where("ts is not null").groupBy("capture_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("came"), F.max("ts").alias("latest"))
        came.select("capture_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "came", "latest").write.mode("overwrite").parquet(f"{where}/came/batch={number}")

    for name, q in (
        ("closed", counted.writeStream.outputMode("append").format("parquet").option("path", f"{where}/closed")),
        ("came", packets.writeStream.foreachBatch(put)),
    ):
        q.trigger(availableNow=True).option("checkpointLocation", f"{where}/checkpoint-{name}").start().awaitTermination()
    key = f"capture_id {schema['capture_id'].dataType.simpleString()}, start timestamp"
    came = spark.read.schema(f"{key}, end timestamp, came long, latest timestamp, batch int").parquet(f"{where}/came")
    mark = came.agg((F.max("latest") - F.expr(f"interval {delay}")).alias("mark"))
    all_came = came.groupBy("capture_id", "start", "end").agg(F.sum("came").alias("came"))
    ended = all_came.join(mark, F.col("end") <= F.col("mark"))
    closed = spark.read.schema(schema).parquet(f"{where}/closed").select(F.col("capture_id").alias("_c"), F.col("start").alias("_s"), "packets", "bytes")
    out = ended.join(closed, F.col("capture_id").eqNullSafe(F.col("_c")) & (F.col("start") == F.col("_s")), "left")
    n, size = F.coalesce("packets", F.lit(0)), F.coalesce("bytes", F.lit(0))
    return out.select("capture_id", "start", n.alias("packets"), size.alias("bytes"), (F.col("came") - n).alias("late"))


def stream_sequence_health(packets: DataFrame, where: str) -> DataFrame:
    """Gaps, steps back, repeats and packets of each ESP flow of a stream, over all that has arrived; equal to the batch
    result. Frames of a later batch come after those of the batches before it; within a batch they need no order.

    A batch leaves a row for each range of frames of a flow, with the numbers at either end, and how often each number
    came; a batch that is run again overwrites its own. The rows are joined end to end when they are read, so no worker
    holds a flow and no state is kept between batches but these tables. Null numbers repeat nothing."""
    keys = ("capture_id", "spi_int")

    def put(batch: DataFrame, number: int) -> None:
        sequence_ranges(batch).write.mode("overwrite").parquet(f"{where}/ranges/batch={number}")
        counts = batch.where("proto = 'ESP' and seq is not null").groupBy(*keys, "seq").agg(F.count("*").alias("times"))
        counts.write.mode("overwrite").parquet(f"{where}/numbers/batch={number}")

    packets.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{where}/checkpoint").foreachBatch(put).start().awaitTermination()
    spark, field = packets.sparkSession, packets.schema
    key_types = ", ".join(f"{k} {field[k].dataType.simpleString()}" for k in keys)
    number = field["seq"].dataType.simpleString()
    ranges = spark.read.schema(f"{key_types}, _part long, n long, first {number}, last {number}, gap long, back long, batch int").parquet(f"{where}/ranges")
    numbers = spark.read.schema(f"{key_types}, seq {number}, times long").parquet(f"{where}/numbers")
    again = numbers.groupBy(*keys, "seq").agg(F.sum("times").alias("times")).groupBy(*keys).agg(F.sum(F.col("times") - 1).alias("repeats"))
    again = again.select(*(F.col(k).alias(f"_{k}") for k in keys), "repeats")
    health = joined_health(ranges.withColumn("_place", F.struct("batch", "_part")), keys, "_place")
    same = F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}")) & F.col(keys[1]).eqNullSafe(F.col(f"_{keys[1]}"))
    return health.join(again, same, "left").select(*keys, F.col("sequence_gaps").alias("gaps"), "steps_back", F.coalesce("repeats", F.lit(0)).alias("repeats"), "packets")
