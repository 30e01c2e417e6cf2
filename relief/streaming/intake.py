"""ST1: scene manifests arrive as files and are analysed once per job id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from relief.functions.pixel import decoded_size_problem
from relief.functions.text import settings_problem
from relief.session import materialise

MANIFEST = """job_id string, scene_id string, ts timestamp, width int, height int, gcp_sampling string,
 quality_mode string, has_dem boolean, has_gcps boolean"""

REPEATED = "this job has been analysed already"

Analysis = Callable[[DataFrame], DataFrame]


def checked_manifests(manifests: DataFrame, max_pixels: int | None = None) -> DataFrame:
    """Manifests with the reason each is refused, NULL when accepted."""
    reason = F.coalesce(
        F.when(
            F.col("has_dem") & F.col("has_gcps"),
            F.lit("Supply only one deployment calibration reference: reference_dem or gcps"),
        ),
        settings_problem("gcp_sampling", "quality_mode"),
        decoded_size_problem(F.col("width"), F.col("height"), max_pixels),
    )
    return manifests.withColumn("reason", reason)


def once_per_job(manifests: DataFrame) -> DataFrame:
    """Give a reason to manifests whose job another one of the table serves.

    Of a job's acceptable manifests the earliest is served. None is dropped:
    each row leaves with its analysis or a reason.
    """
    first = Window.partitionBy("job_id", F.col("reason").isNull()).orderBy("ts", "scene_id")
    repeated = F.col("reason").isNull() & (F.row_number().over(first) > 1)
    return manifests.withColumn("reason", F.coalesce("reason", F.when(repeated, F.lit(REPEATED))))


_MARKED = "job_id string, manifest string, repeated boolean"


def _first_of_job(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Mark all manifests of a job but the one that is served, now or before.

    Manifests come in bounded pieces; only the earliest so far is held back, so
    a job that is sent again without end needs no more memory.
    """
    best = None
    for piece in batches:
        piece = piece.sort_values(["order", "named"], kind="stable")
        if not state.exists and len(piece):
            head, piece = piece.iloc[:1], piece.iloc[1:]
            if best is not None:
                pair = pd.concat([best, head]).sort_values(["order", "named"], kind="stable")
                head, piece = pair.iloc[:1], pd.concat([pair.iloc[1:], piece])
            best = head
        yield piece[["job_id", "manifest"]].assign(repeated=True)
    if best is not None:
        state.update((True,))
        yield best[["job_id", "manifest"]].assign(repeated=False)


def mark_served(manifests: DataFrame) -> DataFrame:
    """ST1 over a stream: acceptable manifests of a job already served get a reason.

    Which jobs are served is keyed state of the stream, one flag for each job.
    It never expires, so a job is served once however late it comes again, and
    no stored run is read.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifests.schema)
    time = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    packed = manifests.where("reason IS NULL").select(
        "job_id",
        # the order of once_per_job: null first
        F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 63))).alias("order"),
        F.coalesce("scene_id", F.lit("")).alias("named"),
        F.to_json(F.struct(*manifests.columns), time).alias("manifest"),
    )
    marked = packed.groupBy("job_id").applyInPandasWithState(
        _first_of_job, _MARKED, "served boolean", "append", GroupStateTimeout.NoTimeout
    )
    opened = marked.select(F.from_json("manifest", fields, time).alias("_m"), "repeated").select("_m.*", "repeated")
    judged = opened.withColumn("reason", F.when(F.col("repeated"), REPEATED)).drop("repeated")
    return judged.unionByName(manifests.where("reason IS NOT NULL"))


def start_intake(
    spark: SparkSession,
    source: str,
    runs_path: str,
    checkpoint: str,
    analysis: Analysis,
    max_files: int | None = None,
) -> StreamingQuery:
    """Analyse every waiting manifest, then stop; run again for later files.

    `checkpoint` holds the served jobs. Each micro-batch replaces its own
    batch_id folder, so one that is retried after a failure, with the state it
    began with, leaves its runs exactly once.
    """
    reader = spark.readStream.schema(MANIFEST)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = mark_served(checked_manifests(reader.parquet(source)))

    def handle(batch: DataFrame, batch_id: int) -> None:
        # written once: reading the batch again would run its state update again
        judged = materialise(batch)
        if judged.isEmpty():
            return
        accepted = analysis(judged.where("reason IS NULL").drop("reason")).withColumn(
            "reason", F.lit(None).cast("string")
        )
        refused = judged.where("reason IS NOT NULL").select("job_id", "scene_id", "reason")
        runs = accepted.unionByName(refused, allowMissingColumns=True)
        runs.write.mode("overwrite").parquet(f"{runs_path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
