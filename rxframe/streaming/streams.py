"""Structured Streaming jobs.

* ``consult_stream``: requests arrive as files; each micro-batch runs the bulk
  consult against a static, pre-materialised master.  Ranking windows are not
  allowed on a stream, so the per-batch work runs in ``foreachBatch`` and each
  batch is written to its own ``batch=<id>`` folder (overwrite), which makes a
  replayed batch idempotent.
* ``page_extract_stream``: landed pages arrive as files; extraction is a pure
  projection, so it streams straight into a file sink whose checkpoint makes
  a restart skip everything already done (the resume rule) and records
  progress after every batch (the periodic save).
* ``record_stream``: landed detail pages become lookup records; the records and the search
  names they came from are published as one version per micro-batch, so work resumes by
  name, whatever the files are called and whichever checkpoint a restart has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxframe.operators.detail_pages import leaflet_records
from rxframe.operators.pages import page_texts
from rxframe.plans.consult import ConsultBase, VersionedConsult
from rxframe.session import ScratchGroup
from rxframe.sources.versions import current, write_version


def run_available_now(writer, timeout_s: int | None = None):
    """Start with ``availableNow``, wait for the end (at most ``timeout_s`` if given), always stop."""
    q = writer.trigger(availableNow=True).start()
    try:
        if timeout_s is None:
            q.awaitTermination()
        elif not q.awaitTermination(timeout_s):
            raise TimeoutError(f"stream {q.id} did not finish in {timeout_s}s")
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    finally:
        if q.isActive:
            q.stop()
    return q


def consult_stream(spark: SparkSession, requests_dir: str, requests_schema, output_dir: str,
                   checkpoint: str, per_batch: Callable[[DataFrame], DataFrame], *,
                   files_per_trigger: int = 1, timeout_s: int | None = None):
    """Run ``per_batch`` (requests -> prompts) on every micro-batch of the
    request files under ``requests_dir``; results land in ``output_dir``."""
    stream = (spark.readStream.schema(requests_schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(requests_dir))

    def handle(batch: DataFrame, batch_id: int) -> None:
        with ScratchGroup(spark) as own:  # a batch's intermediate tables end with it
            per_batch(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{output_dir}/batch={batch_id}")
        own.release()

    return run_available_now(stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint),
                             timeout_s)


def page_extract_stream(spark: SparkSession, pages_dir: str, pages_schema, output_dir: str, checkpoint: str,
                        *, page_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",),
                        files_per_trigger: int = 1, timeout_s: int | None = None):
    """R2 + S8: extract title/body/headings from every landed page exactly once."""
    stream = (spark.readStream.schema(pages_schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(pages_dir))
    extracted = page_texts(stream, page_col, html_col, keep=keep)
    return run_available_now(extracted.writeStream.format("parquet").option("path", output_dir)
                             .option("checkpointLocation", checkpoint).outputMode("append"), timeout_s)


RECORDS, DONE = "records", "done"
BROADCAST_BYTES = 64 << 20


def record_batch(batch: DataFrame, base: str, *, name_col: str, url_col: str, html_col: str = "html",
                 min_len: int = 10) -> int | None:
    """J5 + H2/H3 of one micro-batch: the pages of names that are not done yet become records,
    published together with their names.  The number of the new version, or ``None`` if all
    names were done (a replayed batch, pages landed again under another file name).

    The done names, however many, are only scanned where the batch's distinct names have at
    most ``BROADCAST_BYTES`` (measured per batch): those go to the tasks that scan.  Beyond, both
    are shuffled.  Pages of one name belong in one batch; pages of a name that come in a later
    one count as done.  A missing name is skipped.
    """
    spark = batch.sparkSession
    v = current(spark, base)
    names = batch.select(F.col(name_col).alias("name")).where("name is not null").distinct()
    if v and DONE in v.tables:
        size = names.agg(F.coalesce(F.sum(F.octet_length("name") + 16), F.lit(0)).alias("n")).first()["n"]
        seen = v.read(spark, DONE).join(F.broadcast(names) if size <= BROADCAST_BYTES else names, "name", "left_semi")
        names = names.join(seen, "name", "left_anti")
    todo = batch.join(names, batch[name_col] == names["name"], "left_semi")
    if todo.isEmpty():
        return None
    records = leaflet_records(todo, name_col, url_col, html_col, min_len=min_len)
    return write_version(spark, base, {RECORDS: records, DONE: names}, append=True,
                         expected=v.number if v else 0).number


def record_stream(spark: SparkSession, pages_dir: str, pages_schema, base: str, checkpoint: str, *,
                  name_col: str, url_col: str, html_col: str = "html", min_len: int = 10,
                  files_per_trigger: int = 1, timeout_s: int | None = None):
    """R2 + J5: landed pages to versioned lookup records, resumable by search name."""
    stream = (spark.readStream.schema(pages_schema).option("maxFilesPerTrigger", files_per_trigger)
              .option("recursiveFileLookup", True).parquet(pages_dir))

    def handle(batch: DataFrame, batch_id: int) -> None:
        record_batch(batch, base, name_col=name_col, url_col=url_col, html_col=html_col, min_len=min_len)

    return run_available_now(stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint), timeout_s)


def versioned_consult_stream(spark: SparkSession, requests_dir: str, requests_schema, output_dir: str, checkpoint: str,
                             consult: VersionedConsult, per_batch: Callable[[DataFrame, DataFrame, ConsultBase], DataFrame],
                             *, files_per_trigger: int = 1, timeout_s: int | None = None):
    """R1 over a changing master: ``per_batch(requests, master, base)`` with the master version
    that is current when the micro-batch starts."""
    try:
        return consult_stream(spark, requests_dir, requests_schema, output_dir, checkpoint,
                              lambda batch: per_batch(batch, *consult.use()), files_per_trigger=files_per_trigger,
                              timeout_s=timeout_s)
    finally:
        consult.release()
