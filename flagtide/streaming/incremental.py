"""Guard extraction over a file table that keeps growing.

New parquet files of ``source_files`` rows (``repo_id, path, size, content``)
are picked up by Structured Streaming and run through the same per-file
extraction as the batch job. Extraction is stateless per file, so there is no
watermark and no state store; the checkpoint location (under the shared
``spark.checkpoint.dir`` unless given) records which input files are done,
so a restarted query neither loses nor repeats files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from flagtide.operators.guards import extract_files
from flagtide.session import ensure_checkpoint_dir

SOURCE_SCHEMA = "repo_id string, path string, size bigint, content binary"


def start_incremental_extraction(spark: SparkSession, source_dir: str, output_dir: str,
                                 checkpoint_location: str | None = None,
                                 available_now: bool = False,
                                 max_files_per_trigger: int = 64) -> StreamingQuery:
    """Start the stream: per-file guard rows (or problems) appended as parquet."""
    if checkpoint_location is None:
        checkpoint_location = ensure_checkpoint_dir(spark).rstrip("/") + "/streams/extraction"
    files = (spark.readStream.schema(SOURCE_SCHEMA)
             .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    per_file = extract_files(files)
    writer = (per_file.writeStream.format("parquet").outputMode("append")
              .option("path", output_dir).option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
