"""BED lines as a stream: files that appear in a folder, or any stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.sources.bed import by_mode, canonical, parse_bed


def stream_bed(spark: SparkSession, folder: str, width: int, additional_fields: int = 0, mode: str = "permissive", max_files: int | None = None) -> DataFrame:
    """A streaming DataFrame of records. Lines stand alone, so no state is kept; they have a file and no number.

    GTF and GFF make transcripts of lines that may lie anywhere in a file, so these
    are read whole and not streamed.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(folder).select(F.col("_metadata.file_path").alias("_file"), F.lit(None).cast("bigint").alias("_line"), F.regexp_replace("value", r"\r\z", "").alias("_raw"))
    return by_mode(canonical(parse_bed(lines, width, additional_fields)), mode)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes all that is there to Parquet, exactly once, and returns; called again, it takes in what is new."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
