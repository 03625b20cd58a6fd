"""Structured Streaming over a landing folder: new filings go through the same operators as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import ingest, observability
from ledgerloom.plans.cut import written
from ledgerloom.warehouse import Warehouse

RAW = "accession string, cik string, form string, filing_date date, html string"


def raw_filings(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of raw filings from the JSON files that land in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def ingest_into(warehouse: Warehouse, stream: DataFrame, checkpoint: str):
    """Starts ingesting all that has landed; ends when it is done. A batch that is run again changes nothing more."""

    def put(batch: DataFrame, _: int) -> None:
        # each filing is parsed once, and what is written from it is read back from there
        parsed = written(ingest.parsed(batch.dropDuplicates(["accession"])), "landed")
        sections = ingest.sections_of(parsed)
        warehouse.ingest_filing_rows(parsed.select("accession", "cik", "form", "filing_date"), sections, ingest.chunks_of(sections, parsed), ingest.parse_reviews(parsed))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_costs(traces: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Costs by day and model over a stream of spans; spans later than `late` are left out."""
    return observability.daily(traces.withWatermark("started_at", late), every)


def daily_costs_to(traces: DataFrame, path: str, checkpoint: str):
    out = daily_costs(traces).withColumn("day", F.col("day").cast("timestamp"))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
