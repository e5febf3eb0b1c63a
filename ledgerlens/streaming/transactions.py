"""The per-transaction operators over a Structured Streaming source.

The original has no streaming path (SURVEY §1.1); what streams naturally are
the operators that need only the row itself and bounded side tables:
calendar, value and gas-unit features (F1-F3, F6-F10, F13b), the zero-value
flag, and the known-scam label (W13) as a stream-static join against the scam
address table. Sender-history operators stay batch jobs over the landed table.
The sink is append-only Parquet with a checkpoint location, so a restarted
query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import rules as R


def stream_transactions(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Parquet files landing in ``path`` as a stream (fixed schema, no inference)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(path))


def score_stream(stream: DataFrame, scam: DataFrame) -> DataFrame:
    """Row-local features and the known-scam label for each arriving transaction."""
    d = FE.calendar_features(stream)
    d = FE.value_features(d)
    d = d.withColumn("gas_price_gwei", F.col("gas_price") / F.lit(1e9))
    d = d.withColumn("value_per_gas", F.col("value_eth") / (F.col("gas") + 1))
    return R.known_scam_labels(d, scam)


def start(scored: DataFrame, out_path: str, checkpoint: str, trigger_once: bool = True):
    """Append the scored stream to Parquet; ``checkpoint`` must be on shared storage."""
    w = (scored.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
