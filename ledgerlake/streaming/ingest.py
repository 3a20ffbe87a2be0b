"""Incremental statement ingest with Structured Streaming.

New statement files in a folder -> stage (I4) -> strict check and append
(G11), in micro-batches. The stream source only lists new files (one row per
file, from `_metadata.file_path`); `foreachBatch` hands their paths to the same
batch code path used for one-off imports, so stream and batch share one
implementation.

The ledger is a versioned table (`plans.ledger`). A micro-batch is committed once under (source, batch id):
the source is the streaming query's own id, which lives in its checkpoint, so a replay after a failure is
recognised, while a stream with a new checkpoint, another stream or a manual import can use the same
batch numbers without touching each other's rows. The duplicate check reads only the
batch's months. Deduplication is against the stored ledger, so no watermark state is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.functions import columns as C
from ledgerlake.operators import dedup as D
from ledgerlake.operators.categorize import auto_categorize
from ledgerlake.plans import jobs as J
from ledgerlake.plans.ledger import Ledger
from ledgerlake.session import shared_dir
from ledgerlake.sources.statements import PayerRules, read_statement_files

MANUAL = "manual"
#: where Spark names the running streaming query to its batches
QUERY_ID = "sql.streaming.queryId"


def ingest_files(spark: SparkSession, paths: Sequence[str], ledger_path: str, batch_id: int,
                 keys_value: dict | None = None, file_keys: DataFrame | None = None, categorize: bool = False,
                 source: str = MANUAL, payer_rules: PayerRules = ()) -> None:
    """Batch path: stage the files and import the survivors under (source, batch_id); a pair that is
    committed already is left as it is."""
    keys = [*(keys_value or {}), *[c for c in (file_keys.columns if file_keys is not None else []) if c != "path"]]
    stored = Ledger(spark, ledger_path, keys)
    if stored.rows.manifest().has(source, batch_id):
        return
    stm = read_statement_files(spark, list(paths), keys_value, file_keys, payer_rules).drop("path")
    whole = stored.expenses()
    ledger = D.ledger_date_bounds(stm, whole)
    staged = J.stage_statements(stm, ledger, "seq", keys)
    if categorize:
        staged = auto_categorize(staged, whole.drop("month"), keys)
    new = D.dedup_strict(staged, ledger, keys).select(
        *keys, "date", "description", "category", "subcategory", "amount", "payer",
        F.lit(C.TYPE_MONTHLY).alias("expense_type"))
    stored.append(new, source, batch_id)


def start_statement_stream(spark: SparkSession, source_dir: str, ledger_path: str,
                           checkpoint: str | None = None, keys_value: dict | None = None,
                           available_now: bool = True, max_files_per_trigger: int = 1000, payer_rules: PayerRules = ()) -> StreamingQuery:
    """Start the ingest stream. Its state goes to `checkpoint`, or under the shared folder of the
    session; without either it doesn't start, as state on one machine would be lost with it. A backlog
    arrives `max_files_per_trigger` files at a time, which bounds the paths a batch names."""
    if not checkpoint and not shared_dir(spark):
        raise ValueError("name a checkpoint folder or set spark.checkpoint.dir")
    ckpt = checkpoint or f"{shared_dir(spark)}/statement-ingest"
    files = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(source_dir, wholetext=True).select(F.col("_metadata.file_path").alias("path"))

    def process(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().collect()]  # one row per new file
        if paths:
            session = batch.sparkSession
            stream = session.sparkContext.getLocalProperty(QUERY_ID)
            ingest_files(session, paths, ledger_path, batch_id, keys_value, source=f"stream {stream}", payer_rules=payer_rules)

    w = files.writeStream.foreachBatch(process).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
