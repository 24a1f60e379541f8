"""Continuous ledger ingest from finished responses."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelens.functions.pricing import PriceBook
from usagelens.operators.extract import ledger_rows
from usagelens.runtime import materialize
from usagelens.sources.ledger import append_new
from usagelens.streaming.sinks import ONCE_THROUGH


def ingest(responses: DataFrame, book: PriceBook, tz: str, path: str, checkpoint: str,
           error_chars: int | None = None, **trigger) -> StreamingQuery:
    """Append finished responses to the ledger at ``path``, each request once, however late it comes.

    ``responses`` has request_id, ts_ms, start_ms, username, api_key, model, stream, client, status, path, error and
    body. A batch goes through the same assembly as a batch job, JSON bodies and event streams alike. Rows whose id the
    ledger already has are left out, on whatever day they come again, so a batch that is run again after a failure adds
    nothing twice; no row is dropped by its time. Of several deliveries in one batch the earliest counts. The source's
    options bound the size of a batch.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        rest = [name for name in batch.columns if name != "request_id"]
        once = F.min_by(F.struct(*rest), F.struct("ts_ms", "start_ms")).alias("row")
        rows = materialize(batch.groupBy("request_id").agg(once).select("request_id", "row.*"))
        append_new(ledger_rows(rows, book, tz, error_chars), path)

    return (
        responses.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE_THROUGH)).start()
    )
