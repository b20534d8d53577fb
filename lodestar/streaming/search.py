"""Search over a stream of requests. Ranking within a query is no windowed
aggregate, so each micro-batch is searched as a batch of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans.search import Catalog, search_batch

REQUESTS = "query_id string, text string, unreadable_mode string, ending_fragment string, result_limit int"


def search_stream(catalog: Catalog, requests: DataFrame, path: str) -> DataStreamWriter:
    """A writer, not yet started, that appends results and summaries under
    ``path``, partitioned by batch. A batch that is replayed after a failure
    overwrites its own partition, so nothing is written twice."""

    def answer(batch: DataFrame, number: int) -> None:
        found = search_batch(catalog, batch)
        found.results.write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        found.summary.write.mode("overwrite").parquet(f"{path}/summary/batch={number}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", f"{path}/checkpoint")
