"""Search of a stream of queries against a stored table, and a stream of upserts into one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.flat import nearest, upsert


def search_stream(queries: DataFrame, base: DataFrame, sink: Callable[[DataFrame, int], None], k: int = 10, by: str = "ip", **options) -> StreamingQuery:
    """Each micro-batch of queries (qid, qv) is searched as one batch; sink gets its result and number.

    A batch that is run again after a failure has the same number, by which a sink can drop it.
    """
    writer = queries.writeStream.foreachBatch(lambda batch, number: sink(nearest(base, batch, k, by), number))
    return writer.options(**options).start()


def upsert_stream(rows: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], **options) -> StreamingQuery:
    """Each micro-batch of rows (vec_id, embedding) goes into the table that read gives; write stores the new one.

    write must not overwrite what read still reads; upserts may safely run twice.
    """
    writer = rows.writeStream.foreachBatch(lambda batch, number: write(upsert(read(), batch), number))
    return writer.options(**options).start()
