"""The codec over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from glyphmill.operators.codec import encode, reduced, statistics


def encode_stream(docs: DataFrame, dictionary: DataFrame, sink: str, checkpoint: str, key: str = "doc_id", available_now: bool = True) -> StreamingQuery:
    """Encodes each micro-batch of whole documents and appends key, encoded and statistics to Parquet at sink.

    Windows over one document's tokens aren't allowed in a streaming plan, so each batch is an ordinary job. A batch that
    runs again writes to its own folder again, so every document is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            out = encode(batch, dictionary, key).join(reduced(statistics(batch, dictionary, key)), key)
            out.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        finally:
            batch.unpersist()

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
