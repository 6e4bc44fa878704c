"""Scoring of a stream of texts with a fitted model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from civitext.operators.naive_bayes import NaiveBayes
from civitext.operators.predict import predict
from civitext.session import cut


def score_stream(
    stream: DataFrame,
    model: NaiveBayes,
    output: str,
    checkpoint: str,
    key: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    trigger: dict | None = None,
    parts: int | None = None,
    **limits: int,
) -> StreamingQuery:
    """Score each micro-batch with the batch operator and write it as parquet.

    Summing token weights per text would be stateful on an unbounded stream. A
    micro-batch holds whole texts, so inside ``foreachBatch`` the sum is an
    ordinary aggregation and no state or watermark is kept. Each batch writes
    into its own folder, ``batch=<id>``, so a batch that is run again after a
    failure replaces its first attempt instead of adding to it. Texts stay in the
    parts of their files; ``parts`` cuts batches of few small files into more.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = predict(cut(batch, key, parts), model, key, text_col, carry, **limits)
        scored.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
