"""Scoring of order requests as they arrive, with the same features and model as the batch job."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from retailscope.operators import models, quality, risk
from retailscope.session import staged


def score_stream(
    requests: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    model: PipelineModel,
    stats: DataFrame,
    target: str,
    checkpoint: str,
    categories: DataFrame,
    **trigger,
) -> StreamingQuery:
    """Score each micro-batch of `requests` against the stored orders and append it to `target`.

    `categories` is the training vocabulary (feature, value): values outside it are refused, as in the
    batch job. Refused requests go to `<target>/refused` with their reasons. A batch that is replayed after a
    failure rewrites its own `batch_id` folder, so nothing is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = staged(risk.validated_requests(batch, categories), "requests")  # scored and refused rows read it
        features = risk.request_features(quality.accepted(checked), orders, customers)
        told = risk.explained(models.scored(model, features), stats)
        for name, rows in (("scored", told), ("refused", quality.rejected(checked))):
            rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}/batch_id={batch_id}")

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
