"""Cleaning as a stream: each micro-batch is validated, and rows whose key is new go to the sink.

The sink is the state: a batch that is run again after a failure finds its rows there and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusmill.functions.rules import OK, first_failure
from corpusmill.operators.validate import sample_rules
from corpusmill.sources.jsonl import append_new


def clean_stream(samples: DataFrame, sink: str, rejects: str, checkpoint: str, key: str = "id", rules: Callable = sample_rules, **options) -> StreamingQuery:
    """``samples`` (a stream with messages, category and ``key``): good rows to ``sink``, others with their
    reason to ``rejects``, both JSON lines."""

    def batch(df: DataFrame, _: int) -> None:
        judged = df.withColumn("reason", first_failure(rules(F.col("messages"), F.col("category"), **options))).persist()
        append_new(judged.where(F.col("reason") == OK).drop("reason"), sink, key)
        append_new(judged.where(F.col("reason") != OK), rejects, key)
        judged.unpersist()

    return samples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
