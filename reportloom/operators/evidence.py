"""Classifying reports: batches to classify, the classifier, its results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Attempts at a report, and what a model answers.
MAX_ATTEMPTS = 3
ANSWER = "follow_up boolean, confidence string, finding string, snippet string"


def classify(
    df: DataFrame, key: str = "primary_report_identifier", text: str = "report_text"
) -> DataFrame:
    """The keyword rule: the first phrase of the list that occurs, and where it stands.

    Inside the JVM; a NULL text detects nothing.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(body)
    phrase = F.lit(None).cast("string")
    for p in reversed(T.FOLLOWUP_PHRASES):
        phrase = F.when(F.contains(low, F.lit(p)), p).otherwise(phrase)
    found = F.col("_phrase")
    shown = F.substr(body, F.position(found, low), F.length(found))
    return df.select(key, text, phrase.alias("_phrase")).select(
        key,
        found.isNotNull().alias("followup_detected"),
        F.lit("high").alias("followup_confidence"),
        F.coalesce(found, F.lit("")).alias("followup_finding"),
        F.coalesce(shown, F.lit("")).alias("followup_snippet"),
        F.lit(None).cast("string").alias("error"),
    )


def read_answers(answers: DataFrame, key: str, answer: str = "answer", error: str = "error") -> DataFrame:
    """Classifier results from a model's raw JSON answers.

    A confidence other than high is low.  An answer that is no JSON object becomes an
    error row, as does a model's own error.
    """
    parsed = answers.withColumn("_a", F.from_json(answer, ANSWER, {"mode": "PERMISSIVE"}))
    readable = F.get_json_object(answer, "$").startswith("{")
    failed = F.coalesce(
        F.col(error), F.when(~F.coalesce(readable, F.lit(False)), F.concat(F.lit("unreadable answer: "), F.coalesce(answer, F.lit("none"))))
    )
    fine = F.col("_error").isNull()
    word = lambda name: F.when(fine, F.coalesce(F.col(f"_a.{name}"), F.lit("")))
    high = F.lower(F.coalesce(F.col("_a.confidence"), F.lit(""))) == "high"
    return parsed.withColumn("_error", failed).select(
        key,
        F.when(fine, F.coalesce(F.col("_a.follow_up"), F.lit(False))).alias("followup_detected"),
        F.when(fine, F.when(high, "high").otherwise("low")).alias("followup_confidence"),
        word("finding").alias("followup_finding"),
        word("snippet").alias("followup_snippet"),
        F.col("_error").alias("error"),
    )


def classify_with(
    df: DataFrame,
    model: Callable[[pd.Series], pd.Series],
    key: str = "primary_report_identifier",
    text: str = "report_text",
) -> DataFrame:
    """Run a model over the reports, a batch of texts at a time.

    ``model`` answers each text with a JSON object of ``ANSWER``.  An exception makes
    the batch's rows error rows, with its whole message, and does not fail the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                answer, error = list(model(batch[text])), None
            except Exception as failure:  # noqa: BLE001 - any failure belongs in the log
                answer, error = None, str(failure)
            yield pd.DataFrame({key: batch[key], "answer": answer, "error": error}, index=batch.index)

    kind = df.schema[key].dataType.simpleString()
    return read_answers(df.select(key, text).mapInPandas(run, f"{key} {kind}, answer string, error string"), key)


def next_batch(
    df: DataFrame,
    errors: DataFrame,
    n: int,
    priority: Column,
    key: str = "primary_report_identifier",
    order: str = "message_dt",
    processed: str = "followup_processed_at",
    max_attempts: int = MAX_ATTEMPTS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The next reports to classify.

    Unprocessed ones that have not failed too often; the newest priority reports
    while any are left, the newest of the rest after that.
    """
    given_up = (
        errors.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= max_attempts)
        .select(key)
    )
    open_rows = df.filter(F.col(processed).isNull()).join(given_up, key, "left_anti")
    chosen = open_rows.withColumn("_priority", F.coalesce(priority, F.lit(False)))
    # With a priority report left, the top of the order holds only such reports
    # up to the point they run out; what follows them waits for a later batch.
    top = chosen.orderBy(F.desc("_priority"), F.desc(order), key).limit(n)
    best = F.max("_priority").over(Window.partitionBy())
    return (
        top.withColumn("_best", best)
        .filter(F.col("_priority") == F.col("_best"))
        .select(*(columns or df.columns))
    )


def followups_by(df: DataFrame, text: str, by: str) -> DataFrame:
    """Reports per group whose text asks for a follow-up."""
    return (
        df.filter(T.keyword_followup(F.col(text)))
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"))
    )
