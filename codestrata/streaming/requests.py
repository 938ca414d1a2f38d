"""A stream of requests, one JSON object a line; one answer each.

Blank lines are skipped. A line that is no JSON object, is too long, names no known verb or lacks what its verb
needs is answered with an error; nothing stops the stream. Requests keep no state, so the query needs none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 100 << 20
FIELDS = "id string, command string, path string, name string, names array<string>, dir string, diff string, source_files array<string>, paths array<string>"
# Verbs and the field each one cannot do without.
VERBS = {
    "ast": "path",
    "symbols": "path",
    "calls": "path",
    "refs": "name",
    "context": "diff",
    "imports": "path",
    "lint": "path",
    "sequence": "path",
    "cochange": "source_files",
    "session": "id",
}


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, request, error) of text lines; error is null for a request that can be served."""
    raw = F.col(column)
    rows = lines.where(F.trim(raw) != "").withColumn("request", F.from_json(F.when(F.length(raw) <= MOST_CHARS, raw), FIELDS))
    verb = F.col("request.command")
    needs = F.lit(False)
    for name, field in VERBS.items():
        needs = needs | ((verb == name) & F.col(f"request.{field}").isNull())
    error = (
        F.when(F.length(raw) > MOST_CHARS, "too_long")
        .when(F.try_parse_json(raw).isNull() | ~F.ltrim(raw).startswith("{"), "invalid_json")
        .when(verb.isNull() | ~verb.isin(*VERBS), "unknown_command")
        .when(needs, "missing_field")
    )
    return rows.select(raw.alias("line"), "request", error.alias("error"))


def serve(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch's requests to the handler of their verb, and all answers
    (id, command, answer, error) to the sink. A handler gets (id, request) rows and returns (id, answer)."""

    def batch(lines: DataFrame, number: int) -> None:
        rows = parse(lines)
        none = F.lit(None).cast("string")
        answers = rows.where("error is not null").select("request.id", "request.command", none.alias("answer"), "error")
        for verb, handler in handlers.items():
            got = handler(rows.where(F.col("error").isNull() & (F.col("request.command") == verb)).select("request.id", "request"))
            answers = answers.unionByName(got.select("id", F.lit(verb).alias("command"), F.col("answer").cast("string").alias("answer"), none.alias("error")))
        sink(answers, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
