"""Sinks: JSON Lines tables, single documents and the remote-answer hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.operators.dictionary import diff


def write_jsonl(df: DataFrame, path: str, order_by: list[str] | None = None,
                keep_nulls: bool = False, leave: list[str] | None = None) -> None:
    """Overwrite `path` with JSON Lines; with `order_by`, part files follow that order.
    Columns in `leave` are not written."""
    if order_by:
        df = df.orderBy(*order_by)
    df.drop(*(leave or [])).write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def write_document(one_row: DataFrame, path: str) -> None:
    """Write the single string column of a one-row frame as text."""
    one_row.write.mode("overwrite").text(path)


def answers_json(questions: DataFrame, keys: list[str]) -> DataFrame:
    """(value): each answered row as one JSON line."""
    return questions.select(F.to_json(F.struct(*keys)).alias("value"))


def complete(prompts: DataFrame, call: Callable[[str], str], keys: list[str]) -> DataFrame:
    """(keys..., response): hand each prompt to `call` in the tasks.

    `call` is supplied by the user (a model client, or a stub in tests); nothing here
    opens a connection.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(response=[call(p) for p in batch["prompt"]])

    fields = ", ".join(f"{k} {prompts.schema[k].dataType.simpleString()}" for k in keys)
    return prompts.select(*keys, "prompt").mapInPandas(run, f"{fields}, response string")


def dictionary_diff(before: DataFrame, after: DataFrame, name: str) -> str:
    """Two dictionaries as a diff for review, empty when nothing changed.

    Only changed lines and their neighbours reach the driver.
    """
    out: list[str] = []
    last = None
    for r in diff(before, after).orderBy("pos", "part").toLocalIterator():
        if last is None:
            out += [f"--- {name}", f"+++ {name}"]
        if last is None or r["pos"] > last + 1:
            out.append(f"@@ {r['pos'] + 1} @@")
        last = r["pos"]
        out.append(f"{r['mark']}    {r['key']!r}: {list(r['values'])!r},")
    return "\n".join(out)
