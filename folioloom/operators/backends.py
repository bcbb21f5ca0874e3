"""External models behind one protocol: rows in, one raw answer a row out, errors as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Backend = Callable[[str], str]


def stub(prompt: str) -> str:
    """A deterministic stand-in: an answer without any field."""
    return "{}"


def ask(rows: DataFrame, backend: Backend = stub, attempts: int = 3, key: str = "file_id", prompt: str = "prompt") -> DataFrame:
    """(file_id, raw_json, retry_count, error_message): ``backend`` on each prompt, up to ``attempts`` times.

    A row's failure is its error_message, never the task's. Repartition ``rows`` to the parallelism the backend bears.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, text in zip(part[key], part[prompt], strict=True):
                answer, error, n = None, None, 0
                for n in range(attempts):
                    try:
                        answer, error = backend(text), None
                        break
                    except Exception as e:  # noqa: BLE001  a backend may fail in any way
                        error = str(e)
                out.append((k, answer, n, error))
            yield pd.DataFrame(out, columns=[key, "raw_json", "retry_count", "error_message"])

    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, raw_json string, retry_count int, error_message string")
