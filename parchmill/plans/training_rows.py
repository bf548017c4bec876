"""The training-data job: a line file to a table of token rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parchmill.operators.encode import encode_fixed_length, encode_with_vocabulary
from parchmill.operators.prompts import (
    DEFAULT_TEMPLATE,
    PromptTemplate,
    observe_records,
    require_rows,
    training_prompts,
)
from parchmill.sources.lines import scan_prompt_lines


def write_training_rows(
    spark: SparkSession,
    path: str | list[str],
    table_path: str,
    tokenise: Callable[[Column], Column] | None = None,
    pad_id: int = 0,
    length: int = 2048,
    template: PromptTemplate = DEFAULT_TEMPLATE,
    vocabulary: DataFrame | None = None,
    unk_id: int = 0,
    ship: bool = False,
) -> int:
    """Clean, format and encode; store (input_ids, attention_mask) as Parquet.

    Give a tokeniser, or a (token, id) table of any size; `ship` says that every task
    has room for that table, which then shuffles nothing.

    Returns the number of records, counted while they are written. Raises
    NoValidRows, before anything is written, if there is none.
    """
    if (tokenise is None) == (vocabulary is None):
        raise ValueError("give a tokeniser or a vocabulary")
    prompts = require_rows(training_prompts(scan_prompt_lines(spark, path), template))
    observation = Observation("training rows")
    rows = observe_records(prompts, observation).select(F.col("prompt"))
    if tokenise is not None:
        encoded = encode_fixed_length(rows, "prompt", tokenise, length, pad_id)
    else:
        encoded = encode_with_vocabulary(
            spark, rows, "prompt", vocabulary, unk_id, pad_id, length, ship
        )
    encoded.select("input_ids", "attention_mask").write.mode("overwrite").parquet(table_path)
    return observation.get["n_records"]
