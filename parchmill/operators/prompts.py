"""Instruction/response lines: clean, reject, format, count. Narrow, JVM-only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from parchmill.functions.text import count_char, strip

TAB = "\t"


class NoValidRows(ValueError):
    """No line of the input is a valid instruction/response pair."""


@dataclass(frozen=True)
class PromptTemplate:
    # The exact markers of the prompt format. No end-of-turn
    # marker follows the user's text.
    head: str = "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
    middle: str = "\n<|start_header_id|>assistant<|end_header_id|>\n"
    end: str = "<|eot_id|>"


DEFAULT_TEMPLATE = PromptTemplate()


def _stripped(lines: DataFrame) -> DataFrame:
    return lines.select(strip(F.col("line")).alias("line")).where(F.col("line") != "")


def prompt_pairs(lines: DataFrame) -> DataFrame:
    """(instruction, response) of the lines with exactly two tab-separated fields.

    The line is stripped before it is split, so a line that ends in a tab has
    one field and is not a pair.
    """
    line = F.col("line")
    return (
        _stripped(lines)
        .where(count_char(line, TAB) == 1)
        .select(
            strip(F.substring_index(line, TAB, 1)).alias("instruction"),
            strip(F.substring_index(line, TAB, -1)).alias("response"),
        )
    )


def prompt_rejects(lines: DataFrame) -> DataFrame:
    """(line, n_fields) of the lines that are neither blank nor pairs."""
    n_fields = count_char(F.col("line"), TAB) + 1
    return _stripped(lines).select("line", n_fields.alias("n_fields")).where("n_fields <> 2")


def format_prompt(
    instruction: Column,
    response: Column | None = None,
    template: PromptTemplate = DEFAULT_TEMPLATE,
) -> Column:
    """A training prompt, or one left open for the answer where there is no response."""
    opened = F.concat(F.lit(template.head), instruction, F.lit(template.middle))
    if response is None:
        return opened
    given = F.coalesce(response, F.lit("")) != ""
    return F.when(given, F.concat(opened, response, F.lit(template.end))).otherwise(opened)


def training_prompts(lines: DataFrame, template: PromptTemplate = DEFAULT_TEMPLATE) -> DataFrame:
    """(instruction, response, prompt) of a line table."""
    prompt = format_prompt(F.col("instruction"), F.col("response"), template)
    return prompt_pairs(lines).withColumn("prompt", prompt)


def prompt_counts(lines: DataFrame) -> DataFrame:
    """One row (n_lines, n_blank, n_rejected, n_records), counted in one pass."""
    line = strip(F.col("line"))
    blank = line == ""
    pair = count_char(line, TAB) == 1
    return lines.agg(
        F.count("*").alias("n_lines"),
        F.count_if(blank).alias("n_blank"),
        F.count_if(~blank & ~pair).alias("n_rejected"),
        F.count_if(~blank & pair).alias("n_records"),
    )


def observe_records(pairs: DataFrame, observation: Observation) -> DataFrame:
    """Count records while another action runs, at no further pass."""
    return pairs.observe(observation, F.count("*").alias("n_records"))


def require_rows(df: DataFrame) -> DataFrame:
    """Raise if there is no row at all; reads no more than one."""
    if df.isEmpty():
        raise NoValidRows("no valid instruction/response pair in the input")
    return df
