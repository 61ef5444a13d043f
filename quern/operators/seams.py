"""Where a caller's own model plugs in: generators and tokenizers as plain Python functions on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def generate(df: DataFrame, make: Callable[[Sequence[str]], Sequence[str]], prompt: str = "prompt", out: str = "completion", batch: int = 64) -> DataFrame:
    """`df` with `out`: what `make` answers to each prompt. `make` gets at most `batch` prompts at a time and answers all of them, in order."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                answers = list(make(part[prompt].tolist()))
                if len(answers) != len(part):
                    raise ValueError(f"{len(answers)} answers to {len(part)} prompts")
                yield part.assign(**{out: answers})

    return df.mapInPandas(run, schema)


def token_ids(text: Column, tokenize: Callable[[str], Sequence[int]]) -> Column:
    """Ids of a text by a caller's tokenizer; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else list(tokenize(x)))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<bigint>")(text)
