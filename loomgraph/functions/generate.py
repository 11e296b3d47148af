"""Texts made from prompts: by a model that runs in the workers, or by taking from the prompt what it holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A model: prompts in, texts out.
Model = Callable[[Sequence[str]], Sequence[str]]


def prompt(question: Column, context: Column, system: str = "") -> Column:
    """System text, context and question in one prompt; empty parts are left out."""
    part = lambda head, body: F.when(F.trim(body) != "", F.concat(F.lit(head), F.trim(body)))
    return F.concat_ws("\n", part("", F.lit(system)), part("Context: ", context), part("Question: ", question))


def generated(asked: Column, load: Callable[[], Model], most_words: int = 512) -> Column:
    """What a model makes of each prompt, trimmed and of at most `most_words` words; null for a null prompt.  `load` runs
    once in each worker; prompts come in Arrow batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            known = prompts[prompts.notna()]
            said = pd.Series([" ".join(str(x).split()[:most_words]) for x in model(known.tolist())], index=known.index, dtype=object)
            yield said.reindex(prompts.index).where(prompts.notna(), None)

    return run(asked)


def extracted(question: Column, context: Column, most: int = 3, separator: str = " | ") -> Column:
    """An answer without a model: the first `most` entries of the context; of an empty one nothing."""
    return F.array_join(F.slice(F.split(F.coalesce(context, F.lit("")), r" \| "), 1, most), separator)
