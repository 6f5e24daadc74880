"""Message table to train and validation chat datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from threadloom.functions import fixed
from threadloom.operators.pairs import chat_examples, exact_split, hash_split, training_pairs
from threadloom.sinks.tables import write_chat_datasets
from threadloom.sources.tables import read_chat


def prepare_datasets(messages: DataFrame, author_ids: Sequence[str], year: int, out: str,
                     ratio: float = fixed.TRAIN_RATIO, seed: int = 0,
                     exact: bool = False) -> DataFrame:
    """Writes ``out/split=train`` and ``out/split=val`` and returns both as one table.

    ``exact`` cuts at exactly ``int(n * ratio)``.
    """
    examples = chat_examples(training_pairs(messages, author_ids, year))
    if exact:
        split = exact_split(examples, ratio, seed)
    else:
        split = hash_split(examples, ratio, seed)
    write_chat_datasets(split, out)
    return read_chat(messages.sparkSession, out)
