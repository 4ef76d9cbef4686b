"""What a conversation remembers: the last turns before each turn, over a table or kept as the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def remembered(turns: DataFrame, n: int, *, conversation: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """turns with memory: the texts of up to n turns before each, oldest first; null texts are empty. Turns of one place are in order of their texts."""
    before = Window.partitionBy(conversation).orderBy(order, text).rowsBetween(-n, -1)
    return turns.withColumn("memory", F.collect_list(F.coalesce(text, F.lit(""))).over(before))


def remember(stream: DataFrame, n: int, *, conversation: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(conversation, order, memory) of each turn of a stream: the last n turns of a conversation are its state, whatever batch they came in.

    A turn is remembered in the order of arrival, and within a batch in its own. What a task holds
    of a conversation is its new turns of one batch, and n texts.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (conversation, order)}

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        new = pd.concat([p[[order, text]] for p in parts]).sort_values([order, text], kind="stable", na_position="first")
        memories = []
        for value in new[text]:
            memories.append(list(held))
            held = [*held, "" if value is None else value][-n:]
        state.update((held,))
        yield pd.DataFrame({conversation: key[0], order: new[order].to_numpy(), "memory": memories})

    out = f"`{conversation}` {kinds[conversation]}, `{order}` {kinds[order]}, memory array<string>"
    return stream.groupBy(conversation).applyInPandasWithState(run, out, "texts array<string>", "append", GroupStateTimeout.NoTimeout)
