"""Dialogue context carried across messages, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "conv_id long, turn long, person string, place string, prev_person string, prev_place string"
STATE = "person string, place string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    person, place = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches)).sort_values("turn")
    before = []
    for new_person, new_place in zip(rows["person"], rows["place"]):
        before.append((person, place))
        person = new_person if isinstance(new_person, str) else person
        place = new_place if isinstance(new_place, str) else place
    state.update((person, place))
    rows["prev_person"], rows["prev_place"] = zip(*before)
    yield rows[["conv_id", "turn", "person", "place", "prev_person", "prev_place"]]


def carry_context_stream(messages: DataFrame) -> DataFrame:
    """Per message, the last person and place mentioned before it in the session.

    ``messages`` is a stream of (conv_id, turn, person, place). One trigger hands over
    at most the rows it admitted (``maxFilesPerTrigger``), which bounds what one
    session can bring to a task; turns of later triggers must be later turns.
    """
    keyed = messages.select("conv_id", "turn", "person", "place").groupBy("conv_id")
    return keyed.applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def resolve_reference(text: str, own: str, previous: str, pronoun_pattern: str):
    """Own mention, else the carried one if the text points back with a pronoun."""
    return F.coalesce(own, F.when(F.col(text).rlike(pronoun_pattern), F.col(previous)))
