"""Hook for a speech model: chunks in, sample counts out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

# A model is made once per task for a voice and then called with one batch of
# texts; it returns one sample count per text.
Model = Callable[[Sequence[str], Sequence[float]], Sequence[int]]
ModelFactory = Callable[[str], Model]


def score_chunks(
    chunks: DataFrame,
    factory: ModelFactory,
    text: str = "text",
    voice: str = "voice",
    speed: str = "speed",
    out: str = "n_samples",
) -> DataFrame:
    """Run a model over every chunk in Arrow batches; blank texts are dropped.

    Rows are sorted by voice inside their partition, so a task loads a model
    for each voice once, and no voice is gathered in one task.  Rows without a
    voice go to the model of ``None``.
    """
    schema = T.StructType([*chunks.schema.fields, T.StructField(out, T.LongType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, model = None, None
        for batch in batches:
            counts = pd.Series(0, index=batch.index, dtype="int64")
            for name, rows in batch.groupby(voice, sort=False, dropna=False):
                name = None if pd.isna(name) else name
                if model is None or name != current:
                    current, model = name, factory(name)
                counts.loc[rows.index] = list(model(rows[text].tolist(), rows[speed].tolist()))
            yield batch.assign(**{out: counts})

    spoken = chunks.filter(strip(F.col(text)) != "").sortWithinPartitions(voice)
    return spoken.mapInPandas(score, schema)


def paced_model(voice: str) -> Model:
    """Stand-in model: 150 words a minute, 0.1 to 60 seconds, 24 kHz."""

    def samples(texts: Sequence[str], speeds: Sequence[float]) -> list[int]:
        out = []
        for text, speed in zip(texts, speeds):
            seconds = len(text.split()) / 150 * 60 / speed
            out.append(int(max(0.1, min(seconds, 60)) * 24_000))
        return out

    return samples
