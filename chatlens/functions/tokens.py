"""Token counts.

The default counts runs of non-blank characters inside the JVM. A sub-word vocabulary can be plugged
in with :func:`encoder_tokens`, which loads it once per Python worker and counts Arrow batches.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]


def blank_separated_tokens(text: Column) -> Column:
    """Number of blank-separated tokens; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def encoder_tokens(load_encoder: Callable[[], Callable[[str], list]]) -> Tokenizer:
    """Tokenizer from a function that loads ``text -> tokens``; the function is shipped to the workers."""
    loaded: list = []

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not loaded:
            loaded.append(load_encoder())
        encode = loaded[0]
        for texts in batches:
            yield texts.map(lambda t: 0 if t is None else len(encode(t))).astype("int32")

    udf = F.pandas_udf(count, "int")
    return lambda text: udf(text)
