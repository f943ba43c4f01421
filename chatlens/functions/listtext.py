"""Lists that arrive as text, such as ``['Joy', 'Hope']``."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_list_text(text: Column, keep_blanks: bool = False) -> Column:
    """Split list text into an array after removing quotes and brackets, and blanks unless kept."""
    noise = r"['\[\]]" if keep_blanks else r"[\s'\[\]]"
    return F.split(F.regexp_replace(text, noise, ""), ",")


def first_quoted_item(text: Column) -> Column:
    """First quoted item of list text, null where nothing is quoted."""
    return F.get(F.split(text, "'"), F.lit(1))


def null_if_in(value: Column, tokens: tuple[str, ...]) -> Column:
    """Null where the value is one of the texts that stand for a missing one."""
    return F.when(~value.isin(*tokens), value)
