"""Detection and replacement of sensitive data in whole texts.

All operators are projections, so they need no shuffle; only the counts aggregate, in one pass.
"""

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.patterns import (
    CARDS,
    DEFAULT_PATTERNS,
    FIRST_KIND_PRECEDENCE,
    LABEL_PRECEDENCE,
    NO_MATCH,
    REDACTED_CATEGORIES,
    WHOLE_MESSAGE_PRECEDENCE,
    Pattern,
    by_name,
    first_test,
    found,
    matches,
    passes_screen,
    replaced,
    screen_outlives,
)
from chatlens.schema import CHAT_COLUMNS


def _screened(
    df: DataFrame, text: str, patterns: Sequence[Pattern]
) -> tuple[DataFrame, dict[str, str]]:
    """Add the screens as columns, each once, and tell which column screens which pattern."""
    columns: dict[tuple, str] = {}
    of_pattern = {}
    screens = {}
    for p in patterns:
        key = (p.needs, p.forms)
        if key not in columns:
            columns[key] = f"__screen_{len(columns)}"
            screens[columns[key]] = passes_screen(F.col(text), p)
        of_pattern[p.name] = columns[key]
    return df.withColumns(screens), of_pattern


def _flags(
    df: DataFrame, text: str, patterns: Sequence[Pattern]
) -> tuple[DataFrame, dict[str, Column]]:
    """Frame with screens, and per pattern whether the text holds a match."""
    df, screen = _screened(df, text, patterns)
    return df, {p.name: F.col(screen[p.name]) & matches(F.col(text), p) for p in patterns}


def pii_flags(
    df: DataFrame, text: str = "MSGTEXT", patterns: Sequence[Pattern] = DEFAULT_PATTERNS
) -> DataFrame:
    """One boolean column per pattern; null text gives null flags."""
    screened, flags = _flags(df, text, patterns)
    return screened.select(*df.columns, *[flag.alias(name) for name, flag in flags.items()])


def pii_filter(
    df: DataFrame,
    category: str,
    text: str = "MSGTEXT",
    patterns: Sequence[Pattern] = DEFAULT_PATTERNS,
) -> DataFrame:
    """Rows in which the named pattern occurs."""
    return df.filter(found(F.col(text), by_name(patterns)[category]))


def _any_of(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n) for n in names])


def pii_counts(
    df: DataFrame,
    text: str = "MSGTEXT",
    patterns: Sequence[Pattern] = DEFAULT_PATTERNS,
    exclude: Sequence[str] = ("LINK",),
) -> DataFrame:
    """One row: texts with any kind outside ``exclude``, with any card, and with each other kind."""
    names = [p.name for p in patterns]
    cards = [n for n in names if n in CARDS]
    kinds = {"any_sensitive": [n for n in names if n not in exclude]}
    if cards:
        kinds["credit_card"] = cards
    kinds.update({n.lower(): [n] for n in names if n not in CARDS})
    screened, flags = _flags(df.select(text), text, patterns)
    flagged = screened.select(*[flag.alias(name) for name, flag in flags.items()])
    return flagged.agg(*[F.count_if(_any_of(ns)).alias(kind) for kind, ns in kinds.items()])


def _with_first_kind(
    df: DataFrame,
    text: str,
    patterns: Sequence[Pattern],
    precedence: Sequence[str],
    result: Callable[[Pattern], Column],
    default: Column,
    column: str,
) -> DataFrame:
    """Add ``result(pattern)`` of the first pattern in order of precedence that occurs."""
    named = by_name(tuple(patterns))
    screened, flags = _flags(df, text, patterns)
    chain = F.when(F.col(text).isNull(), default)
    for name in precedence:
        if name in named:
            chain = chain.when(flags[name], result(named[name]))
    kept = [c for c in df.columns if c != column]
    return screened.select(*kept, chain.otherwise(default).alias(column))


def pii_label(
    df: DataFrame,
    text: str = "MSGTEXT",
    patterns: Sequence[Pattern] = DEFAULT_PATTERNS,
    precedence: Sequence[str] = LABEL_PRECEDENCE,
    column: str = "Pattern",
) -> DataFrame:
    """Label of the first kind that occurs, ``NO_MATCH`` for none and for null text."""
    return _with_first_kind(
        df, text, patterns, precedence, lambda p: F.lit(p.label), F.lit(NO_MATCH), column
    )


def pii_redact(
    df: DataFrame,
    text: str = "MSGTEXT",
    patterns: Sequence[Pattern] = DEFAULT_PATTERNS,
    column: str = "AN_MSGTEXT",
) -> DataFrame:
    """Replace every match of every pattern, one pattern after the other.

    Later patterns see the labels of earlier ones. Patterns in a row that are screened alike form a
    block, skipped where none of their screens passes. A text is named twice per block, so blocks, not
    patterns, bound the size of the expression if a filter on the result is pushed down.
    """
    kept = [c for c in df.columns if c != column]
    step, screen = _screened(df, text, patterns)
    step = step.withColumn(column, F.col(text))
    blocks = [list(b) for _, b in groupby(enumerate(patterns), key=lambda ip: first_test(ip[1]))]
    for block in blocks:
        new = F.col(column)
        for _, p in block:
            new = replaced(new, p)
        if all(screen_outlives(p, patterns[:i]) for i, p in block):
            screens = dict.fromkeys(screen[p.name] for _, p in block)
            new = F.when(_any_of(list(screens)), new).otherwise(F.col(column))
        step = step.withColumn(column, new)
    return step.select(*kept, column)


def pii_redact_first_category(
    df: DataFrame,
    text: str = "MSGTEXT",
    patterns: Sequence[Pattern] = DEFAULT_PATTERNS,
    precedence: Sequence[str] = FIRST_KIND_PRECEDENCE,
    column: str = "AN_MSGTEXT",
) -> DataFrame:
    """Replace the matches of the first kind that occurs, and of no other."""
    source = F.col(text)
    return _with_first_kind(
        df,
        text,
        patterns,
        precedence,
        lambda p: replaced(source, p),
        source,
        column,
    )


def pii_replace_message(
    df: DataFrame,
    text: str = "MSGTEXT",
    patterns: Sequence[Pattern] = DEFAULT_PATTERNS,
    precedence: Sequence[str] = WHOLE_MESSAGE_PRECEDENCE,
    columns: Sequence[str] | None = tuple(c for c in CHAT_COLUMNS if c != "MSGTEXT"),
    column: str = "AN_MSGTEXT",
) -> DataFrame:
    """Put the label in place of the whole message; ``columns`` are kept beside it (None for all)."""
    kept = [c for c in df.columns if c not in (text, column)] if columns is None else list(columns)
    return _with_first_kind(
        df, text, patterns, precedence, lambda p: F.lit(p.label), F.col(text), column
    ).select(*kept, column)


def pii_label_from_redacted(
    df: DataFrame,
    text: str = "AN_MSGTEXT",
    categories: Sequence[tuple[str, str]] = REDACTED_CATEGORIES,
    column: str = "Pattern",
) -> DataFrame:
    """Kind recovered from the first label that a redacted text contains."""
    chain = F.when(F.col(text).isNull(), NO_MATCH)
    for label, category in categories:
        chain = chain.when(F.contains(F.col(text), F.lit(label)), category)
    return df.withColumn(column, chain.otherwise(NO_MATCH))


def pii_label_counts(df: DataFrame, column: str = "Pattern") -> DataFrame:
    """Rows per label."""
    return df.groupBy(column).agg(F.count("*").alias("count"))


def pii_pairs(
    df: DataFrame, text: str = "MSGTEXT", redacted: str = "AN_MSGTEXT", column: str = "Pattern"
) -> DataFrame:
    """Redacted text, original and label of the rows in which something was found."""
    return df.filter(F.col(column) != NO_MATCH).select(redacted, text, column)
