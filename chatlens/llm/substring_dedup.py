"""Substring duplicates: words covered by a run of ``length`` words that also starts in a document with a smaller id.

Seed and extend. Seeds are winnowed anchors: of every ``length`` consecutive words at least one run of ``GRAM`` words is
chosen by its content alone, so a shared run has a shared anchor. Documents are joined on anchors that several ids hold; around
a shared anchor matches are extended to both sides, as far as a run of ``length`` words can reach, and a run is a match if its
128-bit hash stands in a document with a smaller id. Matches that overlap merge to maximal repeats, whose words go.

Whole copies are settled first by one hash per text: only the copy with the smallest id is searched further. An anchor or run
in a third of all documents is reduced by partial aggregates (smallest and largest id) and joined back between written
tables, where the adaptive skew join splits it; nothing is grouped into pairs.

Defined cases: a null text has no words; a row without an id neither gives nor takes matches and keeps all its words; rows that
repeat an id are no smaller than each other; texts shorter than ``length`` words keep all; an empty table gives an empty
result; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.blocks import Words, blocks, grams, mix, signed
from chatlens.llm.shared import stage, texts_of

LENGTH = 50
#: Words of an anchor.
GRAM = 10

_MOST = np.uint64(2**64 - 1)
_NONE = np.uint64(0)


def _sliding(x: np.ndarray, width: int, op: np.ufunc, neutral: np.uint64) -> np.ndarray:
    """``op`` over each run of ``width`` values: running values of fixed blocks, from either end."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, neutral, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = op.accumulate(rows, axis=1).ravel()
    behind = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(words: Words, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the anchors: the least gram hash of every run of ``length`` words of one text.

    Of equal neighbours in one stretch only both ends and every ``length - gram + 1``-th are kept: each run still has one.
    """
    g = grams(words.hash, gram)
    width = length - gram + 1
    least = _sliding(g, width, np.minimum, _MOST)
    if not len(least):
        return np.zeros(0, np.int64), g[:0]
    whole = words.text[: len(least)] == words.text[length - 1 :]
    least = np.where(whole, least, _NONE)
    edge = np.zeros(width - 1, np.uint64)
    # A gram is chosen if it is the least of some run around it, that is, equal to the largest of their minima.
    chosen = g == _sliding(np.concatenate((edge, least, edge)), width, np.maximum, _NONE)
    again = np.zeros(len(g), bool)
    again[1:] = chosen[1:] & chosen[:-1] & (g[1:] == g[:-1])
    number = np.arange(len(g))
    since = number - np.maximum.accumulate(np.where(again, 0, number))
    inner = again.copy()
    inner[:-1] &= again[1:]
    inner[-1:] = False
    at = np.flatnonzero(chosen & ~(inner & (since % width != 0)))
    return at, g[at]


def _by_text(values: np.ndarray, text: np.ndarray, count: int, kind: pa.DataType) -> pa.Array:
    bounds = np.searchsorted(text, np.arange(count + 1))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _tied(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that differ from text to text."""
    return mix(hashes + mix(text.astype(np.uint64) + np.uint64(1)))


def _survey(length: int):
    """Per text: words, hash of the whole sequence, digest of the words as they are, anchor hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = Words(block)
                at, hashes = anchors(words, length)
                # One of each hash per text.
                key = np.lexsort((hashes, words.text[at]))
                text, hashes = words.text[at][key], hashes[key]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
                joined = [b" ".join(block.text(i).split()) for i in range(block.count)]
                digests = [hashlib.sha256(j) for j in joined]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[
                            batch.column(c).slice(block.first, block.count)
                            for c in ("doc_id", "text_key")
                        ],
                        pa.array(words.per_text),
                        pa.array([d.digest() for d in digests], pa.binary()),
                        _by_text(signed(hashes[new]), text[new], block.count, pa.int64()),
                    ],
                    names=["doc_id", "text_key", "n_words", "sequence", "anchors"],
                )

    return run


def _extended(length: int):
    """Runs of ``length`` words that hold a shared anchor: 128-bit hash, id, row, first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column("shared")
            doc, row = (batch.column(c).to_numpy() for c in ("doc_id", "row"))
            for block in blocks(batch.column("text")):
                words = Words(block)
                at, hashes = anchors(words, length)
                mine = shared.slice(block.first, block.count)
                owner = np.repeat(np.arange(block.count), mine.value_lengths().to_numpy())
                wanted = mine.flatten().to_numpy()
                # An anchor is shared if its text lists its hash.
                have = _tied(hashes, words.text[at])
                at = at[np.isin(have, _tied(wanted.view(np.uint64), owner))]
                text = words.text[at]
                low = np.maximum(at - (length - GRAM), words.first[text])
                high = np.minimum(at, words.first[text + 1] - length)
                edges = np.zeros(len(words.start) + 2, np.int64)
                np.add.at(edges, low, 1)
                np.add.at(edges, high + 1, -1)
                start = np.flatnonzero(np.cumsum(edges)[: len(words.start)] > 0)
                text = words.text[start]
                of = block.first + text
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(grams(words.hash, length, 1)[start])),
                        pa.array(signed(grams(words.hash, length, 2)[start])),
                        pa.array(doc[of]),
                        pa.array(row[of]),
                        pa.array((start - words.first[text]).astype(np.int32)),
                    ],
                    names=["h1", "h2", "doc_id", "row", "start"],
                )

    return run


def _removed(length: int):
    """Words left of texts with their matches: number removed, digest, the maximal repeats as (start, stop) word numbers."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            matches = batch.column("starts")
            for block in blocks(batch.column("text")):
                for i in range(block.count):
                    words = block.text(i).split()
                    start = matches[block.first + i].values
                    start = np.sort(start.to_numpy()) if start is not None else np.zeros(0, int)
                    edges = np.zeros(len(words) + 1, np.int64)
                    edges[start] += 1
                    np.add.at(edges, start + length, -1)
                    gone = np.cumsum(edges)[: len(words)] > 0
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    flips = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                    repeats = [
                        {"start": int(a), "stop": int(b)}
                        for a, b in zip(flips[::2], flips[1::2], strict=True)
                    ]
                    rows.append(
                        (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), repeats)
                    )
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.string(), span]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"],
            )

    return run


RESULT = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, "
    "repeats array<struct<start: long, stop: long>>"
)


def find_repeats(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """A row per row of ``docs``: words, words removed, digest of the words kept (joined by one space), maximal ``repeats``."""
    if length < GRAM:
        raise ValueError(f"length is at least {GRAM}")
    texts = texts_of(docs, id_column, text_column).withColumn("text_key", F.xxhash64("text"))
    key = ["doc_id", "text_key"]
    survey = stage(
        texts.mapInArrow(
            _survey(length),
            "doc_id long, text_key long, n_words long, sequence binary, anchors array<long>",
        ),
        "repeats-survey",
    )
    searched = survey.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= length))
    first = stage(
        searched.groupBy("sequence")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("sequence", "first"),
        "repeats-copies",
    )
    marked = stage(
        survey.join(first, "sequence", "left").withColumn(
            "copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
        ),
        "repeats-marked",
    )
    held = marked.where("not copy and doc_id is not null").select(
        *key, F.explode("anchors").alias("anchor")
    )
    common = stage(
        held.groupBy("anchor")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high")
        .select("anchor"),
        "repeats-anchors",
    )
    seeds = stage(
        held.join(common, "anchor").groupBy(*key).agg(F.collect_set("anchor").alias("shared")),
        "repeats-seeds",
    )
    seeded = stage(
        texts.join(seeds.hint("shuffle_hash"), key).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "repeats-seeded",
    )
    runs = seeded.select("doc_id", "row", "text", "shared").mapInArrow(
        _extended(length), "h1 long, h2 long, doc_id long, row long, start int"
    )
    smallest = stage(
        runs.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high")
        .select("h1", "h2", "low"),
        "repeats-runs",
    )
    matches = (
        runs.join(smallest, ["h1", "h2"])
        .where("doc_id > low")
        .groupBy("row")
        .agg(F.collect_list("start").alias("starts"))
    )
    none = F.array().cast("array<int>")
    cut = (
        seeded.select("row", "doc_id", "text")
        .join(matches.hint("shuffle_hash"), "row", "left")
        .select("doc_id", "text", F.coalesce("starts", none).alias("starts"))
        .mapInArrow(_removed(length), RESULT)
    )
    nowhere = F.array().cast("array<struct<start: long, stop: long>>")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    whole = marked.join(seeds.select(*key, F.lit(True).alias("seeded")), key, "left").where(
        "copy or seeded is null"
    )
    rest = whole.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256))
        .otherwise(F.lower(F.hex("sequence")))
        .alias("kept_sha256"),
        F.when(F.col("copy"), all_of_it).otherwise(nowhere).alias("repeats"),
    )
    return rest.unionByName(cut)


#: DuckDB: every run of 50 words by its digest.
SQL = """
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
placed AS (SELECT row, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM split WHERE len(w) >= 50),
runs AS (SELECT row, doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h FROM placed),
firsts AS (SELECT h, min(doc_id) AS low FROM runs GROUP BY h),
gone AS (
  SELECT DISTINCT row, unnest(range(p, p + 50)) AS q FROM runs JOIN firsts USING (h) WHERE doc_id > low),
words AS (SELECT row, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM split),
kept AS (
  SELECT row, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS t FROM words ANTI JOIN gone USING (row, q) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (row)
"""
