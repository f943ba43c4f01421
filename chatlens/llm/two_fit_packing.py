"""Best-two-fit packing: documents in as few sequences of a fixed length as the method gives.

A document longer than a sequence is cut into whole sequences and a shorter first piece. Lengths are whole numbers, so all
that the packing needs of the corpus is how many pieces there are of each length: at most as many numbers as a sequence has
tokens, whatever the input. From these counts sequences are filled one kind at a time:

* the longest piece left opens a sequence, and the longest that fits is added until none fits;
* then the sequence's shortest piece is taken out if two unpacked pieces fill the gap, which has grown by it, more tightly; the
  two of the largest sum that fit take its place, and again from the new shortest while that helps;
* the kind is repeated while there are pieces for it, which is what filling sequence after sequence would give.

Each repetition ends with a length that has fewer pieces left than the kind uses, so a length can do that at most as often as
its count can be halved: kinds are bounded by lengths times the logarithm of the rows. Pieces are numbered in their length by
a sort in ranges (one length may hold any share of the rows), and number and length name sequence and place.

Defined cases: a null text is empty, an empty text is the end id alone; equal rows are packed each; a piece of a sequence's
length stands alone; a text of any length is cut; an empty table gives an empty result; other columns are ignored.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.byte_tokens import tokenize
from chatlens.llm.places import placed
from chatlens.llm.shared import stage

WINDOW = 2048
END_ID = 0

#: Pieces of one sequence, as (length, how many), longest first; and how many such sequences.
Kind = tuple[list[tuple[int, int]], int]


def _filled(left: np.ndarray, used: np.ndarray, room: int) -> int:
    """Adds the longest pieces that fit; returns the room that stays."""
    while room:
        fits = np.flatnonzero(left[: room + 1] > used[: room + 1])
        if not len(fits):
            break
        size = int(fits[-1])
        n = min(int(left[size] - used[size]), room // size)
        used[size] += n
        room -= n * size
    return room


def _two_for_one(left: np.ndarray, used: np.ndarray, room: int, first: int) -> int:
    """Puts two pieces in the place of the shortest, if that fills the sequence better; returns the room that stays."""
    while room:
        in_use = np.flatnonzero(used)
        shortest = int(in_use[0])
        if shortest == first and used[first] == 1:
            break  # nothing but the piece that opened the sequence
        gap = room + shortest
        free = left[: gap + 1] - used[: gap + 1]
        sizes = np.flatnonzero(free > 0)
        if not len(sizes):
            break
        # The longest partner of each piece that is not longer than the piece itself.
        at = np.searchsorted(sizes, np.minimum(gap - sizes, sizes), "right") - 1
        same = (at >= 0) & (sizes[at] == sizes) & (free[sizes] < 2)
        at -= same
        sums = np.where(at >= 0, sizes + sizes[at], 0)
        best = int(np.argmax(sums))
        if sums[best] <= shortest:
            break
        used[shortest] -= 1
        used[sizes[best]] += 1
        used[sizes[at[best]]] += 1
        room = gap - int(sums[best])
    return room


def two_fit(counts: np.ndarray, window: int) -> list[Kind]:
    """Kinds of sequences that use up ``counts`` pieces of each length (index 0 to ``window``)."""
    left, kinds = counts.astype(np.int64).copy(), []
    while True:
        any_left = np.flatnonzero(left)
        if not len(any_left):
            return kinds
        first = int(any_left[-1])
        used = np.zeros(window + 1, np.int64)
        used[first] = 1
        room = _filled(left, used, window - first)
        _two_for_one(left, used, room, first)
        sizes = np.flatnonzero(used)
        times = int((left[sizes] // used[sizes]).min())
        left -= times * used
        kinds.append(([(int(s), int(used[s])) for s in sizes[::-1]], times))


class Places:
    """Sequence and offset of the piece of a number in its length."""

    _BITS = 48

    def __init__(self, kinds: list[Kind], window: int):
        rows, sequence, numbered = [], 0, np.zeros(window + 1, np.int64)
        for sizes, times in kinds:
            offset = 0
            for size, n in sizes:
                rows.append(((size << self._BITS) + int(numbered[size]), int(numbered[size]), n, sequence, offset))
                numbered[size] += n * times
                offset += n * size
            sequence += times
        rows.sort()
        self.table = np.array(rows, np.int64).reshape(-1, 5).T

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, first, n, sequence, offset = self.table
        at = np.searchsorted(key, (length << self._BITS) + number, "right") - 1
        beyond = number - first[at]
        return sequence[at] + beyond // n[at], offset[at] + beyond % n[at] * length


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut(tokens: DataFrame, window: int, with_ids: bool) -> DataFrame:
    """A row per piece of each document; ``ids`` 32-bit little-endian, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for row, doc, raw in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "ids")], strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                ends = range(len(ids) % window or window, len(ids) + 1, window)
                for piece, end in enumerate(ends):
                    start = max(0, end - window)
                    own = ids[start:end].tobytes()
                    values = (row, doc, piece, start, end - start, zlib.crc32(own), own if with_ids else None)
                    for column, v in zip(columns, values, strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=[f.split()[0] for f in PIECES.split(", ")],
            )

    return tokens.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, PIECES)


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """A row per piece: ``doc_id``, ``piece``, ``start``, ``length``, checksum, ``sequence_id``, ``offset``, ``ids``."""
    tokens = tokenize(docs, ranks_path, pattern, end_id, id_column, text_column)
    pieces = stage(cut(tokens, window, with_ids), "two-fit-pieces")
    narrow = pieces.drop("ids")
    numbered = placed(narrow, "length", ["doc_id", "piece", "ids_crc32", "row"], "two-fit-placed")
    counts = np.zeros(window + 1, np.int64)
    for r in narrow.groupBy("length").count().collect():  # a row per length, at most ``window``
        counts[r["length"]] = r["count"]
    places = docs.sparkSession.sparkContext.broadcast(Places(two_fit(counts, window), window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "place"))
            sequence, offset = places.value.of(length, number)
            kept = [n for n in batch.schema.names if n != "place"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    schema = PIECES.removesuffix(", ids binary") + ", sequence_id long, offset long"
    packed = numbered.mapInArrow(run, schema)
    if with_ids:
        packed = packed.join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return packed.select(*columns, *(["ids"] if with_ids else []))
