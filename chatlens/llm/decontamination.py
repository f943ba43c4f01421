"""Benchmark decontamination: passages of documents within an edit distance of a benchmark item.

Texts and items are sequences of words (lower-cased, marks dropped), the distance counts words inserted, deleted or replaced,
and a passage leaks an item of n words if some window of the text is within ``floor(n * (1 - similarity))`` edits of it.

An item of more than ``PIECE`` words is cut into k pieces of about equal size, at most ``PIECE`` words each: within d edits of
the item, one piece at least has no more than d / k of them. Windows of a piece's size are embedded by a random walk that
turns edits into mismatches at fixed places: the walk reads a word, writes it down, and moves on by 0 or 1 words as a
hash of word and place says. Equal samples of places, taken several times from several walks, make window and piece
candidates; around candidates the exact edit distance of the whole item is worked out over all windows. Equal texts meet in
every sample; what is at the threshold meets in at least one with a probability of 0.99 and more for pieces of up to
``PIECE`` words (measured by the tests, for items of all sizes). Mismatches of a walk grow faster than the edits, hence the pieces.

Windows are taken where they can matter: a window within d edits of a piece of n words shares at least n - q + 1 - d * q of its
word q-grams (q as large as leaves one), near one diagonal; a place without that is no candidate, whatever the walks say.

The corpus is read once. Items of up to ``ITEM_WORDS`` words are broadcast and rows are independent then: no shuffle, no group. More
items are joined with the documents by their grams: a bitmap of bounded size (all that is broadcast) screens the documents'
grams; of each piece's grams only the rarest are joined, so many that a window within the distance has one of them (a
gram in a third of the rows is joined only where a piece has no other); the pairs so found are verified as above, in
groups of a document and about ``GROUP`` items. No item passes the driver then.

Defined cases: null texts and items are empty; an empty item leaks nowhere; repeated items are reported each under their id,
repeated rows too; an empty table of either kind gives an empty result; other columns are ignored.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.blocks import WORDLIKE, Words, blocks, grams, mix, signed
from chatlens.llm.shared import stage, texts_of

SIMILARITY = 0.8
WALKS, SAMPLES, PLACES = 6, 16, 3
#: Words of a piece; beyond, samples miss more than 0.01 of what is at the threshold.
PIECE = 30
#: Words of items that are broadcast at most.
ITEM_WORDS = 200_000
#: Bits of the bitmap that screens grams, as a power of two (32 MB), and items verified at a time.
MAX_BITMAP, GROUP = 28, 256
#: Embedded words held at a time.
CELLS = 1 << 22
#: Longest word gram of the count filter.
GRAM = 3


def walk(words: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Embeddings of sequences, rows of word hashes of which the first ``sizes`` count.

    Two words are written per word of the longest; past the end of a sequence the walk writes 0.
    """
    rows, longest = words.shape
    out = np.zeros((rows, 2 * longest), np.uint64)
    at, lines = np.zeros(rows, np.int64), np.arange(rows)
    for j in range(2 * longest):
        word = words[lines, np.minimum(at, longest - 1)]
        word = np.where(at < sizes, word, np.uint64(0))
        out[:, j] = word
        at += (mix(word ^ np.uint64((seed << 32) + j + 1)) >> np.uint64(63)).astype(np.int64)
    return out


@lru_cache(maxsize=4096)
def sampled_places(size: int, seed: int) -> np.ndarray:
    """Places of each sample for sequences of a size."""
    return np.random.default_rng([size, seed]).integers(0, 2 * size, (SAMPLES, PLACES))


def sample_keys(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One key for each walk and sample of places, a row per sequence."""
    out = np.zeros((len(words), WALKS * SAMPLES), np.uint64)
    step = max(1, CELLS // (2 * words.shape[1]))
    distinct, kind = np.unique(sizes, return_inverse=True)
    for seed in range(WALKS):
        places = np.stack([sampled_places(int(n), seed) for n in distinct])
        for first in range(0, len(words), step):
            part = slice(first, first + step)
            embedded = walk(words[part], sizes[part], seed)
            lines = np.arange(len(embedded))[:, None]
            keys = np.broadcast_to(
                sizes[part].astype(np.uint64)[:, None] << np.uint64(16), (len(embedded), SAMPLES)
            )
            keys = mix(keys + np.arange(1, SAMPLES + 1, dtype=np.uint64) + np.uint64(seed << 8))
            for p in range(PLACES):
                keys = mix(keys + embedded[lines, places[kind[part], :, p]])
            out[part, seed * SAMPLES : (seed + 1) * SAMPLES] = keys
    return out


def closest_window(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Edit distance, start and size of the window of ``text`` closest to ``item``; of equal ones the first that ends."""
    one, steps = 1 << 32, np.arange(len(text) + 1, dtype=np.int64) << 32
    # Edits in the high half, the start of the window in the low half.
    row = np.arange(len(text) + 1, dtype=np.int64)
    for word in item:
        now = row + one
        now[1:] = np.minimum(now[1:], row[:-1] + np.where(text == word, 0, one))
        # Words only in the text: the least of what lies to the left, one edit per step.
        row = np.minimum.accumulate(now - steps) + steps
    end = int(np.argmin(row >> 32))
    start = int(row[end] & (one - 1))
    return int(row[end] >> 32), start, end - start


class Items:
    """Benchmark items prepared for matching: whole (``ids``, ``words``, ``most`` edits), and as pieces (``size``, ``edits``...)."""

    def __init__(self, ids: list, texts: list[str], similarity: float):
        column = pa.array([t or "" for t in texts], pa.string())
        self.ids, self.words, self.most = [], [], []
        self.item, self.offset, self.pieces, self.edits, self.gram, self.need = [], [], [], [], [], []
        for block in blocks(column):
            words = Words(block, WORDLIKE, lower=True)
            for i in range(block.count):
                own = words.hash[words.first[i] : words.first[i + 1]]
                if len(own):
                    self.ids.append(ids[block.first + i])
                    self.words.append(own)
                    self.most.append(int(len(own) * (1 - similarity) + 1e-9))
                    self._cut(len(self.ids) - 1)
        self.size = np.array([len(w) for w in self.pieces], np.int64)
        self.tables = {q: self._table(q) for q in sorted(set(self.gram))}
        self.keys = np.zeros((0, WALKS * SAMPLES), np.uint64)
        if self.pieces:
            self.keys = sample_keys(*self._padded(self.pieces))

    def _cut(self, item: int) -> None:
        words = self.words[item]
        k = -(-len(words) // PIECE)
        bounds = [len(words) * j // k for j in range(k + 1)]
        d = self.most[item] // k
        for a, b in zip(bounds, bounds[1:], strict=False):
            q = next(q for q in (3, 2, 1) if q <= GRAM and b - a - q + 1 - d * q >= 1 or q == 1)
            self.item.append(item)
            self.offset.append(a)
            self.pieces.append(words[a:b])
            self.edits.append(d)
            self.gram.append(q)
            self.need.append(max(1, b - a - q + 1 - d * q))

    @staticmethod
    def _padded(sequences: list[np.ndarray], sizes: list[int] | None = None):
        """Sequences as rows of one length, and the sizes that count."""
        sizes = np.array(sizes or [len(x) for x in sequences], np.int64)
        rows = np.zeros((len(sequences), sizes.max()), np.uint64)
        for row, x in zip(rows, sequences, strict=True):
            row[: len(x)] = x
        return rows, sizes

    def _table(self, q: int):
        """Sorted grams of the pieces that are searched by q-grams, with piece and place."""
        found = [
            (g, k, at)
            for k, words in enumerate(self.pieces)
            if self.gram[k] == q
            for at, g in enumerate(grams(words, q))
        ]
        g = np.array([x[0] for x in found], np.uint64)
        order = np.argsort(g, kind="stable")
        rest = np.array([x[1:] for x in found], np.int64)[order]
        g = g[order]
        screen = np.zeros(1 << 20, bool)
        screen[(g >> np.uint64(44)).astype(int)] = True
        return g, rest[:, 0], rest[:, 1], screen

    def places(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(piece, text, first start, last start) where enough grams of a piece lie near one diagonal."""
        for q, (table, item_of, place_of, screen) in self.tables.items():
            h = grams(words.hash, q)
            if not len(h):
                continue
            hit = np.flatnonzero(screen[(h >> np.uint64(44)).astype(np.int64)])
            hit = hit[words.text[hit] == words.text[hit + q - 1]]
            low = np.searchsorted(table, h[hit], "left")
            high = np.searchsorted(table, h[hit], "right")
            n = high - low
            at = np.repeat(hit, n)
            row = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, diagonal, text = item_of[row], at - place_of[row], words.text[at]
            order = np.lexsort((diagonal, text, item))
            item, diagonal, text = item[order], diagonal[order], text[order]
            # Hits of one piece and text whose diagonals lie within twice the distance, enough of them.
            need = np.array(self.need)[item]
            most = np.array(self.edits)[item]
            last = np.arange(len(item)) + need - 1
            fits = last < len(item)
            i, j = np.flatnonzero(fits), last[fits]
            near = (
                (item[i] == item[j])
                & (text[i] == text[j])
                & (diagonal[j] - diagonal[i] <= 2 * most[i])
            )
            i, j = i[near], j[near]
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                d = self.edits[item[a]]
                yield int(item[a]), int(text[a]), int(diagonal[a]) - d, int(diagonal[b]) + d

    def leaks(self, words: Words) -> list[tuple]:
        """(text, item, distance, first word, number of words) of the closest window of each leaked item in each text."""
        starts: dict[tuple[int, int], set[int]] = {}
        for piece, text, low, high in self.places(words):
            a, b = int(words.first[text]), int(words.first[text + 1])
            size = int(self.size[piece])
            low, high = max(low, a), min(high, b - size)
            # A text shorter than the piece is one window, filled up.
            starts.setdefault((piece, text), set()).update(range(low, high + 1) if high >= low else [a])
        places: dict[tuple[int, int], set[int]] = {}
        for text, at, piece in self._meeting(words, starts):
            places.setdefault((text, self.item[piece]), set()).add(at - self.offset[piece])
        found = []
        for (text, item), ats in sorted(places.items()):
            best = self._closest(words, item, text, sorted(ats))
            if best[0] <= self.most[item]:
                found.append((text, item, *best))
        return found

    def _meeting(self, words: Words, starts: dict[tuple[int, int], set[int]]) -> list[tuple[int, int, int]]:
        """(text, start, piece), in order, of the windows that meet their piece in a sample."""
        wanted = sorted((text, at, piece) for (piece, text), ats in starts.items() for at in ats)
        if not wanted:
            return []
        # Each window once for each size; pieces of one size share it.
        number: dict[tuple[int, int], int] = {}
        windows, of_window = [], []
        for text, at, piece in wanted:
            size = int(self.size[piece])
            k = number.setdefault((at, size), len(number))
            if k == len(windows):
                windows.append(words.hash[at : min(at + size, words.first[text + 1])])
                of_window.append(size)
        keys = sample_keys(*self._padded(windows, of_window))
        rows = [number[at, int(self.size[piece])] for _, at, piece in wanted]
        pieces = [piece for _, _, piece in wanted]
        candidate = (keys[rows] == self.keys[pieces]).any(axis=1)
        return [wanted[k] for k in np.flatnonzero(candidate)]

    def _closest(self, words: Words, item: int, text: int, ats: list[int]) -> tuple:
        """Distance, start and size of the closest window around candidates (sorted)."""
        d, n = self.most[item], len(self.words[item])
        a, b = int(words.first[text]), int(words.first[text + 1])
        reach = n + 2 * d
        apart = np.flatnonzero(np.diff(ats) > 2 * reach) + 1
        best = (d + 1, 0, 0)
        for near in np.split(np.array(ats), apart):
            low, high = max(a, int(near[0]) - d), min(b, int(near[-1]) + reach)
            edits, start, size = closest_window(self.words[item], words.hash[low:high])
            best = min(best, (edits, low - a + start, size))
        return best


LEAKS = "doc_id long, item_id long, distance int, first_word int, n_words int"


def _matched(texts: DataFrame, shared: Broadcast, similarity: float) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = Items(*shared.value, similarity)
        for batch in batches:
            docs = batch.column("doc_id")
            for block in blocks(batch.column("text")):
                found = prepared.leaks(Words(block, WORDLIKE, lower=True)) if prepared.ids else []
                columns = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.take(pa.array([block.first + t for t in columns[0]], pa.int64())),
                        pa.array([prepared.ids[k] for k in columns[1]], pa.int64()),
                        *[pa.array(c, pa.int32()) for c in columns[2:]],
                    ],
                    names=[f.split()[0] for f in LEAKS.split(", ")],
                )

    return texts.mapInArrow(run, LEAKS)


def _few(items: DataFrame) -> tuple[list, list[str]] | None:
    """Ids and texts of the items, in order, if they have at most ``ITEM_WORDS`` words (a character and a blank at least)."""
    load = items.agg(F.sum(F.floor(F.length("text") / 2) + 1)).first()[0] or 0
    if load > ITEM_WORDS:
        return None
    rows = items.orderBy("doc_id", "text").collect()
    return [r["doc_id"] for r in rows], [r["text"] for r in rows]


def _gram_keys(hashes: np.ndarray, q: int) -> np.ndarray:
    """Grams of a sequence, apart for each q."""
    return grams(hashes, q, q)


def _item_grams(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                one = Items([item], [text], similarity)
                for k, words in enumerate(one.pieces):
                    own = _gram_keys(words, one.gram[k])
                    taken = np.unique(own)
                    # Any ``need`` of the grams leave out fewer than this.
                    rest = len(own) - one.need[k] + 1
                    for column, v in zip(columns, (item, k, rest, signed(taken).tolist()), strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item", "piece", "rest", "grams"]
            )

    return run


def _bitmap(keys: DataFrame, shift: int) -> np.ndarray:
    """Which values the leading bits of ``gram`` have, as a bit each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(batch.column("gram").to_numpy().view(np.uint64) >> np.uint64(shift))
            bit = np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(place >> np.uint64(6))), pa.array(signed(bit))], names=["word", "bit"]
            )

    found = keys.select("gram").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros((1 << (64 - shift)) // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _screened(shared: Broadcast, shift: int):
    """Documents with grams that the bitmap holds, and these grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = Words(block, WORDLIKE, lower=True)
                owners, keys = [], []
                for q in range(1, GRAM + 1):
                    key = _gram_keys(words.hash, q)
                    place = key >> np.uint64(shift)
                    hit = np.flatnonzero((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                    hit = hit[words.text[hit] == words.text[hit + q - 1]]
                    owners.append(words.text[hit])
                    keys.append(key[hit])
                owner, key = np.concatenate(owners), np.concatenate(keys)
                order = np.lexsort((key, owner))
                owner, key = owner[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
                owner, key = owner[new], key[new]
                bounds = pa.array(np.searchsorted(owner, np.arange(block.count + 1)), pa.int32())
                part = batch.slice(block.first, block.count)
                lists = pa.ListArray.from_arrays(bounds, pa.array(signed(key)))
                whole = pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "grams"])
                yield whole.filter(pa.array(np.bincount(owner, minlength=block.count) > 0))

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared: dict[int, Items] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row in batch.to_pylist():
                (block,) = blocks(pa.array([row["text"]], pa.string()))
                words = Words(block, WORDLIKE, lower=True)
                for item in row["items"]:
                    one = prepared.get(item["item"])
                    if one is None:
                        if len(prepared) >= 4096:
                            prepared.clear()
                        one = prepared[item["item"]] = Items([item["item_id"]], [item["text"]], similarity)
                    for _, _, *best in one.leaks(words):
                        for column, v in zip(out, (row["doc_id"], item["item_id"], *best, row["text_key"]), strict=True):
                            column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            names = [f.split()[0] for f in LEAKS.split(", ")] + ["text_key"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return run


def _by_grams(texts: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """The leaks, with ``text_key`` (hash of the document's text), by a join of documents and items."""
    numbered = stage(items.withColumnRenamed("doc_id", "item_id").withColumn("item", F.monotonically_increasing_id()), "leak-items")
    pieces = stage(
        numbered.mapInArrow(_item_grams(similarity), "item long, piece int, rest int, grams array<long>"), "leak-pieces"
    )
    wanted = pieces.select("item", "piece", "rest", F.explode("grams").alias("gram"))
    n = wanted.count()
    shift = 64 - min(MAX_BITMAP, max(16, (16 * n).bit_length()))
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(wanted, shift))
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = stage(
        rows.mapInArrow(_screened(bitmap, shift), "row long, doc_id long, text string, grams array<long>"), "leak-texts"
    )
    hits = found.select("row", F.explode("grams").alias("gram"))
    often = stage(hits.groupBy("gram").agg(F.count("*").alias("n")), "leak-often")
    counted = wanted.join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("item", "piece", "rest").agg(
        F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams")  # at most a piece's words
    )
    rarest = rarest.select("item", F.explode(F.expr("slice(grams, 1, rest)")).alias("g")).where("g.n > 0")
    joined = stage(rarest.select("item", F.col("g.gram").alias("gram")).distinct(), "leak-rarest")
    pairs = stage(hits.join(joined, "gram").select("row", "item").distinct(), "leak-pairs")
    groups = -(-numbered.count() // GROUP)
    of_row = (
        pairs.join(numbered, "item")
        .groupBy("row", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("group"))
        .agg(F.collect_list(F.struct("item", "item_id", "text")).alias("items"))  # about GROUP items
    )
    both = of_row.join(found.select("row", "doc_id", "text"), "row").withColumn("text_key", F.xxhash64("text"))
    return both.select("doc_id", "text", "text_key", "items").mapInArrow(_verified(similarity), f"{LEAKS}, text_key long")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = SIMILARITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per document and leaked item: ``distance`` of the closest window, its first word and number of words.

    ``items`` has ``item_id`` and ``text``. Documents without a leak give no row.
    """
    texts, found = texts_of(docs, id_column, text_column), texts_of(items, "item_id", "text")
    few = _few(found)
    if few is None:
        return _by_grams(texts, found, similarity).drop("text_key")
    return _matched(texts, docs.sparkSession.sparkContext.broadcast(few), similarity)


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows whose ``text`` leaks an item; all columns as they are."""
    found = texts_of(items, "item_id", "text")
    few = _few(found)
    if few is None:
        leaks = _by_grams(texts_of(docs, "doc_id", "text"), found, similarity)
        gone = stage(leaks.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "leak-gone")
        key = F.xxhash64(F.coalesce(F.col("d.text").cast("string"), F.lit("")))
        same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.gone_id")) & (key == F.col("g.gone_key"))
        return docs.alias("d").join(gone.alias("g"), same, "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = Items(*shared.value, similarity)
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for block in blocks(batch.column("text")) if prepared.ids else ():
                for text, *_ in prepared.leaks(Words(block, WORDLIKE, lower=True)):
                    keep[block.first + text] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
