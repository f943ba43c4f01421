"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text are its words, its pairs and triples of words in a row, and besides the shapes of its words (runs of letters in
either case and of digits squeezed, other marks kept) and pairs of neighbouring shapes, each hashed to one of ``2 ** BITS``
coordinates with its share of the text as value; a word that equals the one before it has a shape of its own, and the ends
of the text count as shapes, so an empty text has a feature too. A score is one sparse dot product.

Training takes a bounded sample of the labelled rows (about ``max_train`` texts, chosen by a hash of their ids), writes its
features once, by shard (a fixed number of them), runs the updates of each shard in a task, averages the weights and goes on from
there for ``rounds`` rounds. What reaches the driver is the weights: ``2 ** BITS`` numbers whatever the input's size.

Defined cases: a null text is empty; rows without a label are not learned from; of several labels of an id each counts; without
any labelled row every score is 0.5; repeated rows are scored each; an empty table gives an empty result; other columns
are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.blocks import Block, Words, blocks, hash_spans, mix, whole_grams
from chatlens.llm.shared import texts_of
from chatlens.sources.scratch import scratch_path

BITS = 20
#: Words in a row that are features, besides single ones.
GRAMS = (2, 3)
#: What such a run counts, of a single word.
GRAM_SHARE = 0.25
SIZE = 1 << BITS


@dataclass(frozen=True)
class Training:
    """Bound of the sample, shards and rounds, and the constants of the updates (step, smoothing, penalties)."""

    max_train: int = 12_000
    shards: int = 8
    rounds: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.001


# Shape of a byte: lower case letters and all beyond ASCII alike, capitals, digits, other marks as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


class _Shaped:
    """A block whose bytes are shapes, runs of one shape written once (as zeros that no word holds)."""

    def __init__(self, block: Block):
        shape = _SHAPE[block.data]
        again = np.zeros(len(shape), bool)
        again[1:] = (shape[1:] == shape[:-1]) & np.isin(shape[1:], (97, 65, 48))
        self.keep = ~again
        self.shape = shape


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, coordinate and value of every feature, sorted by text and coordinate."""
    words = Words(block)
    shaped = _Shaped(block)
    # Squeezed shapes of all words, with bounds moved accordingly.
    moved = np.concatenate(([0], np.cumsum(shaped.keep)))
    starts, ends = moved[words.start], moved[words.end]
    # A word's first byte may have been squeezed into the text before: then its shape begins one earlier.
    starts = starts - ~shaped.keep[words.start]
    squeezed = shaped.shape[shaped.keep]
    shape = hash_spans(squeezed, starts, ends)
    same = np.zeros(len(words.start), bool)
    if len(same):
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    shape[same] = np.uint64(0x5BD1E995)
    n = block.count
    # Shapes with one mark before and after each text.
    at = np.arange(len(shape)) + 2 * words.text + 1
    line = np.full(len(shape) + 2 * n, np.uint64(0x2545F491), np.uint64)
    line[at] = shape
    of_line = np.repeat(np.arange(n), words.per_text + 2)
    inside = of_line[:-1] == of_line[1:]
    pair = mix(line[:-1] * np.uint64(3) + mix(line[1:]))[inside]
    runs = [whole_grams(words, size, size) for size in GRAMS]
    text = np.concatenate((words.text, words.text, of_line[:-1][inside], *[words.text[at] for _, at in runs]))
    key = np.concatenate((words.hash, mix(shape + np.uint64(1)), pair, *[h for h, _ in runs])) >> np.uint64(64 - BITS)
    both = (text.astype(np.uint64) << np.uint64(BITS + 1)) | key << np.uint64(1)
    both[2 * len(words.hash) + len(pair) :] |= np.uint64(1)  # runs of words
    both.sort()
    share = np.where(both & np.uint64(1), GRAM_SHARE, 1.0)
    both >>= np.uint64(1)
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    share = np.add.reduceat(share, first)
    both = both[first]
    text = (both >> np.uint64(BITS)).astype(np.int64)
    # Root of the share: the squares of a text's values, but for the runs of words, sum to 1.
    value = np.sqrt(share / (3 * words.per_text[text] + 1))
    return text, (both & np.uint64(SIZE - 1)).astype(np.int64), value


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Leader:
    """Follow-the-regularised-leader state around given weights."""

    def __init__(self, weights: np.ndarray, training: Training):
        self.t = training
        self.n = np.full(SIZE, 1e-3)
        # The state that gives the weights back.
        rate = (self.t.beta + np.sqrt(self.n)) / self.t.alpha + self.t.l2
        self.z = -weights * rate - np.sign(weights) * self.t.l1

    def weights(self, at) -> np.ndarray:
        z, n, t = self.z[at], self.n[at], self.t
        rate = (t.beta + np.sqrt(n)) / t.alpha + t.l2
        return np.where(np.abs(z) <= t.l1, 0.0, -(z - np.sign(z) * t.l1) / rate)

    def learn(self, at: np.ndarray, value: np.ndarray, label: float, weight: float) -> None:
        w = self.weights(at)
        g = (_sigmoid(w @ value) - label) * value * weight
        n = self.n[at]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / self.t.alpha
        self.z[at] += g - step * w
        self.n[at] = n + g * g


def _featured(labelled: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                text, at, value = features(block)
                bounds = pa.array(np.searchsorted(text, np.arange(block.count + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, block.count),
                        batch.column("label").slice(block.first, block.count),
                        pa.ListArray.from_arrays(bounds, pa.array(at, pa.int32())),
                        pa.ListArray.from_arrays(bounds, pa.array(value, pa.float32())),
                    ],
                    names=["doc_id", "label", "at", "value"],
                )

    return labelled.mapInArrow(run, "doc_id long, label int, at array<int>, value array<float>")


def _learner(start: Broadcast, balance: dict[int, float], training: Training):
    """One pass of updates over the rows of a shard, from the weights ``start`` on."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        state = Leader(start.value, training)
        # The order of a shard does not depend on how its rows came together.
        table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("label", "ascending")])
        at, value = table["at"].combine_chunks(), table["value"].combine_chunks()
        label = table["label"].to_numpy()
        for i in np.random.default_rng(1).permutation(len(table)):
            state.learn(at[i].values.to_numpy(), value[i].values.to_numpy(), label[i], balance[label[i]])
        weights = state.weights(slice(None))
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(weights[used])], names=["at", "w"])

    return learn


def train(labelled: DataFrame, training: Training = Training()) -> np.ndarray:
    """Weights learned from rows of ``doc_id``, ``text`` and ``label`` (0 or 1)."""
    usable = labelled.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    share = training.max_train / max(usable.count(), training.max_train)
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < round(share * (1 << 30)))
    featured = _featured(sample).withColumn("shard", F.pmod(F.hash("doc_id", F.lit(7)), F.lit(training.shards)))
    path = scratch_path(labelled.sparkSession, "quality-train")
    featured.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    rows = labelled.sparkSession.read.schema(featured.schema).parquet(path)
    shards = [rows.where(F.col("shard") == k).drop("shard").coalesce(1) for k in range(training.shards)]
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    weights = np.zeros(SIZE)
    if len(counts) < 2:
        # One class only: nothing tells texts apart.
        return weights
    # Half way to equal weight of both classes, so that the rarer one is not drowned.
    total = sum(counts.values())
    balance = {k: (total / (2 * n)) ** 0.5 for k, n in counts.items()}
    for _ in range(training.rounds):
        learn = _learner(rows.sparkSession.sparkContext.broadcast(weights), balance, training)
        learned = reduce(DataFrame.unionAll, [shard.mapInArrow(learn, "at int, w double") for shard in shards])
        mean = learned.groupBy("at").agg((F.sum("w") / training.shards).alias("w")).toArrow()
        weights = np.zeros(SIZE)
        weights[mean["at"].to_numpy()] = mean["w"].to_numpy()
    return weights


def score(
    docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: label 1 likelier), a row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                text, at, value = features(block)
                dots = np.bincount(text, shared.value[at] * value, block.count)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, block.count),
                        pa.array(_sigmoid(dots)),
                    ],
                    names=["doc_id", "score"],
                )

    return texts_of(docs, id_column, text_column).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows to learn from: ``doc_id``, ``text``, ``label``; none that is held out."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    usable = marked.where(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    return texts_of(docs, "doc_id", "text").join(usable, "doc_id")


def classify(docs: DataFrame, labelled: DataFrame, training: Training = Training()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 if the score is 0.5 or more), a row per row of ``docs``."""
    return score(docs, train(labelled, training)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose ``text`` scores below ``least``; all columns as they are, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for block in blocks(batch.column("text")):
                text, at, value = features(block)
                dots = np.bincount(text, shared.value[at] * value, block.count)
                keep[block.first : block.first + block.count] = _sigmoid(dots) >= least
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
