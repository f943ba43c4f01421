"""Packing by lexical retrieval: windows of a fixed length, filled with documents that a BM25 index finds alike.

Documents are tokenised once and written to the shared folder. The index is sharded by content: the two terms of greatest
weight route a document. Documents of one first term share a shard; if they have more than ``block_tokens`` tokens they are
split by the second term, and if one pair of terms has more, by a hash of the row. How much a term or pair holds is told by a
sample of ``FITTED_DOCS`` documents; a shard that outgrows a block is several blocks. Each shard is indexed in blocks of at most ``block_tokens`` tokens, over token ids with inverse document frequencies of the whole
corpus (a vector as long as the vocabulary). In a block a seed document opens a window; all its terms are looked up, and its
best unused neighbours that fit are added; if none fits, the best one is cut, fills the window and seeds the next. What a
block leaves over opens the first window of the next block, and the rest of a shard is cut into sequences whose lengths are
powers of two, so nothing is padded. Each document lies in one shard, each token in one piece. Neighbours in other
blocks are not found.

Defined cases: a null text is empty; an empty text is the end id alone; repeated rows are packed each; an empty table gives an
empty result; other columns are ignored. Sequence numbers depend on the rows alone, not on the order of their arrival.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.blocks import blocks, mix, string_buffers
from chatlens.llm.byte_tokens import tokenize
from chatlens.llm.shared import stage

WINDOW = 2048
END_ID = 1
#: Tokens indexed at a time; 8 MB of ids.
BLOCK_TOKENS = 4_000_000
#: Documents of a block up to which the scores by its commonest terms are one product of matrices, and cells of a matrix.
DENSE_DOCS, DENSE_CELLS = 4096, 1 << 23
K1, B = 1.2, 0.75
#: Documents from whose leading terms the bounds of the shards are drawn; every document is indexed.
FITTED_DOCS = 50_000
#: Tasks that pack, unless the session asks for more partitions.
MAX_TASKS = 20_000

def _pairs(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and frequency of all terms, by document."""
    kind = np.uint32 if len(ids) <= 1 << 16 else np.uint64  # half the bytes sort in half the time
    doc = np.repeat(np.arange(len(ids), dtype=kind), [len(x) for x in ids])
    doc <<= kind(16)
    doc |= np.concatenate(ids)
    doc.sort()
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    tf = np.diff(np.append(first, len(doc)))
    key = doc[first]
    return (key >> kind(16)).astype(np.int64), (key & kind(0xFFFF)).astype(np.int64), tf


def _ids_of(column: pa.Array) -> list[np.ndarray]:
    data, at = string_buffers(column)
    return [np.frombuffer(data[a:b].tobytes(), "<u2") for a, b in zip(at, at[1:], strict=False)]


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """In how many documents each token id stands; 65,536 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for block in blocks(batch.column("ids")):
                docs = [np.frombuffer(block.text(i), "<u2") for i in range(block.count)]
                total += np.bincount(_pairs(docs)[1], minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(total[used])], names=["term", "n"]
        )

    found = (
        tokens.select("ids")
        .mapInArrow(run, "term long, n long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    out = np.zeros(1 << 16, np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def _weights(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray, idf: np.ndarray, mean: float):
    """BM25 weight of each pair of document and term."""
    norm = K1 * (1 - B + B * length / max(mean, 1.0))
    return idf[term] * tf * (K1 + 1) / (tf + norm[doc])


def leading_terms(ids: list[np.ndarray], idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """The two terms of greatest weight of each document; the end id where there is none."""
    doc, term, tf = _pairs(ids)
    weight = _weights(doc, term, tf, np.array([len(x) for x in ids], float), idf, mean)
    weight[term == END_ID] = 0
    bounds = np.searchsorted(doc, np.arange(len(ids)))
    out = []
    for _ in range(2):
        most = np.maximum.reduceat(weight, bounds)
        at = np.flatnonzero(weight == most[doc])
        _, where = np.unique(doc[at], return_index=True)
        out.append(np.where(most > 0, term[at[where]], END_ID))
        weight[at[where]] = 0
    return out[0], out[1]


class Shards:
    """Numbers of shards by leading terms, from tokens by first term and the pairs of terms that fill more than a block."""

    def __init__(self, totals: dict[int, int], pairs: dict[tuple[int, int], int], block_tokens: int):
        self.first, self.parts = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        left = dict(totals)
        number, filled = 0, 0
        for (a, b), n in sorted(pairs.items()):
            left[a] -= n
            self.pairs[a, b] = number, -(-n // block_tokens)
            number += -(-n // block_tokens)
        for a, n in sorted(left.items()):
            if n > block_tokens:
                number, filled = number + (filled > 0), 0
                self.first[a], self.parts[a] = number, -(-n // block_tokens)
                number += -(-n // block_tokens)
                continue
            if filled + n > block_tokens:
                number, filled = number + 1, 0
            self.first[a] = number
            filled += n
        self.count = max(1, number + (filled > 0))
        # Terms that the counts do not hold lie anywhere.
        unseen = np.ones(1 << 16, bool)
        unseen[list(totals)] = False
        at = np.flatnonzero(unseen)
        self.first[at] = (mix(at.astype(np.uint64)) % np.uint64(self.count)).astype(np.int64)

    def of(self, first: np.ndarray, second: np.ndarray, salt: np.ndarray) -> np.ndarray:
        out = self.first[first] + (mix(second) % self.parts[first].astype(np.uint64)).astype(np.int64)
        for (a, b), (start, parts) in self.pairs.items() if len(self.pairs) < len(first) else ():
            own = (first == a) & (second == b)
            out[own] = start + (mix(salt[own]) % np.uint64(parts)).astype(np.int64)
        if len(self.pairs) >= len(first):
            for i, pair in enumerate(zip(first.tolist(), second.tolist(), strict=True)):
                if pair in self.pairs:
                    start, parts = self.pairs[pair]
                    out[i] = start + int(mix(salt[i : i + 1])[0]) % parts
        return out


class Index:
    """Inverted index of a block of documents with a list of those not used yet."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        doc, term, tf = _pairs(ids)
        weight = _weights(doc, term, tf, np.array([len(x) for x in ids], float), idf, mean_length)
        self.doc_bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.doc_terms = term
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.term_bounds = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        self.unused = np.ones(len(ids), bool)
        self.common, self.scores = np.zeros(1 << 16, bool), None
        if 64 <= len(ids) <= DENSE_DOCS:
            counts = np.diff(self.term_bounds)
            used = np.argsort(-counts, kind="stable")[: min(DENSE_CELLS // len(ids), np.count_nonzero(counts > len(ids) // 64))]
            self.common[used] = True
            column = np.zeros(1 << 16, np.int64)
            column[used] = np.arange(len(used))
            at = np.flatnonzero(self.common[term])
            held = np.zeros((len(ids), len(used)), np.float32)
            held[doc[at], column[term[at]]] = weight[at]
            self.scores = (held > 0).astype(np.float32) @ held.T

    def ranked(self, seed: int) -> np.ndarray:
        """Unused documents, best first; equal ones by position."""
        terms = self.doc_terms[self.doc_bounds[seed] : self.doc_bounds[seed + 1]]
        terms = terms[~self.common[terms]]
        first, n = self.term_bounds[terms], self.term_bounds[terms + 1] - self.term_bounds[terms]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.bincount(self.docs[at], self.weights[at], len(self.unused)).astype(float)
        if self.scores is not None:
            score += self.scores[seed]
        score[~self.unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]

    def neighbours(self, seed: int) -> list[int]:
        return self.ranked(seed).tolist()


class Packer:
    """Windows of one shard; pieces are (document, start, length, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence, self.filled = window, first_sequence, 0
        self.open: list[tuple] = []  # pieces of the window that is not full yet

    @property
    def room(self) -> int:
        return self.window - self.filled

    def add(self, row: tuple, size: int) -> list[tuple]:
        """Puts a whole document at the end; returns the pieces of windows that are full now."""
        done, start = [], 0
        while start < size:
            take = min(self.room, size - start)
            self.open.append((row, start, take, self.filled))
            self.filled += take
            start += take
            if not self.room:
                done += [(r, s, n, self.sequence, at) for r, s, n, at in self.open]
                self.sequence, self.filled, self.open = self.sequence + 1, 0, []
        return done

    def close(self) -> list[tuple]:
        """The rest as sequences of powers of two, longest first."""
        done, left = [], self.open
        size = 1 << max(self.filled.bit_length() - 1, 0)
        while left:
            while size > sum(n for _, _, n, _ in left):
                size >>= 1
            at = 0
            while at < size:
                row, start, n, _ = left.pop(0)
                take = min(n, size - at)
                done.append((row, start, take, self.sequence, at))
                at += take
                if take < n:
                    left.insert(0, (row, start + take, n - take, 0))
            self.sequence += 1
        self.filled, self.open = 0, []
        return done


def pack_block(rows: list[tuple], packer: Packer, idf: np.ndarray, mean: float) -> list[tuple]:
    """Puts all documents of a block into windows; returns the pieces of full windows. ``rows``: (doc_id, ids)."""
    ids = [x for _, x in rows]
    index = Index(ids, idf, mean)
    size = [len(x) for x in ids]
    sizes = np.array(size)
    done, ahead, seed = [], 0, None
    fresh = True
    while True:
        if fresh:
            while ahead < len(rows) and not index.unused[ahead]:
                ahead += 1
            if ahead == len(rows):
                return done
            seed = ahead
            index.unused[seed] = False
            done += packer.add(rows[seed], size[seed])
        fresh = True
        if not packer.filled:
            continue
        near = index.ranked(seed)
        at = 0
        while packer.filled:
            # The next best that fits; those passed over do not fit later either.
            fits = np.flatnonzero(sizes[near[at:]] <= packer.room)
            if not len(fits):
                break
            at += int(fits[0])
            i = int(near[at])
            index.unused[i] = False
            at += 1
            done += packer.add(rows[i], size[i])
        near = near[index.unused[near]]
        if packer.filled and len(near):
            # None fits: the best is cut and seeds the next window.
            seed, fresh = int(near[0]), False
            index.unused[seed] = False
            done += packer.add(rows[seed], size[seed])


def _leading(raw: list[bytes], idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    return leading_terms([np.frombuffer(x, "<u2") for x in raw], idf, mean)


def fitted_shards(tokens: DataFrame, shared, mean: float, block_tokens: int, n_docs: int, n_tokens: int) -> Shards:
    """Shards of about ``block_tokens``, from the leading terms of about ``FITTED_DOCS`` documents chosen by a hash."""
    if n_tokens <= block_tokens:
        return Shards({END_ID: n_tokens}, {}, max(n_tokens, 1))
    share = min(1.0, FITTED_DOCS / n_docs)
    sample = tokens.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 30)) < round(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("ids")):
                first, second = _leading([block.text(i) for i in range(block.count)], shared.value, mean)
                n = batch.column("n").slice(block.first, block.count)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), n], names=["first", "second", "n"])

    counted = sample.mapInArrow(run, "first long, second long, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))
    totals, pairs = {}, {}
    for r in counted.collect():  # at most a row per sampled document
        n = round(r["n"] / share)
        totals[r["first"]] = totals.get(r["first"], 0) + n
        if n > block_tokens:
            pairs[r["first"], r["second"]] = n
    return Shards(totals, pairs, block_tokens)


def _routed(tokens: DataFrame, shared, mean: float, shards: Shards) -> DataFrame:
    """``tokens`` with ``shard``, dealt to the shards; in a shard by leading terms, then in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("ids")):
                raw = [block.text(i) for i in range(block.count)]
                first, second = _leading(raw, shared.value, mean)
                part = batch.slice(block.first, block.count)
                salt = np.array([zlib.crc32(x) for x in raw], np.uint64)
                salt ^= mix(part.column("doc_id").fill_null(0).to_numpy().view(np.uint64))
                shard = shards.of(first, second, salt).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *map(pa.array, (first, second, shard))],
                    names=[*part.schema.names, "first", "second", "shard"],
                )

    routed = tokens.mapInArrow(run, "doc_id long, n long, ids binary, first long, second long, shard int")
    # As many tasks as shards while these are few; then several shards to a task.
    tasks = min(shards.count, max(MAX_TASKS, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return routed.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions(
        "shard", "first", "second", "doc_id", "n", "ids"
    )


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    window: int = WINDOW,
    block_tokens: int = BLOCK_TOKENS,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """A row per piece: its document, place there, checksum, sequence, place there, and ``ids`` (32-bit little-endian)."""
    tokens = stage(tokenize(docs, ranks_path, pattern, END_ID, id_column, text_column), "pack-tokens")
    n_docs, n_tokens = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(tokens)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    mean = n_tokens / max(n_docs, 1)
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    shards = fitted_shards(tokens, shared, mean, block_tokens, n_docs, n_tokens)
    routed = _routed(tokens, shared, mean, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, shard = None, None
        held, size = [], 0

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(8)]
            for (doc, ids), start, n, sequence, offset in pieces:
                raw = ids[start : start + n].astype("<u4").tobytes()
                values = (doc, start, n, zlib.crc32(raw), len(ids), sequence, offset)
                for column, v in zip(columns, (*values, raw if with_ids else None), strict=True):
                    column.append(v)
            types = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=[f.split()[0] for f in PIECES.split(", ")],
            )

        for batch in batches:
            for own, *row in zip(
                batch.column("shard").to_pylist(),
                batch.column("doc_id").to_pylist(),
                _ids_of(batch.column("ids")),
                strict=True,
            ):
                if own != shard:
                    if packer is not None:
                        last = pack_block(held, packer, shared.value, mean) if held else []
                        yield out(last + packer.close())
                    packer, shard = Packer(window, own << 32), own
                    held, size = [], 0
                held.append(tuple(row))
                size += len(row[1])
                if size >= block_tokens:
                    yield out(pack_block(held, packer, shared.value, mean))
                    held, size = [], 0
        if packer is not None:
            last = pack_block(held, packer, shared.value, mean) if held else []
            yield out(last + packer.close())

    pieces = routed.select("shard", "doc_id", "ids").mapInArrow(run, PIECES)
    return pieces if with_ids else pieces.drop("ids")
