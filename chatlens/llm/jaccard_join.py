"""Jaccard join of word n-gram sets by signature trees.

Sets that are equal are one node (a 64-bit hash of the set). Nodes that can be linked meet in buckets: a set's tokens are dealt to
parts by hash, so many parts that a set within the threshold leaves one of them alone, and a bucket is the hash of
one part (of two parts, for small sets). Buckets that several nodes share join these into clusters, far smaller than the
corpus. In a cluster a signature tree holds, at each node, the or of the token bitmaps below it, the range of sizes and the
largest number of tokens that share a bit with another of their set; a traversal of node pairs drops those whose largest
possible overlap is too small, and pairs that are already connected. What is left is compared token by token.

Clusters of more than ``BLOCK`` sets or ``BLOCK_BYTES`` of text are cut into blocks, each with a tree: first every block with
itself, then members of each component found so far with each other, dealt anew as long as that joins components, then,
only in clusters that still are more than one component, the sets that share a bucket (or every two blocks, where these are
less text), in rounds that send about the corpus once. So a large group of near copies costs about its
size; no pair of copies is written out. A task holds a block, or two: a text counts at least ``BLOCK_BYTES / BLOCK``, so a
block has about as many sets and bytes as these name, and a text beyond them mostly has a block for itself.

For sets that differ in at most ``PAIRED`` tokens at the threshold a common bucket is certain (parts left empty are made up for
by the tokens of a prefix). For larger sets parts are fewer than the differences, and a pair exactly at the threshold
has no common bucket with a probability below 1e-8, a closer pair far less.

Defined cases: a null text is empty; texts without words have an empty set, no links and themselves as component; texts of fewer
words than n have one token, the whole sequence; rows that repeat an id or a text are linked like others; a row without an id
takes part in links but gives no component its name; an empty table gives an empty result; other columns are ignored.
"""

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.blocks import Block, Words, blocks, grams, mix, signed, whole_grams
from chatlens.llm.links import components
from chatlens.llm.shared import stage, texts_of

#: Sets of one tree, and bytes of their texts.
BLOCK, BLOCK_BYTES = 1024, 1 << 24
#: Share of the members compared across blocks that a further round has to leave out.
GAIN = 0.2
#: Of ``BLOCK`` members about so many are compared across blocks, and the least of each component.
CONNECTORS = 4
#: Differences up to which buckets are pairs of parts.
PAIRED = 12
#: Bits of a signature, and children of a tree node.
SIGNATURE_BITS = 2048
FANOUT = 8


class Threshold:
    """Jaccard similarity of at least ``p / q``."""

    def __init__(self, p: int, q: int):
        if not 2 * q < 3 * p <= 3 * q:
            raise ValueError("the threshold is above 2/3 and at most 1")
        self.p, self.q = p, q
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(self.bounds[-1] * 3 // 2 + 1)

    def overlap(self, sizes):
        """Least overlap of two sets whose sizes sum to this."""
        return -(-self.p * sizes // (self.p + self.q))

    def level(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, sizes, "right") - 1

    def also_next(self, sizes: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Whether a set of the next level can be linked."""
        return sizes * self.q // self.p >= np.asarray(self.bounds)[level + 1]

    @lru_cache(maxsize=None)  # noqa: B019  a threshold lives as long as its job
    def differences(self, level: int) -> int:
        """Most tokens in which two linked sets of a level differ; the larger one is of that level."""
        high = self.bounds[level + 1] - 1
        return 2 * high * (self.q - self.p) // (self.q + self.p)

    @lru_cache(maxsize=None)  # noqa: B019
    def parts(self, level: int) -> int:
        d = self.differences(level)
        if d <= PAIRED:
            return d + 2
        n = max(2, d // 3)
        while n < d + 1 and n * math.log1p(-math.exp(-d / n) * 0.97) > math.log(1e-8):
            n += 1
        return n


def token_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the distinct n-grams of every text, sorted by both."""
    words = Words(block, lower=True)
    hashes, at = whole_grams(words, n)
    text = words.text[at]
    short = np.flatnonzero((words.per_text > 0) & (words.per_text < n))
    whole = [
        grams(words.hash[words.first[i] : words.first[i + 1]], int(words.per_text[i]), n)[0]
        for i in short
    ]
    text = np.concatenate((text, short))
    hashes = np.concatenate((hashes, np.array(whole, np.uint64)))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def _set_hashes(text: np.ndarray, tokens: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.bincount(text, minlength=count)
    total = np.zeros(count, np.uint64)
    np.add.at(total, text, mix(tokens ^ np.uint64(0xA0761D6478BD642F)))
    return sizes, mix(total + sizes.astype(np.uint64))


def buckets(text: np.ndarray, tokens: np.ndarray, count: int, limit: Threshold):
    """Text and key of every bucket."""
    sizes = np.bincount(text, minlength=count)
    own = limit.level(np.maximum(sizes, 1))
    owners, keys = [], []
    for shift in (0, 1):
        level = own + shift
        usable = sizes > 0
        if shift:
            usable &= limit.also_next(sizes, own)
        usable &= np.array([limit.differences(int(x)) > 0 for x in level])
        if not usable.any():
            continue
        parts = np.where(usable, [limit.parts(int(x)) for x in level], 0)
        first = np.concatenate(([0], np.cumsum(parts)))
        mine = usable[text]
        of, token = text[mine], tokens[mine]
        spread = mix(token ^ np.uint64(0xE7037ED1A0B428DB))
        part = ((spread >> np.uint64(32)) * parts[of].astype(np.uint64)) >> np.uint64(32)
        slot = first[of] + part.astype(np.int64)
        sums = np.zeros(first[-1], np.uint64)
        np.add.at(sums, slot, mix(token))
        held = np.bincount(slot, minlength=first[-1])
        owner = np.repeat(np.arange(count), parts)
        number = np.arange(first[-1]) - first[owner]
        tag = (level[owner] * 4096 + number).astype(np.uint64)
        signature = mix(sums + mix(tag + np.uint64(1)))
        paired = np.array([limit.differences(int(x)) <= PAIRED for x in level]) & usable
        single = ~paired[owner] & (held > 0)
        owners.append(owner[single])
        keys.append(signature[single])
        # Small sets, all of one number of parts at a time: two parts each.
        for p in np.unique(parts[paired]):
            texts = np.flatnonzero(paired & (parts == p))
            rows = first[texts][:, None] + np.arange(p)
            a, b = np.triu_indices(p, 1)
            full = (held[rows][:, a] + held[rows][:, b]) > 0
            both = mix(signature[rows][:, a] + mix(signature[rows][:, b]))
            who = np.broadcast_to(texts[:, None], full.shape)
            owners.append(who[full])
            keys.append(both[full])
            # Two parts without a token tell nothing apart: the tokens of a prefix stand in.
            for i in texts[~full.all(axis=1)]:
                own_tokens = np.sort(mix(tokens[text == i]))
                prefix = own_tokens[: sizes[i] - -(-limit.p * sizes[i] // limit.q) + 1]
                owners.append(np.full(len(prefix), i))
                keys.append(mix(prefix))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(keys)


class SignatureTree:
    """Sets in the order of size and least token, in nodes of ``FANOUT`` children up to one root."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0]))
        size = np.array([len(sets[i]) for i in self.order])
        bits = np.zeros((len(sets), SIGNATURE_BITS // 64), np.uint64)
        for row, i in enumerate(self.order):
            place = sets[i] >> np.uint64(64 - SIGNATURE_BITS.bit_length() + 1)
            np.bitwise_or.at(
                bits[row], (place >> np.uint64(6)).astype(int), np.uint64(1) << (place & np.uint64(63))
            )
        # Tokens that share their bit with another token of the set count in no and of bitmaps.
        slack = size - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, size, size, slack)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(slack, at),
                )
            )

    def members(self, level: int, node: int) -> list[int]:
        width = FANOUT**level
        return self.order[node * width : (node + 1) * width]


class Union:
    """Which sets are connected so far."""

    def __init__(self, labels: list):
        names: dict = {}
        self.parent = [names.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def one(self, members: list[int]) -> int | None:
        """The component of all members, if it is one."""
        root = self.find(members[0])
        return root if all(self.find(i) == root for i in members[1:]) else None


def _possible(a, i: int, b, js: np.ndarray, limit: Threshold) -> np.ndarray:
    """Of the nodes ``js`` of level b, those that can hold a set linked to one below node i of level a."""
    bits, low, high, slack = a
    bits_b, low_b, high_b, slack_b = b
    fits = (low_b[js] * limit.p <= high[i] * limit.q) & (low[i] * limit.p <= high_b[js] * limit.q)
    most = np.bitwise_count(bits[i] & bits_b[js]).sum(axis=1) + np.minimum(slack[i], slack_b[js])
    return fits & (most >= limit.overlap(low[i] + low_b[js]))


def linked_pairs(
    sets: list[np.ndarray], labels: list, limit: Threshold, halves: list | None = None
) -> list[tuple[int, int]]:
    """Links that connect what is linked and not connected by equal ``labels``; with ``halves`` only from half to half."""
    groups = [list(range(len(sets)))]
    if halves is not None:
        groups = [[i for i in groups[0] if halves[i] == h] for h in sorted(set(halves))]
    trees = [(g, SignatureTree([sets[i] for i in g])) for g in groups if g]
    if len(trees) < (1 if halves is None else 2):
        return []
    left, right = trees[0], trees[-1]
    same = halves is None
    union, found = Union(labels), []
    stack = [(len(left[1].levels) - 1, 0, len(right[1].levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        below_a = [left[0][m] for m in left[1].members(la, i)]
        below_b = [right[0][m] for m in right[1].members(lb, j)]
        root = union.one(below_a)
        if root is not None and root == union.one(below_b):
            continue
        if la == 0 and lb == 0:
            a, b = below_a[0], below_b[0]
            if a == b or union.find(a) == union.find(b):
                continue
            overlap = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if overlap >= limit.overlap(len(sets[a]) + len(sets[b])):
                union.parent[union.find(a)] = union.find(b)
                found.append((a, b))
            continue
        # The higher node is replaced by its children; a node against itself by pairs of them.
        if same and (la, i) == (lb, j):
            children = range(i * FANOUT, min((i + 1) * FANOUT, len(left[1].levels[la - 1][1])))
            for x in children:
                ys = np.arange(x, children.stop)
                ok = _possible(left[1].levels[la - 1], x, right[1].levels[la - 1], ys, limit)
                stack += [(la - 1, x, la - 1, int(y)) for y in ys[ok | (ys == x)]]
        elif la >= lb:
            xs = np.arange(i * FANOUT, min((i + 1) * FANOUT, len(left[1].levels[la - 1][1])))
            ok = _possible(right[1].levels[lb], j, left[1].levels[la - 1], xs, limit)
            stack += [(la - 1, int(x), lb, j) for x in xs[ok]]
        else:
            ys = np.arange(j * FANOUT, min((j + 1) * FANOUT, len(right[1].levels[lb - 1][1])))
            ok = _possible(left[1].levels[la], i, right[1].levels[lb - 1], ys, limit)
            stack += [(la, i, lb - 1, int(y)) for y in ys[ok]]
    return found


def _surveyed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                sizes, node = _set_hashes(*token_sets(block, n), block.count)
                empty = pa.array(signed(node), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[
                            batch.column(c).slice(block.first, block.count)
                            for c in ("doc_id", "text_key")
                        ],
                        pa.array(np.diff(block.offsets)),
                        pa.array(sizes),
                        empty,
                    ],
                    names=["doc_id", "text_key", "n_bytes", "n_shingles", "node"],
                )

    return run


def _bucketed(n: int, p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = Threshold(p, q)
        for batch in batches:
            for block in blocks(batch.column("text")):
                text, tokens = token_sets(block, n)
                _, node = _set_hashes(text, tokens, block.count)
                owner, key = buckets(text, tokens, block.count, limit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), pa.array(signed(node[owner]))], names=["key", "node"]
                )

    return run


def _joined(n: int, p: int, q: int):
    """Links within one block of a cluster, or from one block to another (rows of two ``half`` values)."""

    def run(table: pa.Table) -> pa.Table:
        limit = Threshold(p, q)
        # One row per set, in an order of its own.
        table = table.sort_by([("node", "ascending")])
        nodes = table["node"].to_numpy()
        new = np.ones(len(nodes), bool)
        new[1:] = nodes[1:] != nodes[:-1]
        table = table.filter(pa.array(new))
        nodes, sets = nodes[new], []
        for block in blocks(table["text"].combine_chunks()):
            text, tokens = token_sets(block, n)
            sets += np.split(tokens, np.searchsorted(text, np.arange(1, block.count)))
        halves = table["half"].to_pylist() if table["half"][0].is_valid else None
        pairs = linked_pairs(sets, table["label"].to_pylist(), limit, halves)
        a, b = (np.array([x[k] for x in pairs], int) for k in (0, 1))
        return pa.table({"a": pa.array(nodes[a]), "b": pa.array(nodes[b])})

    return run


def find_links(
    docs: DataFrame,
    n: int,
    p: int,
    q: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (doc_id, text_key, n_shingles, node) and links between nodes (a, b) that connect all linked sets.

    Sets are of words n-grams; linked are those with q * intersection >= p * union.
    """
    limit = Threshold(p, q)
    texts = texts_of(docs, id_column, text_column).withColumn("text_key", F.xxhash64("text"))
    rows = stage(
        texts.mapInArrow(
            _surveyed(n), "doc_id long, text_key long, n_bytes long, n_shingles long, node long"
        ),
        "jaccard-rows",
    )
    n_rows = rows.count()  # of the narrow tables below none has more
    keyed = texts.select("text").mapInArrow(_bucketed(n, p, q), "key long, node long")
    shared = stage(
        keyed.groupBy("key")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low < high")
        .select("key", "low"),
        "jaccard-shared",
    )
    meeting = keyed.join(shared, "key").where("node <> low")
    met = stage(meeting.select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "jaccard-met")
    clusters = stage(
        components(met, "jaccard-clusters").withColumnRenamed("root", "cluster"),
        "jaccard-clusters",
        n_rows,
    )
    one_of = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_key", "n_bytes")).alias("one"))
    load = F.greatest("one.n_bytes", F.lit(-(-BLOCK_BYTES // BLOCK)))
    members = stage(
        clusters.join(one_of, "node").select(
            F.coalesce("one.doc_id", F.lit(0)).alias("id"),
            F.col("one.text_key").alias("text_key"),
            "node",
            "cluster",
            load.alias("load"),
        ),
        "jaccard-members",
        n_rows,
    )
    sizes = stage(members.groupBy("cluster").agg(F.sum("load").alias("size")), "jaccard-sizes", n_rows)
    placed = members.join(sizes, "cluster").select(
        "id", "text_key", "node", "cluster", "load", F.ceil(F.col("size") / BLOCK_BYTES).alias("n_blocks")
    )
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("n_blocks")))
    placed = stage(placed, "jaccard-placed", n_rows)
    sets = stage(
        texts.withColumn("id", F.coalesce("doc_id", F.lit(0)))
        .join(placed.hint("shuffle_hash"), ["id", "text_key"])
        .select("node", "cluster", "load", "n_blocks", "block", "text"),
        "jaccard-sets",
    )
    join = _joined(n, limit.p, limit.q)
    no_half = F.lit(None).cast("long").alias("half")
    inside = sets.select("cluster", "block", "node", "text", F.col("node").alias("label"), no_half)
    links = stage(inside.groupBy("cluster", "block").applyInArrow(join, "a long, b long"), "jaccard-inside")
    several = sets.where("n_blocks > 1")
    if several.isEmpty():
        return rows, links

    def labelled() -> DataFrame:
        roots = components(links, "jaccard-labels")
        return several.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))

    now = stage(labelled(), "jaccard-labelled")
    compared, turn = None, 0
    while True:
        # Some members of each component of a block, of all blocks of the cluster together.
        chosen = stage(
            now.groupBy("cluster", "block", "label")
            .agg(
                F.collect_set(F.when(F.pmod("node", F.lit(BLOCK)) < CONNECTORS, F.struct("node", "load"))).alias("some"),
                F.min(F.struct("node", "load")).alias("least"),
            )
            .select("cluster", F.explode(F.array_union("some", F.array("least"))).alias("member"))
            .select("cluster", "member.*")
            .distinct(),
            "jaccard-chosen",
            n_rows,
        )
        n_chosen = chosen.count()
        if compared is not None and n_chosen > (1 - GAIN) * compared:
            break
        compared, turn = n_chosen, turn + 1
        counted = stage(
            chosen.groupBy("cluster").agg(F.ceil(F.sum("load") / BLOCK_BYTES).alias("n_groups")), "jaccard-groups", n_rows
        )
        dealt = stage(
            chosen.join(counted, "cluster").select(
                "node", F.pmod(F.xxhash64("node", F.lit(4 + turn)), F.col("n_groups")).alias("group")
            ),
            "jaccard-dealt",
            n_rows,
        )
        across = now.join(dealt, "node").select("cluster", F.col("group").alias("block"), "node", "text", "label", no_half)
        links = stage(
            links.unionByName(across.groupBy("cluster", "block").applyInArrow(join, "a long, b long")),
            "jaccard-across",
        )
        now = stage(labelled(), "jaccard-labelled")
    # Clusters that are not one component yet: what shares a bucket, or every two blocks.
    open_ = now.groupBy("cluster").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    open_ = stage(open_.select("cluster"), "jaccard-open", n_rows)
    if open_.isEmpty():
        return rows, links
    dealt = _dealt_last(now.join(open_, "cluster"), met, n_rows)
    sent, whole = dealt.agg(F.sum("n_bytes")).first()[0] or 0, rows.agg(F.sum("n_bytes")).first()[0]
    group = ["way", "unit", "i", "j"]
    rounds = max(1, -(-sent // whole))
    for turn in range(rounds):
        own = dealt.where(F.pmod(F.xxhash64(*group), F.lit(rounds)) == turn).drop("n_bytes")
        last = now.select("node", "text", "label").join(own, "node")
        found = stage(last.groupBy(*group).applyInArrow(join, "a long, b long"), "jaccard-last")
        links = links.unionByName(found)
    return rows, stage(links, "jaccard-links")


def _dealt_last(now: DataFrame, met: DataFrame, n_rows: int) -> DataFrame:
    """Where the sets of clusters that stay open are compared: ``node`` and its ``half`` by ``way``, ``unit``, ``i`` and ``j``.

    Linked sets share a bucket, so both lie in the star of its least node (``met``). Stars with several labels are compared,
    small ones packed to blocks, every two blocks of a larger one. A cluster that this sends more text for than
    every two blocks of its own has these compared.
    """
    nodes = stage(
        now.groupBy("node").agg(
            *[F.min(c).alias(c) for c in ("cluster", "label", "load", "n_blocks", "block")],
            F.sum(F.octet_length("text")).alias("n_bytes"),
        ),
        "jaccard-open-nodes",
        n_rows,
    )
    arms = met.select(F.col("a").alias("star"), F.col("b").alias("node")).join(nodes, "node")
    arms = arms.unionByName(nodes.withColumn("star", F.col("node"))).drop("n_blocks", "block")
    arms = stage(arms, "jaccard-arms")
    mixed = stage(
        arms.groupBy("star")
        .agg(F.min("label").alias("x"), F.max("label").alias("y"), F.sum("load").alias("size"))
        .where("x <> y")
        .select("star", "size", F.ceil(F.col("size") / BLOCK_BYTES).alias("n_blocks")),
        "jaccard-mixed",
        n_rows,
    )
    arms = arms.join(mixed, "star")
    by_stars = arms.groupBy("cluster").agg(F.sum(F.col("n_bytes") * F.col("n_blocks")).alias("by_stars"))
    by_blocks = nodes.groupBy("cluster").agg(F.sum(F.col("n_bytes") * F.col("n_blocks")).alias("by_blocks"))
    ways = stage(
        by_blocks.join(by_stars, "cluster").select("cluster", (F.col("by_stars") < F.col("by_blocks")).alias("starred")),
        "jaccard-ways",
        n_rows,
    )
    starred = arms.join(ways.where("starred").select("cluster"), "cluster")
    packed = starred.where("n_blocks = 1").agg(F.sum("load")).first()[0] or 0
    packs = max(1, -(-packed // BLOCK_BYTES))
    small = F.col("n_blocks") == 1
    none = F.lit(0).cast("long")
    # Small stars are in packs, (0, 0) of which is all; larger ones and clusters in blocks.
    star_rows = starred.select(
        "node",
        "n_bytes",
        F.when(small, 0).otherwise(1).alias("way"),
        F.when(small, F.pmod(F.xxhash64("star", F.lit(5)), F.lit(packs))).otherwise(F.col("star")).alias("unit"),
        F.pmod(F.xxhash64("node", F.lit(6)), F.col("n_blocks")).alias("block"),
        "n_blocks",
    )
    block_rows = nodes.join(ways.where("not starred").select("cluster"), "cluster").select(
        "node", "n_bytes", F.lit(2).alias("way"), F.col("cluster").alias("unit"), "block", "n_blocks"
    )
    spread = star_rows.unionByName(block_rows).select("*", F.explode(F.sequence(none, F.col("n_blocks") - 1)).alias("other"))
    # Blocks of a cluster were compared with themselves before.
    spread = spread.where("way <> 2 or other <> block").select(
        "node",
        "n_bytes",
        "way",
        "unit",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.when(F.col("other") != F.col("block"), F.col("block")).alias("half"),
    )
    return stage(spread.distinct(), "jaccard-dealt-last")


def _rooted(docs: DataFrame, n: int, p: int, q: int, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    """The rows of ``find_links`` with ``root``, which linked rows have in common (null for empty sets), and their number."""
    rows, links = find_links(docs, n, p, q, id_column, text_column)
    n_rows = rows.count()
    roots = stage(components(links, "jaccard-components"), "jaccard-roots", n_rows)
    rooted = stage(
        rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")),
        "jaccard-rooted",
        n_rows,
    )
    return rooted, n_rows


def join_components(
    docs: DataFrame,
    n: int = 3,
    p: int = 90,
    q: int = 100,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_shingles``, ``component_id`` (least id reachable by links), a row per row of ``docs``."""
    rooted, n_rows = _rooted(docs, n, p, q, id_column, text_column)
    first = stage(
        rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("first")),
        "jaccard-first",
        n_rows,
    )
    return rooted.join(first, "root", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), F.col("doc_id"))
        .otherwise(F.coalesce("first", "doc_id"))
        .alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """One row of ``docs`` of each component, all columns as they are: that of least ``doc_id`` (null last), then of least
    ``text_key``; of rows that repeat both, any one. Texts without words are linked to nothing and stay.
    """
    rooted, n_rows = _rooted(docs, n, p, q, "doc_id", "text")
    linked = rooted.where("root is not null")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    chosen = stage(linked.groupBy("root").agg(F.min(own).alias("chosen")), "jaccard-chosen", n_rows)
    counted = stage(
        linked.join(chosen, "root")
        .groupBy("doc_id", "text_key", own.eqNullSafe(F.col("chosen")).alias("keep"))
        .agg(F.count("*").alias("n")),
        "jaccard-counted",
        n_rows,
    ).select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "keep", "n")
    own_id = F.col("d.doc_id").cast("long")
    own_key = F.xxhash64(F.coalesce(F.col("d.text").cast("string"), F.lit("")))
    same = own_id.eqNullSafe(F.col("x.found_id")) & (own_key == F.col("x.found_key"))

    def of(rows: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
        return rows.alias("d").join(pairs.alias("x").hint("shuffle_hash"), same, how)

    kept = of(docs, counted.where("not keep"), "left_anti")
    repeated = counted.where("keep and n > 1")
    if repeated.isEmpty():
        return kept
    once = (
        of(docs, repeated, "left_semi")
        .select(F.struct("d.*").alias("d"), own_id.alias("id"), own_key.alias("key"))
        .dropDuplicates(["id", "key"])
        .select("d.*")
    )
    return of(kept, repeated, "left_anti").unionByName(once)


#: DuckDB: intersections counted shingle by shingle, components by a recursive query.
SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, w[p : p + 2] AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)),
reached(a, b) AS (
  SELECT doc_id, doc_id FROM split UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM split LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""
