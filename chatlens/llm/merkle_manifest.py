"""Merkle manifest of a table: a digest per row, a tree per source, a tree over the sources, and versions for changed rows.

A leaf is the digest of a row's columns. Per source, in order of the ids, every ``ARITY`` consecutive nodes become their
digest until one is left, the subroot; the subroots, in order of the sources, become the root in the same way.

Leaves are placed in their source by a sort in ranges (a hot source lies in many tasks) and gathered in aligned blocks of
``ARITY ** levels``; a block is a row, built by one task. Its root is a node of the next round, which is gathered in blocks
again, so a tree of any size takes a few rounds, and no task holds more than a block. On the way down each block learns the
siblings of its own root up to the very root.

In a block the tree is persistent: a changed leaf makes a version that copies the leaf's ancestors in the block and shares every
other node. The version's root goes on above the block: its ancestors in the upper blocks, and in the tree of
sources, are copied from the siblings that the block has learned.

Defined cases: a null column counts as ``-``, a null id stands first; rows of equal ids go by their digests, equal rows
are leaves each; a table without rows gives no rows; other columns are ignored. Texts of any length are hashed in the JVM.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.places import placed
from chatlens.llm.shared import stage

ARITY = 3
#: Levels of a block: 729 leaves.
LEVELS = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

#: A node is its digest (hexadecimal, ASCII) and its children.
Node = tuple[bytes, tuple]


def digest_of(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns in order, each as byte length, colon and value, or ``-`` if null."""
    texts = [c.cast("string") for c in columns]
    fields = [
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
        for t in texts
    ]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def parent(children: tuple) -> Node:
    return digest_of([c[0] for c in children]), children


def build(leaves: list[bytes], levels: int | None = None) -> tuple[Node, int]:
    """The tree over digests, and its height; with ``levels``, so many even if one node is left earlier."""
    nodes: list[Node] = [(d, ()) for d in leaves]
    height = 0
    while len(nodes) > 1 if levels is None else height < levels:
        nodes = [parent(tuple(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]
        height += 1
    return nodes[0], height


def version(node: Node, height: int, at: int, leaf: bytes) -> Node:
    """The tree with leaf ``at`` replaced: ancestors are copied, all other nodes shared."""
    if not height:
        return leaf, ()
    span = ARITY ** (height - 1)
    children = list(node[1])
    children[at // span] = version(children[at // span], height - 1, at % span, leaf)
    return parent(tuple(children))


#: A path is a list of levels from a node upwards: the digests left and right of it in its run.
Path = list[tuple[list[bytes], list[bytes]]]


def path_of(node: Node, height: int, at: int) -> Path:
    out: Path = []
    while height:
        span = ARITY ** (height - 1)
        k = at // span
        out.append(([c[0] for c in node[1][:k]], [c[0] for c in node[1][k + 1 :]]))
        node, height, at = node[1][k], height - 1, at % span
    return out[::-1]


def fold(digest: bytes, path: Path) -> bytes:
    """The root that a node with these siblings has."""
    for left, right in path:
        digest = digest_of([*left, digest, *right])
    return digest


def packed(path: Path) -> bytes:
    """A path as bytes: per level the numbers of digests on each side, then the digests."""
    return b"".join(
        bytes((len(left), len(right))) + b"".join(bytes.fromhex(d.decode()) for d in (*left, *right)) for left, right in path
    )


def unpacked(raw: bytes) -> Path:
    out, at = [], 0
    while at < len(raw):
        n, m = raw[at], raw[at + 1]
        found = [raw[i : i + 32].hex().encode() for i in range(at + 2, at + 2 + 32 * (n + m), 32)]
        out.append((found[:n], found[n:]))
        at += 2 + 32 * (n + m)
    return out


def _hexed(column: pa.Array) -> list[bytes | None]:
    return [None if d is None else d.hex().encode() for d in column.to_pylist()]


def _binary(digests: list[bytes]) -> pa.Array:
    return pa.array([bytes.fromhex(d.decode()) for d in digests], pa.binary())


def _rows(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class Forest:
    """Trees of groups: ``nodes`` has ``grp``, ``place`` (from 0), ``digest`` and payload columns, which stay at the leaves."""

    def __init__(self, nodes: DataFrame, levels: int, name: str):
        self.levels, self.name = levels, name
        self.blocks: list[DataFrame] = []
        self.alone: list[DataFrame] = []
        while True:
            blocks = self._gathered(nodes)
            counts = stage(
                blocks.groupBy("grp").agg(
                    F.count("*").alias("n"), F.max(F.when(F.col("block") == 0, F.col("own"))).alias("root")
                ),
                f"{name}-counts",
            )
            self.blocks.append(blocks)
            self.alone.append(counts.where("n = 1").select("grp", "root"))
            if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
                break
            nodes = blocks.join(counts.where("n > 1").select("grp"), "grp", "left_semi").select(
                "grp", F.col("block").alias("place"), F.col("upper").alias("digest")
            )

    def _gathered(self, nodes: DataFrame) -> DataFrame:
        """A row per block: its nodes in order, its root if it is the whole tree (``own``) and if it goes on (``upper``)."""
        levels, size = self.levels, ARITY**self.levels
        payload = [c for c in nodes.columns if c not in ("grp", "place")]
        grouped = nodes.groupBy("grp", F.floor(F.col("place") / size).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("place", *payload))).alias("nodes")  # at most ``size`` structs
        )

        def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, upper = [], []
                nodes = batch.column("nodes")
                digests = _hexed(nodes.flatten().field("digest"))
                at = 0
                for n in nodes.value_lengths().to_pylist():
                    leaves, at = digests[at : at + n], at + n
                    root, height = build(leaves)
                    own.append(root[0])
                    for _ in range(height, levels):  # a block that goes on is hashed up to its full height
                        root = parent((root,))
                    upper.append(root[0])
                yield _rows({**dict(zip(batch.schema.names, batch.columns, strict=True)), "own": _binary(own), "upper": _binary(upper)})

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema if f.name in payload)
        kinds = f"grp string, block long, nodes array<struct<place:long, {kinds.replace(' ', ':')}>>, own binary, upper binary"
        kinds = kinds.replace(",:", ", ")
        return stage(grouped.mapInArrow(roots, kinds), f"{self.name}-blocks")

    def roots(self) -> DataFrame:
        """``grp`` and ``root`` of every tree."""
        out = self.alone[0]
        for more in self.alone[1:]:
            out = out.unionByName(more)
        return out

    def block_paths(self, base: DataFrame) -> DataFrame:
        """Of the lowest blocks: ``grp``, ``block``, ``whole`` (the block is the tree), ``path`` above, ``root``.

        ``base`` has ``grp``, ``path`` (of the trees' roots), ``root`` (theirs).
        """
        above = None
        for k in range(len(self.blocks) - 1, -1, -1):
            own = base.join(self.alone[k].select("grp"), "grp", "left_semi").select(
                "grp", F.lit(0).cast("long").alias("block"), F.lit(True).alias("whole"), "path", "root"
            )
            paths = own if above is None else own.unionByName(above)
            if k:
                joined = self.blocks[k].select("grp", "block", "nodes").join(paths, ["grp", "block"])
                above = self._children(joined)
        return paths

    def _children(self, blocks: DataFrame) -> DataFrame:
        levels = self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    leaves = [n["digest"].hex().encode() for n in row["nodes"]]
                    tree, height = build(leaves, None if row["whole"] else levels)
                    n = len(leaves)
                    yield _rows(
                        {
                            "grp": pa.array([row["grp"]] * n),
                            "block": pa.array([x["place"] for x in row["nodes"]], pa.int64()),
                            "whole": pa.array([False] * n),
                            "path": pa.array([packed(path_of(tree, height, i)) + row["path"] for i in range(n)], pa.binary()),
                            "root": pa.array([row["root"]] * n, pa.binary()),
                        }
                    )

        kinds = "grp string, block long, whole boolean, path binary, root binary"
        return stage(blocks.mapInArrow(run, kinds), f"{self.name}-paths")


MANIFEST = (
    "doc_id long, leaf string, subroot string, root string, proof binary, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def manifest(docs: DataFrame, changed: Column, new_text: Column, levels: int = LEVELS) -> DataFrame:
    """A row per row of ``docs``: ``leaf``, ``subroot``, ``root``, ``proof``, and the root of its version.

    ``changed`` says which rows are changed (null: not), ``new_text`` what their text becomes. ``folded_root`` is the root that
    the row has now, or in its version, with the manifest's other leaves as they were; ``verified`` if that is ``root``.
    ``proof`` holds the siblings (``unpacked``).
    """
    columns = [F.col(f"`{c}`") for c in COLUMNS]
    source = columns[1].cast("string")
    leaves = stage(
        docs.select(
            columns[0].cast("long").alias("doc_id"),
            F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source)).alias("grp"),
            leaf_digest(columns).alias("digest"),
            F.when(changed, leaf_digest([*columns[:-1], new_text])).alias("version"),
        ),
        "merkle-leaves",
    )
    trees = Forest(placed(leaves, "grp", ["doc_id", "digest"], "merkle-placed"), levels, "merkle")
    tops = trees.roots().select(F.lit("").alias("grp"), F.col("grp").alias("source"), F.col("root").alias("digest"))
    top = Forest(placed(tops, "grp", ["source"], "merkle-sources"), levels, "merkle-top")
    root = top.roots().first()
    if root is None:
        return docs.sparkSession.createDataFrame([], MANIFEST)
    root = bytes(root["root"]).hex()
    start = top.roots().select("grp", F.lit(b"").alias("path"), "root")
    bases = _source_paths(top, start)
    paths = trees.block_paths(bases)
    blocks = trees.blocks[0].select("grp", "block", "nodes").join(paths, ["grp", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _verified(row, root, levels)

    return blocks.mapInArrow(run, MANIFEST)


def _source_paths(top: Forest, start: DataFrame) -> DataFrame:
    """``grp``, ``path`` and ``root`` of each source's tree, from the tree over the sources."""
    joined = top.blocks[0].select("grp", "block", "nodes").join(top.block_paths(start), ["grp", "block"])
    levels = top.levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = row["nodes"]
                tree, height = build([n["digest"].hex().encode() for n in nodes], None if row["whole"] else levels)
                yield _rows(
                    {
                        "grp": pa.array([n["source"] for n in nodes]),
                        "path": pa.array([packed(path_of(tree, height, i)) + row["path"] for i in range(len(nodes))], pa.binary()),
                        "root": pa.array([n["digest"] for n in nodes], pa.binary()),
                    }
                )

    return stage(joined.mapInArrow(run, "grp string, path binary, root binary"), "merkle-bases")


def _verified(row: dict, root: str, levels: int) -> pa.RecordBatch:
    """The manifest's rows of one block."""
    nodes, upper = row["nodes"], unpacked(row["path"])
    above = b"".join(b"".join((*left, *right)) for left, right in upper)
    leaves = [n["digest"].hex().encode() for n in nodes]
    tree, height = build(leaves, None if row["whole"] else levels)
    folded_tree = fold(tree[0], upper).decode()
    proofs, digests, folded = [], [], []
    for i, node in enumerate(nodes):
        path = path_of(tree, height, i)
        proofs.append(packed(path) + row["path"])
        siblings = b"".join(b"".join((*left, *right)) for left, right in path)
        digests.append(hashlib.sha256(siblings + above).hexdigest())
        if node["version"] is None:
            folded.append(folded_tree)
        else:
            folded.append(fold(version(tree, height, i, node["version"].hex().encode())[0], upper).decode())
    n = len(nodes)
    return _rows(
        {
            "doc_id": pa.array([x["doc_id"] for x in nodes], pa.int64()),
            "leaf": pa.array([x.decode() for x in leaves]),
            "subroot": pa.array([row["root"].hex()] * n),
            "root": pa.array([root] * n),
            "proof": pa.array(proofs, pa.binary()),
            "proof_sha256": pa.array(digests),
            "folded_root": pa.array(folded),
            "verified": pa.array([x == root for x in folded]),
        }
    )


def line_breaks_removed(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest with versions in which rows of an even CRC-32 of their id have lost the line breaks of their text."""
    even = F.crc32(F.col("`doc_id`").cast("string")) % 2 == 0
    return manifest(docs, even, F.translate(F.col("`text`").cast("string"), "\n", ""), levels)


def _layers(leaves: str, name: str) -> str:
    """Recursive table of all nodes of trees: ``g``, ``lvl``, ``place``, ``d``, ``n`` nodes on the level."""
    return f"""{name} AS (
  SELECT g, 0 AS lvl, place, d, n FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, place // {ARITY}, sha256(string_agg(d, '' ORDER BY place)), any_value((n + {ARITY - 1}) // {ARITY})
  FROM {name} WHERE n > 1 GROUP BY g, lvl, place // {ARITY})"""


def _sql_field(expression: str) -> str:
    return f"CASE WHEN {expression} IS NULL THEN '-' ELSE strlen({expression}) || ':' || {expression} END"


def _sql_leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return f"sha256({' || '.join(map(_sql_field, fields))})"


#: The least bit of the CRC-32 of the decimal id, over the bits of its bytes.
_SQL_ODD_CRC = """(list_reduce(
    flatten([[(ascii(c)::BIGINT >> k) & 1 for k in range(8)] for c in string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda r, b: xor(r >> 1, 3988292384 * (xor(r, b) & 1)), 4294967295::BIGINT) & 1)"""

SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce('s' || source, '') AS g, {_sql_leaf("text")} AS d,
    CASE WHEN {_SQL_ODD_CRC} = 1 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS now
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM rows_),
{_layers("leaves", "trees")},
subroots AS (
  SELECT g AS source, d AS subroot, '' AS g, d, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n
  FROM trees WHERE n = 1),
{_layers("subroots", "top")},
ways AS (
  SELECT l.doc_id, t.lvl, l.place // CAST(pow({ARITY}, t.lvl) AS BIGINT) AS own, t.g, false AS upper
  FROM leaves l JOIN (SELECT DISTINCT g, lvl FROM trees WHERE n > 1) t USING (g)
  UNION ALL
  SELECT l.doc_id, t.lvl, s.place // CAST(pow({ARITY}, t.lvl) AS BIGINT), '', true
  FROM leaves l JOIN subroots s ON s.source = l.g CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) t),
nodes AS (SELECT false AS upper, g, lvl, place, d FROM trees UNION ALL SELECT true, g, lvl, place, d FROM top),
steps AS (
  SELECT w.doc_id, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.upper, w.lvl) AS step,
    coalesce(string_agg(x.d, '' ORDER BY x.place) FILTER (x.place < w.own), '') AS before,
    coalesce(string_agg(x.d, '' ORDER BY x.place) FILTER (x.place > w.own), '') AS after
  FROM ways w JOIN nodes x
    ON x.upper = w.upper AND x.g = w.g AND x.lvl = w.lvl AND x.place // {ARITY} = w.own // {ARITY}
  GROUP BY w.doc_id, w.upper, w.lvl),
proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY doc_id),
folds AS (
  SELECT doc_id, 0 AS step, now AS d FROM leaves
  UNION ALL
  SELECT f.doc_id, s.step, sha256(s.before || f.d || s.after)
  FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step + 1)
SELECT l.doc_id, l.d AS leaf, r.subroot, t.d AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.d AS folded_root,
  f.d = t.d AS verified
FROM leaves l JOIN subroots r ON r.source = l.g CROSS JOIN (SELECT d FROM top WHERE n = 1) t
LEFT JOIN proofs p ON p.doc_id = l.doc_id
JOIN (SELECT doc_id, arg_max(d, step) AS d FROM folds GROUP BY doc_id) f ON f.doc_id = l.doc_id
"""
