"""The Merkle manifest against a plain tree over all rows, with blocks so small that trees take many rounds."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from chatlens.llm import merkle_manifest, places


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def path(level, at):
    """Root of the nodes, and the nodes left and right of node ``at`` and its ancestors, level by level."""
    steps = []
    while len(level) > 1:
        run = at // 3 * 3
        steps.append((level[run:at], level[at + 1 : run + 3]))
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at //= 3
    return level[0], steps


def expected(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] if row[0] is not None else -(2**63), leaf(row, row[4]), row))
    order = sorted(groups, key=lambda s: b"" if s is None else b"s" + s.encode())
    subroots = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:2])
        subroots[s] = path([x[1] for x in groups[s]], 0)[0]
    out = []
    for k, s in enumerate(order):
        for at, (_, own, row) in enumerate(groups[s]):
            subroot, low = path([x[1] for x in groups[s]], at)
            root, high = path([subroots[x] for x in order], k)
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(row, text)
            for left, right in low + high:
                folded = sha(*left, folded, *right)
            proof = sha(*[d for left, right in low + high for d in left + right])
            out.append((row[0], own, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def result(docs, levels):
    rows = merkle_manifest.line_breaks_removed(docs, levels).drop("proof").collect()
    return sorted(map(tuple, rows), key=repr)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_by_brute_force(documents, levels):
    assert result(documents, levels) == expected(rows_of(documents))


@pytest.mark.parametrize("levels", [1, 2])
def test_hot_source_many_sources_and_repeated_rows(spark, levels):
    rows = [(i, "hot", "en", 3, "a\nb") for i in range(100)] + [(7, "hot", None, None, "same\n")] * 30
    rows += [(1000 + i, f"s{i}é", "en", 1, f"t\n{i}") for i in range(25)] + [(None, None, None, None, None)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert result(docs, levels) == expected(rows)


@pytest.mark.parametrize("levels", [1, 6])
def test_manifest_on_odd_rows(odd, none, levels):
    assert result(odd, levels) == expected(rows_of(odd))
    assert result(none, levels) == []
    one = odd.where("doc_id = 2")
    assert result(one, levels) == expected(rows_of(one))


def test_proofs_fold_to_the_root(documents):
    for r in merkle_manifest.line_breaks_removed(documents, 2).collect():
        steps = merkle_manifest.unpacked(bytes(r.proof))
        assert merkle_manifest.fold(r.leaf.encode(), steps).decode() == r.root
        assert sha(*[d.decode() for left, right in steps for d in left + right]) == r.proof_sha256


def test_versions_share_untouched_nodes():
    tree, height = merkle_manifest.build([b"%064x" % i for i in range(27)])
    new = merkle_manifest.version(tree, height, 13, b"f" * 64)
    assert height == 3 and new[0] != tree[0]
    assert [a is b for a, b in zip(new[1], tree[1], strict=True)] == [True, False, True]
    assert [a is b for a, b in zip(new[1][1][1], tree[1][1][1], strict=True)] == [True, False, True]
    assert merkle_manifest.version(new, height, 13, b"%064x" % 13)[0] == tree[0]


def test_places_of_a_hot_group(spark):
    rows = [("hot", i % 50) for i in range(4000)] + [(f"g{i % 40}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = places.placed(df, "g", ["v"], "test-places").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = defaultdict(list)
    for r in got:
        groups[r.g].append((r.place, r.v))
    assert len(groups) == 41
    for found in groups.values():
        found.sort()
        assert [p for p, _ in found] == list(range(len(found)))
        assert [v for _, v in found] == sorted(v for _, v in found)
