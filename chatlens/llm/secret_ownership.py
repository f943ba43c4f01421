"""Secrets and who holds them: candidates of all texts, counted by distinct repositories and owners over the corpus.

A value that many owners hold, or that stands in many repositories, is an example copied around; one that few owners hold in
few repositories looks live. Base candidates
(assignments, access keys, hex runs) stay whatever the counts say; candidates of the further kinds stay only if live.

Counting goes through partial aggregates at (value, owner, repository), so a value in a third of all rows reaches the
shuffle as a row per task; the join of counts back to candidates joins two written tables, whose hot values the adaptive
skew join splits. Only digests of values are shuffled or written, never the values.

Defined cases: a null text is empty and holds nothing; a null owner or repository counts as one more owner or repository;
repeated rows are reported each, and count once per owner and repository; an empty table gives an empty result; other
columns are ignored. Offsets are code points.
"""

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.blocks import Block, blocks
from chatlens.llm.shared import stage

#: Base kinds in order, their patterns and the least length of the value (group of the pattern).
BASE = (
    (
        "assign",
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.IGNORECASE | re.ASCII,
        ),
        2,
        12,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: Further kinds, kept only where the counts call the value live.
FURTHER = (
    ("hosting", re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 36),
    ("chat", re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 0, 20),
    ("signed", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"), 0, 40),
    ("private", re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]*"), 0, 40),
    ("random", re.compile(r"[A-Za-z0-9+/_=-]+"), 0, 20),
)
#: Bits per character that a "random" value has at least.
MIN_ENTROPY = 3.5
#: Owners of one value from which it is a copied example.
EXAMPLE_OWNERS = 5
#: Repositories of one value from which it is a copied example, however few their owners.
EXAMPLE_REPOSITORIES = 12

_RANK = {kind: i for i, (kind, *_) in enumerate(BASE + FURTHER)}
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.")] = True
#: Every value but an assigned one holds a run of these bytes at least so long.
_RUN_LENGTH = 16


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _random(value: str) -> bool:
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return mixed and _entropy(value) >= MIN_ENTROPY


def _union(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans cover, disjoint and in order."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def candidates(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value), sorted by start and kind; further kinds only clear of base spans and of each other."""
    found = []
    for kind, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), kind, m.end(), m[group]))
    starts, ends = _union((s, e) for s, _, e, _ in found)
    for kind, pattern, group, least in FURTHER:
        added = []  # matches of one pattern do not overlap
        for m in pattern.finditer(text):
            s, e = m.span()
            if m.end(group) - m.start(group) < least:
                continue
            k = bisect_right(ends, s)
            if k < len(starts) and starts[k] < e or kind == "random" and not _random(m[0]):
                continue
            found.append((s, kind, e, m[group]))
            added.append((s, e))
        starts, ends = _union([*zip(starts, ends, strict=True), *added])
    return sorted(found, key=lambda c: (c[0], _RANK[c[1]]))


def _suspects(block: Block) -> np.ndarray:
    """Texts that can hold a candidate: those with a long run of value bytes, a keyword or a key header."""
    n = len(block.data)
    out = np.zeros(block.count, bool)
    gaps = np.concatenate(([-1], np.flatnonzero(~_RUN[block.data]), [n]))
    runs = gaps[:-1][np.diff(gaps) > _RUN_LENGTH] + 1
    ends = gaps[1:][np.diff(gaps) > _RUN_LENGTH]
    # A run may reach over the border of two texts: all texts that it touches are suspects.
    low = np.searchsorted(block.offsets, runs, "right") - 1
    high = np.searchsorted(block.offsets, ends - 1, "right") - 1
    for a, b in zip(low, high, strict=True):
        out[a : b + 1] = True
    lowered = block.data.tobytes().lower()
    for word in (*_KEYWORDS, b"-----begin "):
        at = lowered.find(word)
        while at >= 0:
            i = int(np.searchsorted(block.offsets, at, "right")) - 1
            out[i] = True
            at = lowered.find(word, int(block.offsets[i + 1]))
    return out


EXTRACTED = (
    "doc_id long, text_key long, owner string, repository string, n_assign long, n_access long, n_hex long, "
    "base_sha256 string, found array<struct<start: long, kind: string, stop: long, digest: binary>>"
)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct(
        [
            ("start", pa.int64()),
            ("kind", pa.string()),
            ("stop", pa.int64()),
            ("digest", pa.binary()),
        ]
    )
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        for block in blocks(batch.column("text")):
            counts = np.zeros((len(BASE), block.count), np.int64)
            hashes, found = [nothing] * block.count, [[]] * block.count
            for i in np.flatnonzero(_suspects(block)):
                rows = candidates(block.text(i).decode())
                base = [r for r in rows if _RANK[r[1]] < len(BASE)]
                for _, kind, _, _ in base:
                    counts[_RANK[kind], i] += 1
                listed = ",".join(f"{kind}:{s}:{e}" for s, kind, e, _ in base)
                hashes[i] = hashlib.sha256(listed.encode()).hexdigest()
                found[i] = [
                    (s, kind, e, hashlib.sha256(value.encode()).digest()[:16])
                    for s, kind, e, value in rows
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    *[
                        batch.column(c).slice(block.first, block.count)
                        for c in ("doc_id", "text_key", "owner", "repository")
                    ],
                    *[pa.array(c) for c in counts],
                    pa.array(hashes, pa.string()),
                    pa.array(found, pa.list_(item)),
                ],
                names=[f.split()[0] for f in EXTRACTED.split(", ")[:8]] + ["found"],
            )


def ownership(held: DataFrame) -> DataFrame:
    """``digest``, ``n_owners``, ``n_repositories``, ``n_found`` of (digest, owner, repository) rows."""
    by_repository = held.groupBy("digest", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("digest", "owner").agg(
        F.count("*").alias("repositories"), F.sum("n").alias("n")
    )
    return by_owner.groupBy("digest").agg(
        F.count("*").alias("n_owners"),
        F.sum("repositories").alias("n_repositories"),
        F.sum("n").alias("n_found"),
    )


def _live(owners: int, repositories: int) -> Callable[[Column], Column]:
    return lambda c: (c["n_owners"] < owners) & (c["n_repositories"] < repositories)


def scan_secrets(
    docs: DataFrame,
    owner: str = "source",
    repository: tuple[str, ...] = ("source", "lang"),
    id_column: str = "doc_id",
    text_column: str = "text",
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """A row per row of ``docs``: base counts and digest, ``found`` and ``spans`` (as text).

    ``found`` (start, kind, stop, the value's owners and repositories) holds base spans and live ones of further kinds. A value
    is live with fewer than ``example_owners`` owners and ``example_repositories`` repositories; ``n_live`` and ``n_example``
    count the others apart. ``n_repositories`` is the largest number of repositories of one value of the row, 0 without any.
    ``text_key`` is the hash of the text.
    """
    slim = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
        F.col(f"`{owner}`").cast("string").alias("owner"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in repository])).alias("repository"),
    ).withColumn("text_key", F.xxhash64("text"))
    rows = stage(
        slim.mapInArrow(_extract, EXTRACTED).withColumn("row", F.monotonically_increasing_id()),
        "secrets",
    )
    one = rows.select("row", "owner", "repository", F.explode("found").alias("c")).select(
        "row", "owner", "repository", "c.*"
    )
    counts = stage(ownership(one), "secret-owners")
    judged = (
        one.drop("owner", "repository")
        .join(counts.select("digest", "n_owners", "n_repositories"), "digest")
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "stop", "n_owners", "n_repositories")).alias("judged"))
    )
    live = _live(example_owners, example_repositories)
    rank = F.create_map(*[x for kind, i in _RANK.items() for x in (F.lit(kind), F.lit(i))])
    kept = F.filter("judged", lambda c: c["kind"].isin([k for k, *_ in BASE]) | live(c))
    ranked = F.sort_array(
        F.transform(
            kept,
            lambda c: F.struct(
                c["start"].alias("start"),
                rank[c["kind"]].alias("rank"),
                c["kind"].alias("kind"),
                c["stop"].alias("stop"),
                c["n_owners"].alias("n_owners"),
                c["n_repositories"].alias("n_repositories"),
            ),
        )
    )
    none = F.from_json(F.lit("[]"), judged.schema["judged"].dataType)
    return (
        rows.drop("found", "owner", "repository")
        .join(judged, "row", "left")
        .withColumn("judged", F.coalesce("judged", none))
        .select(
            "doc_id",
            "text_key",
            "n_assign",
            "n_access",
            "n_hex",
            "base_sha256",
            F.array_join(
                F.transform(ranked, lambda c: F.concat_ws(":", c["kind"], c["start"], c["stop"])),
                ",",
            ).alias("spans"),
            F.size(F.filter("judged", live)).cast("long").alias("n_live"),
            F.size(F.filter("judged", lambda c: ~live(c))).cast("long").alias("n_example"),
            F.coalesce(F.array_max(F.transform("judged", lambda c: c["n_repositories"])), F.lit(0)).alias("n_repositories"),
            F.transform(
                ranked,
                lambda c: F.struct(c["start"], c["kind"], c["stop"], c["n_owners"], c["n_repositories"]),
            ).alias("found"),
        )
    )


def redact_secrets(
    docs: DataFrame,
    mark: str = "[secret]",
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """``docs`` with every live span of ``text`` replaced by ``mark`` and ``n_chars`` brought up to date.

    Copied examples and all other text stay. Other columns are kept as they are.
    """
    spans = (
        scan_secrets(docs, example_owners=example_owners, example_repositories=example_repositories)
        .where(F.col("n_live") > 0)
        .select(
            "doc_id",
            "text_key",
            F.filter("found", _live(example_owners, example_repositories)).alias("live"),
        )
        .dropDuplicates(["doc_id", "text_key"])
        .withColumnsRenamed({"doc_id": "live_id", "text_key": "live_key"})
    )
    text, live = F.col("d.text"), F.col("s.live")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("upto"))
    cut = lambda a, b: F.substr(text, a + 1, b - a)
    replaced = F.aggregate(
        live,
        start,
        lambda acc, c: F.when(
            c["start"] >= acc["upto"],
            F.struct(
                F.concat(acc["out"], cut(acc["upto"], c["start"]), F.lit(mark)).alias("out"),
                c["stop"].alias("upto"),
            ),
        ).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["upto"], c["stop"]).alias("upto"))
        ),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["upto"] + 1)),
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("s.live_id")) & (
        F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("s.live_key")
    )
    masked = F.when(live.isNotNull(), replaced).otherwise(text)
    new = {"text": masked}
    if "n_chars" in docs.columns:
        size = F.length(masked).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(live.isNotNull(), size).otherwise(F.col("d.n_chars"))
    out = docs.alias("d").join(spans.alias("s"), same, "left")
    return out.select(*[new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
