"""URL filter: exact membership of URL prefixes in key lists by cascades of Bloom filters.

Level 0 of a cascade encodes the listed keys, level 1 the keys of the universe that level 0 lets through by mistake, level 2
the listed keys that level 1 lets through, and so on until no mistake is left. The universe is every key that
any URL of the table gives, so membership is exact for all of them, and URLs are judged in one pass without a join.

A key is a host or a domain above it, followed by a path prefix that ends in "/". Prefixes deeper than any listed key
cannot match and are not formed. Filter bits are or-ed by partial aggregates; what reaches the driver and is broadcast is
the filters, whose size follows the lists. A list that needs more than ``MAX_BITS`` is dealt by hash to several cascades,
each exact for its share of the universe; what fits into ``MAX_BITS`` is applied at a time, in passes over a written table.

Defined cases: a null URL or one without "://" has empty host and path and no rule; a URL of any length is read whole; an empty
table gives an empty result; an empty list has no members; repeated rows are judged each; other columns are ignored.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.shared import stage

#: The rules of the registered query, host and path prefix.
RULES = {
    "block": ("net/", "example.com/de/"),
    "allow": ("example.net/en/", "org/fr/"),
}
#: First labels of the sites that the registered query blocks where no rule fits, under any domain.
FAMILIES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: 128 MB of filter bits held at a time.
MAX_BITS = 1 << 30

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Level:
    """One Bloom filter: ``words`` of 64 bits, ``hashes`` positions per key, ``seed`` apart from other levels."""

    words: np.ndarray
    bits: int
    hashes: int
    seed: int

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for p in positions(h1, h2, self.bits, self.hashes, self.seed):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def positions(h1, h2, bits: int, hashes: int, seed: int) -> Iterator[np.ndarray]:
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
    for k in range(hashes):
        x = h1 + np.uint64(seed * 64 + k + 1) * h2
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        yield x % np.uint64(bits)


def in_cascade(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: it is if the first level that lacks it has an odd number."""
    out = np.zeros(len(h1), bool)
    live = np.arange(len(h1))
    for k, level in enumerate(levels):
        held = level.holds(h1[live], h2[live])
        out[live[~held]] = k % 2 == 1
        live = live[held]
    out[live] = len(levels) % 2 == 1
    return out


def _filtered(keys: DataFrame, level: Level) -> DataFrame:
    """The keys that a level holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            yield batch.filter(pa.array(level.holds(h1, h2)))

    return keys.mapInArrow(run, keys.schema)


def _bits(n: int, rate: float) -> int:
    return max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))


def _rate(n: int, n_others: int) -> float:
    """How often the first filter of ``n`` keys may be mistaken: about as many others are left as there are keys."""
    return min(0.5, max(1e-6, n / n_others / math.sqrt(2))) if n_others else 0.5


def _encoded(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of ``n`` keys that lets through other keys at about ``rate``."""
    hashes = max(1, round(-math.log2(rate)))
    bits = _bits(n, rate)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            for p in positions(h1, h2, bits, hashes, seed):
                bit = np.uint64(1) << (p & np.uint64(63))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((p >> np.uint64(6)).view(np.int64)), pa.array(bit.view(np.int64))],
                    names=["word", "bit"],
                )

    words = np.zeros(bits // 64 + 1, np.uint64)
    found = (
        keys.mapInArrow(run, "word long, bit long")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()  # at most bits / 64 rows
    )
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Level(words, bits, hashes, seed)


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select(
        F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2")
    ).distinct()


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell the keys of ``listed`` from the other keys of ``universe`` (each one column ``key``)."""
    members = stage(_hashed(listed), "cascade-listed")
    others = stage(_hashed(universe).join(members, ["h1", "h2"], "left_anti"), "cascade-universe")
    return _levels(members, others)


def _levels(members: DataFrame, others: DataFrame) -> list[Level]:
    levels: list[Level] = []
    here, there = members, others
    n, n_there = here.count(), there.count()
    while n:
        rate = 0.5 if levels else _rate(n, n_there)
        levels.append(_encoded(here, n, rate, len(levels)))
        here, there = stage(_filtered(there, levels[-1]), "cascade-mistakes"), here
        n = here.count()
    return levels


@dataclass
class Cascade:
    """The levels for the keys whose hash falls into ``part`` of ``parts``, of the list ``name``."""

    name: str
    part: int
    parts: int
    levels: list[Level]

    def members(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which keys this cascade knows to be listed."""
        if not self.levels:
            return np.zeros(0, np.int64)
        own = np.flatnonzero(h1.view(np.uint64) % np.uint64(self.parts) == self.part)
        return own[in_cascade(self.levels, h1[own], h2[own])]

    @property
    def bits(self) -> int:
        return sum(level.bits for level in self.levels)


def cascades(listed: dict[str, DataFrame], universe: DataFrame) -> Iterator[list[Cascade]]:
    """Cascades of all lists, so many at a time as ``MAX_BITS`` holds (one at least)."""
    hashed = _hashed(universe)
    held: list[Cascade] = []
    for name, keys in listed.items():
        members = stage(_hashed(keys), "cascade-listed")
        others = stage(hashed.join(members, ["h1", "h2"], "left_anti"), "cascade-universe")
        n, n_others = members.count(), others.count()
        parts = -(-_bits(n, _rate(n, n_others)) // MAX_BITS) if n else 1
        # Of a negative hash the remainder as of the unsigned number.
        part_of = F.expr(f"pmod(pmod(h1, {parts}L) + if(h1 < 0, {(1 << 64) % parts}L, 0L), {parts}L)")
        for part in range(parts):
            own = [t if parts == 1 else t.where(part_of == part) for t in (members, others)]
            cascade = Cascade(name, part, parts, _levels(*own))
            if held and sum(c.bits for c in held) + cascade.bits > MAX_BITS:
                yield held
                held = []
            held.append(cascade)
    yield held


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(found, pattern, 1), _UPPER, _LOWER)
    return host, F.regexp_extract(found, pattern, 2)


def url_keys(host: Column, path: Column, labels: int, depth: int) -> Column:
    """The keys of a URL, longest first: up to ``labels`` labels of the host (and the whole host), ``depth`` slashes."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.least(F.size(parts), F.lit(labels)), F.lit(1), F.lit(-1)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    folders = F.split(path, "/", -1)
    prefixes = F.transform(
        F.sequence(F.least(F.size(folders) - 1, F.lit(depth)), F.lit(1), F.lit(-1)),
        lambda n: F.concat(F.array_join(F.slice(folders, 1, n), "/"), F.lit("/")),
    )
    keys = F.flatten(
        F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))
    )
    ordered = F.array_sort(
        keys,
        lambda a, b: F.coalesce(
            F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1), F.lit(0)
        ),
    )
    usable = (host != "") & path.startswith("/") & (F.lit(labels) > 0) & (F.lit(depth) > 0)
    return F.when(usable, ordered).otherwise(F.array().cast("array<string>"))


def filter_urls(
    pages: DataFrame,
    rules: dict[str, DataFrame],
    listed: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """A row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule`` (the longest rule that fits, else null), ``listed``
    (the longest listed key) and ``verdict``.

    ``rules`` has a table of keys (column ``key``, like ``example.org/docs/``) for each verdict, ``listed`` the keys that are
    blocked where no rule fits. Keys end in "/". A key in two tables goes by the first of them.
    """
    tables = {**rules, "": listed}
    every = None
    for table in tables.values():
        keys = table.select(F.col("key").cast("string").alias("key")).dropna()
        every = keys if every is None else every.unionAll(keys)
    labels, depth, bad = every.agg(
        F.coalesce(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\.", -1))), F.lit(0)),
        F.coalesce(F.max(F.size(F.split("key", "/", -1)) - 1), F.lit(0)),
        F.count_if(~F.col("key").rlike("^[^/]+/([^/]*/)*$")),
    ).first()
    if bad:
        raise ValueError(f"{bad} keys are not a host and a path that ends in '/'")
    host, path = host_and_path(F.col(f"`{url_column}`"))
    seen = pages.select(
        F.col(f"`{id_column}`").cast("long").alias("page_id"), host.alias("host"), path.alias("path")
    ).withColumn("keys", url_keys(F.col("host"), F.col("path"), labels, depth))
    universe = stage(seen.select(F.explode("keys").alias("key")).distinct(), "url-keys")
    listed_keys = {name: table.select(F.col("key").cast("string")).dropna() for name, table in tables.items()}
    judged = seen.select(
        "*",
        F.transform("keys", lambda k: F.xxhash64(k)).alias("h1"),
        F.transform("keys", lambda k: F.xxhash64(k, F.lit(1))).alias("h2"),
        F.lit(None).cast("int").alias("rule_at"),
        F.lit(None).cast("string").alias("ruled"),
        F.lit(None).cast("int").alias("listed_at"),
    )
    for k, part in enumerate(cascades(listed_keys, universe)):
        if k:
            judged = stage(judged, "url-judged")
        shared = pages.sparkSession.sparkContext.broadcast(part)
        judged = judged.mapInArrow(_judge(shared, list(rules)), judged.schema)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.get("keys", F.col("rule_at")).alias("rule"),
        F.get("keys", F.col("listed_at")).alias("listed"),
        F.coalesce("ruled", F.when(F.col("listed_at").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )


def _judge(shared: Broadcast, order: list[str]):
    """Adds what some cascades know: the longest listed key (the least place) of each page, and of the rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, h1, h2 = (batch.column(c) for c in ("keys", "h1", "h2"))
            first = keys.offsets.to_numpy()
            of_page = np.repeat(np.arange(len(batch)), np.diff(first))
            flat1, flat2 = h1.flatten().to_numpy(), h2.flatten().to_numpy()
            rule_at, listed_at, ruled = (batch.column(c).to_pylist() for c in ("rule_at", "listed_at", "ruled"))
            for cascade in shared.value:
                member = cascade.members(flat1, flat2)
                page, at = np.unique(of_page[member], return_index=True)
                places = member[at] - (first[page] - first[0])
                for i, k in zip(page.tolist(), places.tolist(), strict=True):
                    if not cascade.name:
                        listed_at[i] = k if listed_at[i] is None else min(k, listed_at[i])
                    elif rule_at[i] is None or (k, order.index(cascade.name)) < (rule_at[i], order.index(ruled[i])):
                        rule_at[i], ruled[i] = k, cascade.name
            now = {
                "rule_at": pa.array(rule_at, pa.int32()),
                "ruled": pa.array(ruled, pa.string()),
                "listed_at": pa.array(listed_at, pa.int32()),
            }
            yield pa.RecordBatch.from_arrays(
                [now.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names
            )

    return run


def family_keys(
    pages: DataFrame, families: tuple[str, ...] = FAMILIES, url_column: str = "url"
) -> DataFrame:
    """The keys of all sites of given families among the pages: hosts from the label that names a family on."""
    host, _ = host_and_path(F.col(f"`{url_column}`"))
    site = F.regexp_extract(host, rf"(?:^|\.)((?:{'|'.join(families)})(?:\..*)?$)", 1)
    return pages.select(F.concat(site, F.lit("/")).alias("key")).where("key <> '/'").distinct()


SQL = f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(key, verdict) AS (
  VALUES {", ".join(f"('{k}', '{v}')" for v, ks in RULES.items() for k in ks)}),
listed(key) AS (
  SELECT DISTINCT site || '/' FROM (
    SELECT array_to_string(list_slice(labels, list_min([list_position(labels, f) for f in {list(FAMILIES)}]), len(labels)), '.') AS site
    FROM (SELECT string_split(host, '.') AS labels FROM parts)
    WHERE list_has_any(labels, {list(FAMILIES)}))),
keyed AS (
  SELECT key, verdict, string_split(key, '/')[1] AS h, substr(key, strpos(key, '/')) AS p
  FROM (SELECT key, verdict FROM rules UNION ALL SELECT key, NULL FROM listed)),
fits AS (
  SELECT page_id, max_by(key, length(key)) FILTER (verdict IS NOT NULL) AS rule,
         max_by(verdict, length(key)) FILTER (verdict IS NOT NULL) AS ruled, bool_or(verdict IS NULL) AS listed
  FROM parts JOIN keyed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""
