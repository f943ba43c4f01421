"""Repair of conversation structure: faults of messages, and the cheapest edits that make roles alternate.

Messages of a conversation are read in order. A message is blank, a duplicate, truncated, or sound; an edit keeps it, gives it
another role, deletes it, or inserts an empty message anywhere, so that the roles' initials read ``(s?(ua)+)?``. Of the cheapest
audits (one letter per edit: K, R, D, I) the least in ASCII order is taken; an audit determines the roles it gives.

The dynamic program keeps one best audit per state of that pattern. Audits are linked nodes that share their prefixes: a node
knows its parent, its ancestors at powers of two, and a rolling hash. Of two audits of equal cost the lesser is found by
a search for the longest common prefix over the ancestors' hashes; equal hashes are verified letter by letter. Of two audits
with the same cost and state neither is a prefix of the other (an audit fixes its cost and state), so prefixes can be chosen
greedily. States after equal sequences of faults and roles are shared by all conversations of a task.

Messages are sorted in ranges, so a long conversation lies in several tasks. What a task holds whole and in at most
``PIECE_ROWS`` messages or ``PIECE_BYTES`` is solved there. The rest is cut into pieces: duplicates are found by a grouped
minimum over digests, each piece maps entry states to exit states with cost and audit, a pass in order composes the maps, and
the pieces are repaired apart. That pass sees letters, not texts; the checksum of a conversation is sequential by its
definition and reads its repaired pieces in one task, one piece at a time.

Defined cases: nulls of role and text are one space (so a null text is blank), a null turn stands first and is no turn for
``gaps``, null conversation ids are one conversation; equal turns go by a digest of role and text; a message of any length is a
piece at most; an empty table gives no rows; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.places import sorted_rows
from chatlens.llm.shared import stage

PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20
#: Nodes of audits that a task keeps before it starts afresh.
MAX_NODES = 1 << 18
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

#: States: nothing yet, after system, after user, after assistant; what initials lead where.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (EMPTY, ASSISTANT)
GIVEN = {USER: ("a", "assistant")} | dict.fromkeys((EMPTY, SYSTEM, ASSISTANT), ("u", "user"))
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5

_BASE, _MOD = 1_000_003, (1 << 61) - 1


class Audits:
    """Audits as nodes; node 0 is the empty one."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, parent: int, letter: str) -> int:
        up, k = [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % _MOD)
        self.up.append(tuple(up))
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two audits are equal, letter by letter back to where they are one node."""
        while a != b:
            if self.letter[a] != self.letter[b] or self.depth[a] != self.depth[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit ``a`` stands before ``b`` in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y] and self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.letter[x] == self.letter[y] or not self.same(self.up[x][0], self.up[y][0]):
            return self.text(a) < self.text(b)  # two audits with one hash
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


class Reached:
    """What is best after some messages: per state the cost and audit, or None. ``after`` holds what follows by message."""

    __slots__ = ("best", "after", "answer")

    def __init__(self, best: list):
        self.best, self.after, self.answer = best, {}, None


class Repairs:
    """The dynamic program; messages are (initial, deleted, truncated)."""

    def __init__(self):
        self._fresh()

    def _fresh(self) -> None:
        self.audits = Audits()
        self.roots = {}

    def _offer(self, best: list, state: int, cost: int, parent: int, letter: str) -> bool:
        have = best[state]
        if have is not None and have[0] < cost:
            return False
        node = self.audits.add(parent, letter)
        if have is None or cost < have[0] or self.audits.less(node, have[1]):
            best[state] = cost, node
            return True
        return False

    def _inserts(self, best: list) -> list:
        changed = True
        while changed:
            changed = False
            for state in range(4):
                if best[state] is not None:
                    cost, node = best[state]
                    to = STEP[state, GIVEN[state][0]]
                    changed |= self._offer_insert(best, to, cost + COST["I"], node)
        return best

    def _offer_insert(self, best: list, state: int, cost: int, node: int) -> bool:
        have = best[state]
        if have is not None and have[0] == cost and self.audits.letter[have[1]] == "I" and self.audits.up[have[1]][0] == node:
            return False  # it is there already
        return self._offer(best, state, cost, node, "I")

    def _next(self, reached: Reached, message: tuple[str, bool, bool]) -> Reached:
        initial, deleted, truncated = message
        more = TRUNCATED_COST if truncated else 0
        best: list = [None] * 4
        for state in range(4):
            if reached.best[state] is None:
                continue
            cost, node = reached.best[state]
            self._offer(best, state, cost + COST["D"], node, "D")
            if deleted:
                continue
            if (state, initial) in STEP:
                self._offer(best, STEP[state, initial], cost + COST["K"] + more, node, "K")
            self._offer(best, STEP[state, GIVEN[state][0]], cost + COST["R"] + more, node, "R")
        return Reached(self._inserts(best))

    def _through(self, entry: int, messages: list[tuple]) -> Reached:
        if len(self.audits.letter) > MAX_NODES:
            self._fresh()
        if entry not in self.roots:
            self.roots[entry] = Reached(self._inserts([(0, 0) if s == entry else None for s in range(4)]))
        at = self.roots[entry]
        for message in messages:
            following = at.after.get(message)
            if following is None:
                following = at.after[message] = self._next(at, message)
            at = following
        return at

    def audit(self, messages: list[tuple]) -> tuple[int, str]:
        """Cost and letters of the best audit of a whole conversation."""
        end = self._through(EMPTY, messages)
        if end.answer is None:
            ends = [end.best[s] for s in FINAL if end.best[s] is not None]
            cost, node = ends[0]
            for other in ends[1:]:
                if other[0] < cost or other[0] == cost and self.audits.less(other[1], node):
                    cost, node = other
            end.answer = cost, self.audits.text(node)
        return end.answer

    def through(self, messages: list[tuple]) -> tuple[list[int | None], list[str | None]]:
        """Costs and audits from each state to each state, 16 of them."""
        costs, audits = [], []
        for entry in range(4):
            for end in self._through(entry, messages).best:
                costs.append(None if end is None else end[0])
                audits.append(None if end is None else self.audits.text(end[1]))
        return costs, audits


def repaired(messages: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str, str]]:
    """Role, text and edit of what an audit leaves of (role, text) messages, entered in a state."""
    out, rows = [], iter(messages)
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        initial, given = GIVEN[state]
        if letter == "K":
            initial = role[:1]
        else:
            role = given
        out.append((role, text, letter))
        state = STEP[state, initial]
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with a fifth of the messages damaged; ``gone`` marks those dropped.

    The CRC-32 of ``conv_id:turn`` modulo 20 decides: 0 drops the message, 1 empties its text, 2 removes the ends of its
    sentences, 3 repeats it, 4 makes the user its speaker.
    """
    conv, turn = (F.col(f"`{c}`").cast("long") for c in ("conv_id", "turn"))
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)])
    kind = F.crc32(key) % 20
    return (
        conversations.select(
            conv.alias("conv_id"),
            turn.alias("turn"),
            F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
            F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
            (kind == 0).alias("gone"),
            F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
        )
    ).drop("copy")


def _with_faults(messages: DataFrame) -> DataFrame:
    """Adds ``grp``, ``tie`` and what a message's own text says: ``blank``, ``cut``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    end = F.rtrim(text, F.lit(WHITE))
    gone = F.col("gone") if "gone" in messages.columns else F.lit(False)
    return messages.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("grp"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat_ws(":", role, text)).alias("tie"),
        role.alias("role"),
        text.alias("text"),
        gone.alias("gone"),
        (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(*ENDS)).alias("cut"),
    )


ROWS = "array<struct<turn:long,role:string,text:string,gone:boolean,blank:boolean,cut:boolean>>"
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
RESULTS = [f.split()[0] for f in RESULT.split(", ")]
MESSAGES = "array<struct<role:string,text:string,edit:string>>"
PIECES = f"grp string, part int, no int, rows {ROWS}, {RESULT}, messages {MESSAGES}"


def _lines(messages: list[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text, _ in messages)


class Facts:
    """What is counted of messages in order; of two runs in order the second is added to the first."""

    def __init__(self, rows: list[dict], duplicates: list[bool]):
        rows = [(r, d) for r, d in zip(rows, duplicates, strict=True) if not r["gone"]]
        turns = [r["turn"] for r, _ in rows if r["turn"] is not None]
        self.first_turn, self.last_turn = (turns[0], turns[-1]) if turns else (None, None)
        self.turns = len(set(turns))
        initials = [r["role"][:1] for r, _ in rows]
        self.first, self.last = (initials[0], initials[-1]) if initials else (None, None)
        pairs = [a + b for a, b in zip(initials, initials[1:], strict=False)]
        self.illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        self.blank = sum(r["blank"] for r, _ in rows)
        self.duplicate = sum(d and not r["blank"] for r, d in rows)
        self.truncated = sum(r["cut"] and not r["blank"] and not d for r, d in rows)

    def add(self, other: "Facts") -> None:
        if other.first_turn is not None:
            self.turns += other.turns - (self.last_turn == other.first_turn)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn
        if other.first is not None:
            if self.last is not None:
                self.illegal += self.last + other.first not in ("su", "ua", "au")
            self.first = other.first if self.first is None else self.first
            self.last = other.last
        for name in ("illegal", "blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def counts(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _symbols(rows: list[dict], duplicates: list[bool]) -> list[tuple]:
    out = []
    for r, d in zip(rows, duplicates, strict=True):
        if not r["gone"]:
            deleted = r["blank"] or d
            out.append(("", True, False) if deleted else (r["role"][:1], False, r["cut"]))
    return out


def _kept(rows: list[dict]) -> list[tuple[str, str]]:
    return [(r["role"], r["text"]) for r in rows if not r["gone"]]


def _solved(rows: list[dict], repairs: Repairs) -> tuple[list, list]:
    """Result columns after ``conv_id``, and the repaired messages, of a whole conversation."""
    seen, duplicates = set(), []
    for r in rows:
        key = r["role"], r["text"]
        duplicates.append(not r["gone"] and key in seen)
        if not r["gone"]:
            seen.add(key)
    cost, audit = repairs.audit(_symbols(rows, duplicates))
    messages = repaired(_kept(rows), audit, EMPTY)
    digest = hashlib.sha256(_lines(messages).encode()).hexdigest()
    return [*Facts(rows, duplicates).counts(), cost, audit, digest], messages


def _cut(messages: DataFrame, piece_rows: int, piece_bytes: int, with_messages: bool) -> DataFrame:
    """A row per conversation that one task holds whole (its result), and per piece of the others (its messages)."""
    schema = _arrow_schema(messages.sparkSession, PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, repairs = TaskContext.get().partitionId(), Repairs()
        out, size = [], 0
        group, conv, rows, no, filled, opens = None, None, [], 0, 0, True

        def piece() -> dict:
            return {"grp": group, "conv_id": conv, "part": part, "no": no, "rows": rows}

        def closed() -> dict:
            """The conversation that ends inside the task."""
            if opens or no:  # it may have begun in the task before, or is cut already
                return piece()
            result, messages = _solved(rows, repairs)
            found = dict(zip(RESULTS, [conv, *result], strict=True)) | {"grp": group}
            if with_messages:
                found["messages"] = [dict(zip(("role", "text", "edit"), m, strict=True)) for m in messages]
            return found

        for batch in batches:
            for row in batch.to_pylist():
                if row["grp"] != group:
                    if group is not None:
                        out.append(closed())
                        opens = False
                    group, conv, rows, no, filled = row["grp"], row["conv_id"], [], 0, 0
                elif len(rows) >= piece_rows or filled >= piece_bytes:
                    out.append(piece())
                    rows, no, filled = [], no + 1, 0
                rows.append(row)
                filled += len(row["text"]) + len(row["role"])
                size += len(row["text"])
                if size >= piece_bytes or len(out) >= piece_rows:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if group is not None:
            out.append(piece())  # it may go on in the next task
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    ranged = sorted_rows(messages, "grp", ["turn", "tie"])
    return stage(ranged.mapInArrow(run, PIECES), "repair-pieces")


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    return spark.createDataFrame([], ddl).toArrow().schema


def _first_seen(pieces: DataFrame) -> DataFrame:
    """Of each piece (``grp``, ``part``, ``no``) the numbers (``firsts``) of messages that their conversation has for the first time."""
    rows = pieces.select("grp", "part", "no", F.posexplode("rows").alias("at", "row")).where("not row.gone")
    key = F.sha2(F.concat(F.length("row.role").cast("string"), F.lit(":"), F.col("row.role"), F.col("row.text")), 256)
    order = F.col("part").cast("long") * (1 << 40) + F.col("no").cast("long") * (1 << 20) + F.col("at")
    first = rows.groupBy("grp", key.alias("key")).agg(F.min(order).alias("first"))
    place = F.col("first")
    return first.groupBy(
        "grp",
        F.shiftright(place, 40).cast("int").alias("part"),
        (F.shiftright(place, 20) % (1 << 20)).cast("int").alias("no"),
    ).agg(F.collect_list((place % (1 << 20)).cast("int")).alias("firsts"))  # at most a piece's rows


MAPS = (
    "grp string, conv_id long, part int, no int, facts struct<first_turn:long,last_turn:long,turns:long,first:string,"
    "last:string,illegal:long,blank:long,duplicate:long,truncated:long>, costs array<long>, audits array<string>"
)
CHOSEN = f"grp string, part int, no int, entry int, segment string, {RESULT}"


def _maps(pieces: DataFrame) -> DataFrame:
    """Facts of each piece, and cost and audit from each state to each state."""
    schema = _arrow_schema(pieces.sparkSession, MAPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairs = Repairs()
        for batch in batches:
            out = []
            for piece in batch.to_pylist():
                firsts = set(piece["firsts"] or ())
                duplicates = [not r["gone"] and i not in firsts for i, r in enumerate(piece["rows"])]
                costs, audits = repairs.through(_symbols(piece["rows"], duplicates))
                facts = vars(Facts(piece["rows"], duplicates))
                found = {k: piece[k] for k in ("grp", "conv_id", "part", "no")}
                out.append(found | {"facts": facts, "costs": costs, "audits": audits})
            yield pa.RecordBatch.from_pylist(out, schema)

    return pieces.mapInArrow(run, MAPS)


class _Rope:
    """An audit over pieces: the rope before, and what it takes in the last piece."""

    __slots__ = ("before", "entry", "segment", "depth", "place")

    def __init__(self, before, entry: int, segment: str, place):
        self.before, self.entry, self.segment, self.place = before, entry, segment, place
        self.depth = 0 if before is None else before.depth + 1

    def since(self, other) -> tuple[str, str]:
        """The letters of two ropes over the same pieces after what they share."""
        a, b, mine, theirs = self, other, [], []
        while a is not b:
            mine.append(a.segment)
            theirs.append(b.segment)
            a, b = a.before, b.before
        return "".join(reversed(mine)), "".join(reversed(theirs))

    def less(self, other) -> bool:
        a, b = self.since(other)
        return a < b


def _composed(maps: DataFrame) -> DataFrame:
    """Per piece how it is entered and what is done in it; per conversation its result without the checksum."""
    schema = _arrow_schema(maps.sparkSession, CHOSEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, conv, facts, best = None, None, None, None

        def closed() -> Iterator[pa.RecordBatch]:
            ends = [best[s] for s in FINAL if best[s] is not None]
            cost, rope = ends[0]
            for other in ends[1:]:
                if other[0] < cost or other[0] == cost and other[1].less(rope):
                    cost, rope = other
            out = []
            while rope.before is not None:
                part, no = rope.place
                out.append({"grp": group, "part": part, "no": no, "entry": rope.entry, "segment": rope.segment})
                rope = rope.before
            audit = "".join(x["segment"] for x in reversed(out))
            result = dict(zip(RESULTS[:-1], [conv, *facts.counts(), cost, audit], strict=True))
            yield pa.RecordBatch.from_pylist([{"grp": group} | result], schema)
            for first in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist(out[first : first + 256], schema)

        for batch in batches:
            for row in batch.to_pylist():
                own = Facts([], [])
                vars(own).update(row["facts"])
                if row["grp"] != group:
                    if group is not None:
                        yield from closed()
                    group, conv, facts = row["grp"], row["conv_id"], own
                    best = [(0, _Rope(None, EMPTY, "", None)), None, None, None]
                else:
                    facts.add(own)
                now: list = [None] * 4
                for entry in range(4):
                    for end in range(4):
                        cost, segment = row["costs"][4 * entry + end], row["audits"][4 * entry + end]
                        if best[entry] is None or cost is None:
                            continue
                        total = best[entry][0] + cost
                        if now[end] is not None and now[end][0] < total:
                            continue
                        rope = _Rope(best[entry][1], entry, segment, (row["part"], row["no"]))
                        if now[end] is None or total < now[end][0] or rope.less(now[end][1]):
                            now[end] = total, rope
                best = now
        if group is not None:
            yield from closed()

    order = ["grp", "part", "no"]
    return maps.repartition("grp").sortWithinPartitions(*order).mapInArrow(run, CHOSEN)


def _repaired_pieces(pieces: DataFrame, chosen: DataFrame) -> DataFrame:
    """``grp``, ``part``, ``no`` and the repaired ``messages`` of each piece."""
    kinds = f"grp string, conv_id long, part int, no int, messages {MESSAGES}"
    schema = _arrow_schema(pieces.sparkSession, kinds)
    wanted = chosen.where("segment is not null").select("grp", "part", "no", "entry", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                found = repaired(_kept(piece["rows"]), piece["segment"], piece["entry"])
                messages = [dict(zip(("role", "text", "edit"), m, strict=True)) for m in found]
                row = {k: piece[k] for k in ("grp", "conv_id", "part", "no")} | {"messages": messages}
                yield pa.RecordBatch.from_pylist([row], schema)

    joined = pieces.select("grp", "conv_id", "part", "no", "rows").join(wanted, ["grp", "part", "no"])
    return joined.mapInArrow(run, kinds)


def _checksums(repaired_pieces: DataFrame) -> DataFrame:
    """``grp`` and ``repaired_sha256``; the pieces of a conversation pass one after the other."""
    kinds = "grp string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest, any_ = None, None, False

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"grp": group, "repaired_sha256": digest.hexdigest()}])

        for batch in batches:
            for i in range(len(batch)):
                (row,) = batch.slice(i, 1).to_pylist()
                if row["grp"] != group:
                    if group is not None:
                        yield closed()
                    group, digest, any_ = row["grp"], hashlib.sha256(), False
                for message in row["messages"]:
                    line = f"{message['role']}:{message['text']}"
                    digest.update((f"\n{line}" if any_ else line).encode())
                    any_ = True
        if group is not None:
            yield closed()

    ordered = repaired_pieces.repartition("grp").sortWithinPartitions("grp", "part", "no")
    return ordered.select("grp", "messages").mapInArrow(run, kinds)


def _repair(messages: DataFrame, piece_rows: int, piece_bytes: int, with_messages: bool):
    rows = _cut(_with_faults(messages), piece_rows, piece_bytes, with_messages)
    pieces = rows.where("rows is not null")
    joined = pieces.select("grp", "conv_id", "part", "no", "rows").join(
        stage(_first_seen(pieces), "repair-firsts"), ["grp", "part", "no"], "left"
    )
    chosen = stage(_composed(stage(_maps(joined), "repair-maps")), "repair-chosen")
    return rows, pieces, chosen


def repair(messages: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A row per conversation: counts of faults, ``cost`` and letters of the best ``audit``, checksum of what it leaves.

    ``messages`` has ``conv_id``, ``turn``, ``role``, ``text``, and optionally ``gone`` for messages that only name their
    conversation.
    """
    rows, pieces, chosen = _repair(messages, piece_rows, piece_bytes, False)
    sums = _checksums(_repaired_pieces(pieces, chosen))
    long_ones = chosen.where("segment is null").drop("repaired_sha256").join(stage(sums, "repair-sums"), "grp")
    return rows.where("rows is null").select(*RESULTS).unionByName(long_ones.select(*RESULTS))


def repaired_messages(messages: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The messages that the best audits leave: ``conv_id``, ``part``, ``no``, ``at`` (in order), ``role``, ``text``, ``edit``."""
    rows, pieces, chosen = _repair(messages, piece_rows, piece_bytes, True)
    whole = rows.where("rows is null").select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("no"), "messages")
    cut = _repaired_pieces(pieces, chosen).select("conv_id", "part", "no", "messages")
    found = whole.unionByName(cut).select("conv_id", "part", "no", F.posexplode("messages").alias("at", "m"))
    return found.select("conv_id", "part", "no", "at", "m.role", "m.text", "m.edit")


_SQL_CRC = """xor(list_reduce(
    flatten([[(ascii(c)::BIGINT >> k) & 1 for k in range(8)] for c in string_split(key, '')]),
    lambda r, b: xor(r >> 1, 3988292384 * (xor(r, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"""


def _sql_edit(state: str, letter: str, cost: str, line: str | None = None, when: str = "true") -> str:
    """A state's audit (cost ``c``, letters ``t``, lines ``o``) with one more edit; null where it cannot be."""
    lines = f"{state}.o" if line is None else f"list_append({state}.o, {line})"
    return (
        f"CASE WHEN {state} IS NOT NULL AND ({when}) THEN "
        f"{{'c': {state}.c + {cost}, 't': {state}.t || '{letter}', 'o': {lines}}} END"
    )


def _sql_message(state: str, initial: str, given: str) -> list[str]:
    """Keep and new role of a message from a state."""
    more = "CASE WHEN cut THEN 5 ELSE 0 END"
    return [
        _sql_edit(state, "K", more, "role || ':' || text", f"NOT gone AND left(role, 1) = '{initial}'"),
        _sql_edit(state, "R", f"1 + {more}", f"'{given}:' || text", "NOT gone"),
    ]


def _sql_least(options: list[str]) -> str:
    return f"list_min([{', '.join(options)}])"


SQL = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT *, {_SQL_CRC} % 20 AS kind FROM given),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text)) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM numbered),
faults AS (
  SELECT *, trimmed = '' AS blank, trimmed <> '' AND again AS duplicate,
    trimmed <> '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') AS cut, trimmed = '' OR again AS gone,
    i > 1 AND lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS odd
  FROM seen),
convs AS (SELECT DISTINCT conv_id FROM conversations),
runs AS (
  SELECT conv_id, 0 AS i, {{'c': 0, 't': '', 'o': CAST([] AS VARCHAR[])}} AS e,
    CAST(NULL AS STRUCT(c INTEGER, t VARCHAR, o VARCHAR[])) AS s, {{'c': 5, 't': 'I', 'o': ['user:']}} AS u,
    {{'c': 10, 't': 'II', 'o': ['user:', 'assistant:']}} AS a FROM convs
  UNION ALL
  SELECT conv_id, i, e, s, u, {_sql_least(["a", _sql_edit("u", "I", "5", "'assistant:'")])} FROM (
    SELECT conv_id, i, e, s, a,
      {_sql_least(["u", *[_sql_edit(x, "I", "5", "'user:'") for x in "esa"]])} AS u FROM (
      SELECT r.conv_id, f.i, {_sql_edit("e", "D", "2")} AS e,
        {_sql_least([_sql_edit("s", "D", "2"), _sql_message("e", "s", "")[0]])} AS s,
        {_sql_least([_sql_edit("u", "D", "2"), *[o for x in "esa" for o in _sql_message(x, "u", "user")]])} AS u,
        {_sql_least([_sql_edit("a", "D", "2"), *_sql_message("u", "a", "assistant")])} AS a
      FROM runs r JOIN faults f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1))),
ends AS (
  SELECT conv_id, arg_max({{'x': {_sql_least(["e", "a"])}}}, i) AS best, max(i) AS n FROM runs GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (odd) AS illegal FROM faults GROUP BY conv_id)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, CAST(e.best.x.c AS BIGINT) AS cost,
  e.best.x.t AS audit, sha256(array_to_string(e.best.x.o, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
