"""Conversation repair against a search over all audits, and against plain strings for long conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from chatlens.llm import conversation_repair as cr
from chatlens.plans.adapters import table

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """Rows (conv_id, turn, role, text) after damage, by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        found = out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for found in out.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.strip(WHITE)
        again, _ = (role, text) in seen, seen.add((role, text))
        out.append("blank" if not end else "duplicate" if again else "truncated" if end[-1] not in ".!?" else "")
    return out


def outcome(rows, kinds, audit):
    """Cost and messages of an audit, None if it is not allowed."""
    cost, out, at = 0, [], 0
    first_kept_system = None
    for letter in audit:
        if letter == "I":
            cost += 5
            out.append((None, ""))
            continue
        if at == len(rows):
            return None
        (_, role, text), kind = rows[at], kinds[at]
        at += 1
        if letter == "D":
            cost += 2
            continue
        if kind in ("blank", "duplicate"):
            return None
        cost += (letter == "R") + 5 * (kind == "truncated")
        out.append((role if letter == "K" else None, text))
    if at < len(rows):
        return None
    first_kept_system = bool(out) and out[0][0] is not None and out[0][0][:1] == "s"
    turn, messages = 0, []
    for role, text in out[first_kept_system:]:
        want = ("user", "assistant")[turn % 2]
        if role is not None and role[:1] != want[0]:
            return None
        messages.append((role if role is not None else want, text))
        turn += 1
    if turn % 2 or first_kept_system and not turn:
        return None
    return cost, [out[0]] + messages if first_kept_system else messages


def search(rows, kinds):
    """Least cost and audit of all audits that cost no more than deleting everything."""
    best = None

    def go(audit, at, cost):
        nonlocal best
        if cost > 2 * len(rows):
            return
        if at == len(rows):
            found = outcome(rows, kinds, audit)
            if found is not None and (best is None or (found[0], audit) < best[:2]):
                best = (found[0], audit, found[1])
        else:
            for letter, price in (("K", 0), ("R", 1), ("D", 2)):
                go(audit + letter, at + 1, cost + price)
        go(audit + "I", at, cost + 5)

    go("", 0, 0)
    return best


def forward(rows, kinds):
    """The same by the best (cost, audit) per state, on strings."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def put(best, state, value):
        if state is not None and (state not in best or value < best[state]):
            best[state] = value

    def inserts(best):
        for _ in range(3):
            for s, (c, t) in list(best.items()):
                for x in "ua":
                    put(best, step.get((s, x)), (c + 5, t + "I"))
        return best

    best = inserts({0: (0, "")})
    for (_, role, _), kind in zip(rows, kinds, strict=True):
        now = {}
        for s, (c, t) in best.items():
            put(now, s, (c + 2, t + "D"))
            if kind not in ("blank", "duplicate"):
                c += 5 * (kind == "truncated")
                put(now, step.get((s, role[:1])), (c, t + "K"))
                for x in "ua":
                    put(now, step.get((s, x)), (c + 1, t + "R"))
        best = inserts(now)
    cost, audit = min(best[s] for s in (0, 3) if s in best)
    return cost, audit, outcome(rows, kinds, audit)[1]


def expected(rows, solve):
    out = {}
    for conv, found in damaged(rows).items():
        kinds = faults(found)
        turns = [t for t, *_ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:])]
        cost, audit, messages = solve(found, kinds)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()
        counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out[conv] = (conv, gaps, *counts, illegal, cost, audit, digest)
    return out


def result(spark, rows, **limits):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r.conv_id: tuple(r) for r in cr.repair(cr.damage(df), **limits).collect()}


def random_rows(seed, conversations, longest):
    rnd = random.Random(seed)
    texts = ["a.", "b!", "c", " ", "", "long text here?", "x.\n", None, "é."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", None, ""]
    rows = []
    for conv in range(conversations):
        turn = rnd.randrange(-2, 3)
        for _ in range(rnd.randrange(1, longest + 1)):
            turn += rnd.choice([1, 1, 1, 2, 0])
            rows.append((conv or None, rnd.choice([turn] * 9 + [None]), rnd.choice(roles), rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"piece_rows": 1}, {"piece_rows": 2}, {"piece_bytes": 6}])
def test_repair_by_search(spark, limits):
    rows = random_rows(3, 150, 6)
    want = expected(rows, search)
    assert want == expected(rows, forward)
    assert result(spark, rows, **limits) == want


def test_long_conversation_in_pieces(spark):
    rnd = random.Random(8)
    roles, texts = ["user", "assistant", "user", "assistant", "system"], [f"t{i}." for i in range(500)] + ["cut", " "]
    rows = [(1, i // 2, rnd.choice(roles), rnd.choice(texts)) for i in range(3000)] + random_rows(4, 40, 30)[30:]
    want = expected(rows, forward)
    for limits in ({}, {"piece_rows": 37}):
        assert result(spark, rows, **limits) == want


def test_repair_on_odd_tables(spark):
    rows = [(5, 0, "user", "x" * 300_000 + "."), (5, 1, "assistant", "y."), (None, None, None, None), (6, None, "user", "a.")]
    rows += [(7, 3, "user", "same."), (7, 3, "user", "same."), (7, 4, "assistant", "b.")]
    clash = spark.createDataFrame([(*r, "g", 1, True) for r in rows], SCHEMA + ", grp string, part int, gone boolean")
    got = {r.conv_id: tuple(r) for r in cr.repair(cr.damage(clash)).collect()}
    assert got == expected(rows, forward)
    assert cr.repair(cr.damage(clash.limit(0))).count() == 0
    dropped = next((c, t) for c in range(999) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    row = result(spark, [(*dropped, "user", "a.")])[dropped[0]]
    assert row == (dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_messages_alternate(spark, sf_dir):
    damaged_rows = cr.damage(table(spark, sf_dir, "conversations"))
    sums = {r.conv_id: r.repaired_sha256 for r in cr.repair(damaged_rows).collect()}
    for limits in ({}, {"piece_rows": 2}):
        found = defaultdict(list)
        for r in cr.repaired_messages(damaged_rows, **limits).orderBy("conv_id", "part", "no", "at").collect():
            found[r.conv_id].append((r.role, r.text))
        for conv, digest in sums.items():
            assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in found[conv]))
            assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in found[conv]).encode()).hexdigest() == digest


def test_audits_compare_as_strings():
    rnd = random.Random(2)
    audits, texts = cr.Audits(), [""]
    for _ in range(400):
        parent = rnd.randrange(max(0, len(texts) - 30), len(texts))
        letter = rnd.choice("DIKR" if rnd.random() < 0.3 else "K")
        assert audits.add(parent, letter) == len(texts)
        texts.append(texts[parent] + letter)
    for _ in range(3000):
        a, b = rnd.randrange(len(texts)), rnd.randrange(len(texts))
        assert audits.less(a, b) == (texts[a] < texts[b]) and audits.same(a, b) == (texts[a] == texts[b])
        assert audits.text(a) == texts[a]


def test_audits_with_one_hash_compare_right(monkeypatch):
    monkeypatch.setattr(cr, "_MOD", 7)
    test_audits_compare_as_strings()
