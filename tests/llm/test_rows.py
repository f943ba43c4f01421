"""Operators that judge each row by itself: quality rules, licences, token counts, and the secrets' base spans."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from oracle import connect, difference

from chatlens.llm import license_templates, quality_rules, secret_ownership, token_transducer
from chatlens.llm.blocks import blocks
from chatlens.llm.queries import ORACLES, QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


def test_rules_on_odd_rows(odd, none):
    rows = {r.doc_id: r for r in quality_rules.judge(odd).collect()}
    assert quality_rules.judge(odd).count() == odd.count() and quality_rules.judge(none).count() == 0
    assert (rows[1].n_words, rows[3].n_words, rows[7].n_words) == (0, 0, 1)
    assert rows[1].base_failed and not rows[1].kept and rows[7].word_chars == 70_000
    # Its words come again after 97 * 89 of them.
    assert rows[5].n_words == rows[5].n_repeat_words == 60_000 and rows[5].base_failed


def test_repeated_windows(make):
    texts = ["a b c a b c", "a a a a", "a b c d", "a b c x a b c y z", "a b"]
    got = [r.n_repeat_words for r in quality_rules.metrics(make(texts)).orderBy("doc_id").collect()]
    assert got == [6, 4, 0, 6, 0]


def test_templates():
    auto = license_templates.Automaton(
        "Licensed <<beginOptional>>strictly<<beginOptional>> only<<endOptional>><<endOptional>> under <<var;name=x;words=1-2>> v1"
    )
    run = lambda text: auto.longest(license_templates.words_of(text), 0)
    assert run("licensed under MIT v1") == 4
    assert run("Licensed strictly only under the MIT, v1!") == 7
    assert run("licensed only under MIT v1") == 0
    assert run("licensed under v1") == 0 and run("licensed under a b c v1") == 0
    with pytest.raises(ValueError):
        license_templates.Automaton("a <<beginOptional>> b")
    with pytest.raises(ValueError):
        license_templates.Automaton("<<beginOptional>>a<<endOptional>>")


def test_licences_by_brute_force(documents, texts):
    phrases = [(p.split(), label) for p, label in license_templates.PHRASES]
    for r in license_templates.scan_licenses(documents).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id])
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at = [(i, label) for i in range(len(words)) for p, label in phrases if words[i : i + len(p)] == p]
        places = [i for i, _ in at]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == (min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licences_on_odd_rows(odd, none):
    rows = license_templates.scan_licenses(odd).collect()
    assert len(rows) == odd.count() and license_templates.scan_licenses(none).count() == 0
    assert all(r.score == 0 and r.first_word is None for r in rows)


def test_whole_licence(make):
    text = dict(license_templates.TEMPLATES)["text:isc"].upper()
    (row,) = license_templates.scan_licenses(make([text])).collect()
    assert row.labels == "text:isc" and row.score == 1 and len(row.spans) == 1


def test_token_counts(spark, documents, texts, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counted = token_transducer.count_tokens(documents, MODEL)
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == {
        i: len(library.encode(t)) for i, t in texts.items()
    }
    want = sorted((len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in odd.collect())
    rows = token_transducer.count_tokens(odd, MODEL).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    assert token_transducer.count_tokens(none, MODEL).count() == 0


def _counts(machine, texts, limit=1 << 20):
    return [n for b in blocks(pa.array(texts, pa.string()), limit) for n in machine.count(b).tolist()]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_transducer_over_chunks_and_emptied(library, monkeypatch):
    machine = token_transducer.Transducer(MODEL)
    odd = ["a", " a", "\n", "a\n\nb", " " * 3000 + "a", "é" * 700 + " b", "x" * 600 + "y z", "word " * 400, "\r\n\t a"]
    want = [len(x) for x in library.encode(odd)]
    for limit in (1, 64, 1 << 20):
        machine.transitions = token_transducer.MAX_TRANSITIONS + 1
        assert _counts(machine, odd, limit) == want
    # Windows that cut words and characters, the machine emptied between them.
    monkeypatch.setattr(token_transducer, "MAX_TRANSITIONS", 5)
    for window in (1, 7, 300):
        monkeypatch.setattr(token_transducer, "_WINDOW", window)
        assert _counts(machine, odd, 64) == want


def test_transducer_by_fuzz(library):
    """Random texts with U+2581, special strings, unknown characters; 20,000 of them."""
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "▁", "\n", "é", "😀", "x", "the", "ing", " th", "1", "22", ".", "\t", "\x00", "<s>", "</s>"]
    parts += ["<0x41>", "\r", "中", "ſ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(20_000)]
    assert _counts(token_transducer.machine_of(MODEL), texts) == [len(x) for x in library.encode(texts)]
    assert _counts(token_transducer.machine_of(MODEL), ["  ▁  x"]) == [2]


def test_transducer_on_long_texts(library):
    rng, machine = np.random.default_rng(1), token_transducer.machine_of(MODEL)
    digits = "".join(rng.choice(list("0123456789abcdef"), 10_000_000))
    words = " ".join(digits[i : i + 100] for i in range(0, len(digits), 100))
    for text in (words, "x" * 2_000_001, ("abcdefg" * 14)[:97] * 9000, "▁ " * 300_000):
        want = len(library.encode(text)) if len(text) < 3_000_000 else None
        (got,) = _counts(machine, [text])
        if want is None:  # by words, as pieces never reach over spaces
            base = len(library.encode("\n"))
            want = sum(len(x) - base for x in library.encode(["\n " + w for w in text.split(" ")]))
        assert got == want
    (got,) = _counts(machine, [" ".join([words] * 3)])
    assert got == 3 * _counts(machine, [words])[0]


def test_weights_are_on_the_transitions(library):
    """The weights on the way of a text add up to its tokens, byte by byte, whatever was read before."""
    machine = token_transducer.Transducer(MODEL)
    for text in ("internationalisation", "the rain in Spain", "é中😀a"):
        state, total = token_transducer.INITIAL, 0
        for k, byte in enumerate((" " + text).encode()):
            state, weight = machine.after(state, byte)
            total += weight
            if not state[3] and k:
                prefix = (" " + text).encode()[: k + 1].decode()
                assert total == len(library.encode(prefix[1:]))


def _base(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(secret_ownership.BASE):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(found)


def test_secrets_by_brute_force(documents, texts):
    for r in secret_ownership.scan_secrets(documents).collect():
        base = _base(texts[r.doc_id])
        kinds = Counter(x[3] for x in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        listed = [x[2] for x in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in kinds] == listed


def test_secret_spans():
    found = lambda t: [(k, s, e) for s, k, e, _ in secret_ownership.candidates(t)]
    assert found("ü API_Key: 'abcdefghijkl'") == [("assign", 2, 24)]
    assert found("token=token=abcdefabcdef") == [("assign", 0, 24)]
    assert found("token=short AKIA1234 abcdef") == []
    assert found("ſecret=abcdefghijklmno") == []
    assert found("AKIAABCDEFGHIJKLMN 0123456789abcdef") == [("access", 0, 18), ("hex", 19, 35)]


def test_ownership_decides(make):
    value = "zQ9xK2mB7vL4nR8tW1yP5c"
    texts = [f"see {value} here", "nothing", None, "", f"only {value[::-1]} ok"]
    copied = [f"see {value} here"] * 6
    one = {r.doc_id: r for r in secret_ownership.scan_secrets(make(texts)).collect()}
    assert one[0].spans == "random:4:26" and one[0].n_live == 1 and one[2].spans == ""
    many = secret_ownership.scan_secrets(make(copied + texts[4:], [f"s{i}" for i in range(7)])).collect()
    assert {(r.spans, r.n_live, r.n_example) for r in many if r.doc_id < 6} == {("", 0, 1)}
    assert [r.spans for r in many if r.doc_id == 6] == ["random:5:27"]


def test_repositories_decide(spark):
    """Values with as many owners; only the one in many repositories is an example."""
    few, many = "zQ9xK2mB7vL4nR8tW1yP5c", "aB3dE5fG7hJ9kL2mN4pQ6r"
    rows = [(i, f"see {few} ok", "en", f"s{i % 2}") for i in range(14)]
    rows += [(100 + i, f"see {many} ok", f"l{i}", f"s{i % 2}") for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for r in secret_ownership.scan_secrets(docs).collect():
        if r.doc_id < 100:
            assert (r.spans, r.n_live, r.n_example, r.n_repositories) == ("random:4:26", 1, 0, 2)
            assert [(c.n_owners, c.n_repositories) for c in r.found] == [(2, 2)]
        else:
            assert (r.spans, r.n_live, r.n_example, r.n_repositories) == ("", 0, 1, 14)
    masked = {r.doc_id: r.text for r in secret_ownership.redact_secrets(docs).collect()}
    assert masked[3] == "see [secret] ok" and masked[103] == f"see {many} ok"


def test_candidates_take_linear_time():
    rnd = random.Random(3)
    digits = lambda n: " ".join(f"{rnd.getrandbits(80):020x}" for _ in range(n))
    keys = lambda n: " ".join(f"ghp_{rnd.getrandbits(200):050x}Z" for _ in range(n))
    dots = lambda n: "eyJ" * n + " " + "eyJ." * n + "eyJ-a" * n

    def seconds(text):
        start = time.process_time()
        secret_ownership.candidates(text)
        return time.process_time() - start

    for make_text, small in ((digits, 5_000), (keys, 2_000), (dots, 10_000)):
        seconds(make_text(small))
        assert seconds(make_text(20 * small)) < 60 * max(seconds(make_text(small)), 0.02)


def test_candidates_do_not_overlap():
    """The same as comparing every match with every span before it."""
    rnd = random.Random(5)
    parts = ["token=", "abcdef0123456789", "AKIA", "0123456789ABCDEFGH", " ", "ghp_", "eyJ", ".", "a1B2c3D4e5F6g7H8i9J0", "-", "_", "xoxb-"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25)))
        kinds = {k for k, *_ in secret_ownership.BASE}
        found = secret_ownership.candidates(text)
        taken = [(s, e) for s, k, e, _ in found if k in kinds]
        want = [c for c in found if c[1] in kinds]
        for kind, pattern, group, least in secret_ownership.FURTHER:
            for m in pattern.finditer(text):
                s, e = m.span()
                if m.end(group) - m.start(group) < least or any(s < y and x < e for x, y in taken):
                    continue
                if kind != "random" or secret_ownership._random(m[0]):
                    want.append((s, kind, e, m[group]))
                    taken.append((s, e))
        assert sorted(found) == sorted(want)


def test_masking(make, odd, none):
    rows = {r.doc_id: r for r in secret_ownership.redact_secrets(make(["ü password=abcdefgh12345678 x", None, "clean"])).collect()}
    assert rows[0].text == "ü [secret] x" and rows[0].n_chars == 12
    assert rows[1].text is None and rows[2].text == "clean"
    masked = secret_ownership.redact_secrets(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    assert secret_ownership.redact_secrets(none).count() == 0
