"""Best-two-fit packing against sequences filled one by one, and every token against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chatlens.llm import byte_tokens
from chatlens.llm import two_fit_packing as tf
from chatlens.llm.blocks import blocks
from chatlens.llm.byte_tokens import ByteTokens

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def one_by_one(sizes, window):
    """Sequences by the method, as lists of lengths."""
    left, out = Counter(sizes), []
    while +left:
        bin_ = [max(+left)]
        left[bin_[0]] -= 1
        while fits := [s for s in +left if s <= window - sum(bin_)]:
            bin_.append(max(fits))
            left[bin_[-1]] -= 1
        while len(bin_) > 1 and sum(bin_) < window:
            gap = window - sum(bin_) + min(bin_)
            pairs = [
                (a + b, a, b)
                for a in +left
                for b in +left
                if b <= a and a + b <= gap and (a != b or left[a] > 1)
            ]
            if not pairs or max(pairs)[0] <= min(bin_):
                break
            _, a, b = max(pairs, key=lambda p: (p[0], -p[1]))
            left[min(bin_)] += 1
            bin_.remove(min(bin_))
            left[a] -= 1
            left[b] -= 1
            bin_ += [a, b]
        out.append(sorted(bin_, reverse=True))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_kinds_are_what_filling_one_by_one_gives(seed):
    rnd = random.Random(seed)
    window = rnd.choice([8, 20, 50, 100])
    sizes = [min(window, max(1, int(rnd.paretovariate(0.7)) if seed % 2 else rnd.randint(1, window))) for _ in range(200)]
    sizes += [rnd.randint(1, window)] * 90
    counts = np.bincount(sizes, minlength=window + 1)
    kinds = tf.two_fit(counts, window)
    used = Counter()
    for lengths, times in kinds:
        assert 0 < sum(s * n for s, n in lengths) <= window and times > 0
        for s, n in lengths:
            used[s] += n * times
    assert used == Counter(sizes)
    plain = one_by_one(sizes, window)
    assert sorted([s for s, n in lengths for _ in range(n)] for lengths, times in kinds for _ in range(times)) == sorted(plain)
    places, seen = tf.Places(kinds, window), defaultdict(list)
    for s in sorted(used):
        for sequence, offset in zip(*places.of(np.full(used[s], s), np.arange(used[s])), strict=True):
            seen[int(sequence)].append((int(offset), s))
    for found in seen.values():
        found.sort()
        ends = [0] + [a + s for a, s in found]
        assert [a for a, _ in found] == ends[:-1] and ends[-1] <= window


def test_two_take_the_place_of_one():
    # 60 + 30 leaves 10; 21 and 19 fill what the 30 leaves.
    counts = np.bincount([60, 30, 21, 19], minlength=101)
    assert tf.two_fit(counts, 100) == [([(60, 1), (21, 1), (19, 1)], 1), ([(30, 1)], 1)]


def check(docs, rows, library, window=2048):
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(whole) == set(texts)
    for doc, pieces in whole.items():
        want = Counter()
        for ids in texts[doc]:
            first = len(ids) % window or window
            bounds = [0, *range(first, len(ids) + 1, window)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                want[(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    for found in sequences.values():
        found.sort()
        ends = [0] + [a + n for a, n in found]
        assert [a for a, _ in found] == ends[:-1] and ends[-1] <= window
    tokens = sum(r.length for r in rows)
    return len(sequences), -(-tokens // window)


def test_documents_are_packed_whole(documents, library):
    rows = tf.pack(documents, RANKS, PATTERN).collect()
    used, least = check(documents, rows, library)
    assert used <= least * 1.02 + 1
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_packing_on_odd_rows(odd, none, library):
    check(odd, tf.pack(odd, RANKS, PATTERN, with_ids=False).collect(), library)
    assert tf.pack(none, RANKS, PATTERN).count() == 0


def test_one_length_for_most_rows(spark, make, library):
    docs = make(["a b c"] * 700 + [f"w{i} " * (i % 90) for i in range(300)] + [None, ""])
    rows = tf.pack(docs, RANKS, PATTERN, window=64).collect()
    used, least = check(docs, rows, library, 64)
    assert used <= least + 1


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n\t　"])
def test_long_white_space(library, blank):
    tokens = ByteTokens(RANKS, PATTERN)
    run = blank * (2_000_000 // len(blank))
    for text in (run + "x", "a" + run, f"a {run}éb", f"{run}<|endoftext|>{run} c"):
        assert tokens.ids(text) == library.encode(text, add_special_tokens=False).ids


def test_white_space_around_the_border_of_long(library):
    tokens, rnd = ByteTokens(RANKS, PATTERN), random.Random(4)
    for _ in range(300):
        parts = [rnd.choice(["a", " ", "\n", "\x1c", "\x85", "\xa0", "é,", "12"]) * rnd.choice([1, 2, 511, 512, 513]) for _ in range(5)]
        text = "".join(parts)
        assert tokens.ids(text) == library.encode(text, add_special_tokens=False).ids


def in_blocks(tokens, texts, limit):
    """Ids of each text, taken from blocks of about ``limit`` bytes."""
    out = []
    for block in blocks(pa.array(texts, pa.string()), limit):
        ids, n = tokens.block_ids(block)
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return out


def test_a_word_goes_to_the_library_once():
    tokens, rnd = ByteTokens(RANKS, PATTERN), random.Random(8)
    assert tokens.cut
    vocabulary = [f"w{rnd.getrandbits(20):x}" for _ in range(200)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(100)) + ".\n" for _ in range(300)]
    whole, seen = tokens.library, []

    class Counting:
        def encode_ordinary(self, text):
            seen.append(len(text))
            return whole.encode_ordinary(text)

    tokens.library = Counting()
    assert in_blocks(tokens, texts, 20_000) == [whole.encode_ordinary(t) for t in texts]
    assert sum(seen) < 0.02 * sum(map(len, texts))


@pytest.mark.parametrize("words, ids, judged", [(1 << 20, 1 << 23, 1 << 17), (64, 500, 1 << 17), (64, 500, 100)])
def test_blocks_give_the_library_s_ids(library, monkeypatch, words, ids, judged):
    """Cuts lie at borders of pieces only; with few places words push each other out and the store begins anew.

    Judged early, some blocks go whole from somewhere on.
    """
    monkeypatch.setattr(byte_tokens, "JUDGED_WORDS", judged)
    monkeypatch.setattr(byte_tokens, "WHOLE_BLOCKS", 2)
    monkeypatch.setattr(byte_tokens, "KEPT_WORDS", words)
    monkeypatch.setattr(byte_tokens, "KEPT_IDS", ids)
    monkeypatch.setattr(byte_tokens, "_STEP", 50)
    tokens, rnd = ByteTokens(RANKS, PATTERN), random.Random(5)
    blanks = [" ", "\n", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\u200b", "\u180e"]
    parts = [chr(i) for i in range(128)] + ["'", "'s", "'re", "n't", "'T"] * 5 + blanks * 5
    parts += [*"éßЖ中か한١²½\u0301😀𝔘"] * 2 + [" the", "and", "<|endoftext|>", "<|endoftext|"]
    for r in range(30):
        own = parts if r % 3 else rnd.sample(parts, 12)
        texts = ["".join(rnd.choices(own, k=rnd.choice([0, 1, 2, 3, 9, 100]))) for _ in range(100)] + [" " * 600 + "a'"]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert in_blocks(tokens, texts, rnd.choice([20, 3000])) == want


def test_texts_of_words_that_do_not_recur_go_whole(monkeypatch):
    monkeypatch.setattr(byte_tokens, "JUDGED_WORDS", 1000)
    monkeypatch.setattr(byte_tokens, "_STEP", 500)
    tokens, rnd = ByteTokens(RANKS, PATTERN), random.Random(9)
    new = [" ".join("".join(rnd.choices("abcdefghij", k=9)) for _ in range(50)) for _ in range(200)]
    old = ["of the one and the other, " * 20] * 300
    whole = tokens.library.encode_ordinary
    assert in_blocks(tokens, new[:100], 1 << 20) == [whole(t) for t in new[:100]]
    assert tokens.whole_blocks == byte_tokens.WHOLE_BLOCKS
    assert in_blocks(tokens, new[100:], 1) == [whole(t) for t in new[100:]]
    assert in_blocks(tokens, old, 2000) == [whole(t) for t in old]
    assert not tokens.whole_blocks


def test_blocks_of_other_patterns():
    """A pattern whose pieces the cuts do not know gets whole texts."""
    tokens = ByteTokens(RANKS, r"[a-z ]+|[^a-z ]+")
    texts = ["of the one, the other", "", " the the", "the"]
    assert in_blocks(tokens, texts, 1000) == [tokens.library.encode_ordinary(t) for t in texts]
