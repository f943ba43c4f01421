"""Token ids of texts by a byte-level vocabulary given as ranks, equal to what the tokenizers library gives."""

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chatlens.llm.blocks import Block, blocks, mix
from chatlens.llm.shared import texts_of

SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space that is encoded apart: the library's pattern matcher overflows its stack on a million blanks before a letter.
_LONG_WHITE = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{512,}}")

#: The pattern whose borders of pieces :func:`cuts` knows; texts of other patterns are encoded whole.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _BLANK, _WIDE = range(7)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[:0x21], _KIND[0x7F], _KIND[0x80:] = _OTHER, _OTHER, _WIDE
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[0x30:0x3A], _KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x27] = _DIGIT, _LETTER, _LETTER, _QUOTE
#: Whether every piece ends between two bytes, at 8 * kind of the first + kind of the second.
_CUT = np.zeros(256, bool)
for _a, _after in {
    _LETTER: (_DIGIT, _MARK, _QUOTE, _BLANK),
    _DIGIT: (_LETTER, _MARK, _QUOTE, _BLANK),
    _MARK: (_LETTER, _DIGIT, _BLANK),  # no border before a quote; after one a letter may belong to it
    _QUOTE: (_BLANK,),
    _WIDE: (_BLANK,),  # but after white space beyond ASCII
}.items():
    _CUT[[8 * _a + _b for _b in _after]] = True

#: Longest kept word, one byte less than a key.
KEPT_BYTES = 15
#: Places for the words a worker keeps, each in the one that its bytes give, and ids of theirs; about 40 MB.
KEPT_WORDS, KEPT_IDS = 1 << 20, 1 << 23
#: Words handled at a time.
_STEP = 1 << 15
#: Where more than this share of so many words had to be encoded, the next texts are encoded whole, so many blocks of them.
NEW_SHARE, JUDGED_WORDS, WHOLE_BLOCKS = 0.4, 1 << 17, 16
_KEY_MASKS = np.zeros((KEPT_BYTES + 1, 2), np.uint64)
for _n in range(KEPT_BYTES + 1):
    _KEY_MASKS[_n] = np.frombuffer(b"\xff" * _n + bytes(16 - _n), "<u8")


def cuts(block: Block) -> np.ndarray:
    """Where words of a block begin: at each text and at places where every match of ``CUT_PATTERN`` ends.

    The pattern looks back nowhere, so a text's ids are those of its words one after the other. Words are whole pieces,
    one or several; the special string is left uncut, with its text.
    """
    raw = block.data.tobytes()
    kind = np.frombuffer(raw.translate(_KIND.tobytes()), np.uint8)
    begin = np.zeros(len(kind), bool)
    begin[1:] = np.frombuffer(((kind[:-1] << 3) | kind[1:]).tobytes().translate(_CUT.tobytes()), bool)
    at = np.flatnonzero(begin)
    wide = at[block.data[at - 1] >= 0x80]
    before = block.data[np.maximum(wide - 3, 0)]
    # White space beyond ASCII is C2 85, C2 A0 or begins with E1, E2 or E3; what else begins so is left uncut, too.
    white = (block.data[np.maximum(wide - 2, 0)] == 0xC2) | ((before >= 0xE1) & (before <= 0xE3))
    begin[wide[white]] = False
    found = -1
    while (found := raw.find(SPECIAL.encode(), found + 1)) >= 0:
        text = np.searchsorted(block.offsets, found, "right")
        begin[block.offsets[text - 1] : block.offsets[text]] = False
        found = block.offsets[text] - 1
    first = block.offsets[:-1]
    begin[first[first < block.offsets[1:]]] = True
    return np.flatnonzero(begin)


class ByteTokens:
    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        self.cut = pattern == CUT_PATTERN
        self.words, self.encoded, self.whole_blocks = 0, 0, 0
        self.keys = np.zeros((KEPT_WORDS, 2), np.uint64)
        self.first, self.counts = np.zeros(KEPT_WORDS, np.int32), np.zeros(KEPT_WORDS, np.uint8)
        self.kept, self.filled = np.zeros(KEPT_IDS, np.uint16), 0
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        """Ids of a text; the special string is its special id, as the tokenizers library reads it by default."""
        if SPECIAL not in text:
            return self._plain(text)
        first, *rest = text.split(SPECIAL)
        out = self._plain(first)
        for part in rest:
            out += [SPECIAL_ID, *self._plain(part)]
        return out

    def _plain(self, text: str) -> list[int]:
        """Long white space is one word of the pattern, but for its last character if a word follows."""
        if len(text) < 512:
            return self.library.encode_ordinary(text)
        out, at = [], 0
        for run in _LONG_WHITE.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.library.encode_ordinary(text[at : run.start()])
            out += self.library._encode_single_piece(text[run.start() : end].encode())
            at = end
        return out + self.library.encode_ordinary(text[at:]) if at else self.library.encode_ordinary(text)

    def block_ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's texts one after the other, and how many each text has."""
        filled = block.offsets[:-1][np.diff(block.offsets) > 0]
        cut = self.cut and not self.whole_blocks
        self.whole_blocks = max(self.whole_blocks - 1, 0)
        edges = np.append(cuts(block) if cut else filled, len(block.data))
        data = np.append(block.data, np.zeros(16, np.uint8))
        parts, done = [], 0
        while done < len(edges) - 1:
            bounds = edges[done : done + _STEP + 1]
            parts.append(self._words(data, bounds[:-1], np.diff(bounds)))
            done += len(bounds) - 1
            if not cut:
                self.encoded = 0
                continue
            self.words += len(bounds) - 1
            if self.words < JUDGED_WORDS:
                continue
            if self.encoded > NEW_SHARE * self.words:
                cut, self.whole_blocks = False, WHOLE_BLOCKS
                edges = np.unique(np.concatenate([edges[: done + 1], filled[filled > edges[done]], edges[-1:]]))
            self.words, self.encoded = 0, 0
        if not parts:
            return np.zeros(0, np.uint16), np.zeros(block.count, np.int64)
        ends = np.append(0, np.cumsum(np.concatenate([n for _, n in parts])))
        return np.concatenate([ids for ids, _ in parts]), np.diff(ends[np.searchsorted(edges[:-1], block.offsets)])

    def _words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has. Words are compared by all their bytes."""
        known = np.minimum(size, KEPT_BYTES)
        key = np.ndarray(len(data) - 15, "V16", data, strides=(1,))[start].view("<u8").reshape(-1, 2)
        key &= _KEY_MASKS[known]
        key[:, 1] |= known.astype(np.uint64) << np.uint64(56)
        place = (mix(key[:, 0] ^ mix(key[:, 1])) & np.uint64(KEPT_WORDS - 1)).astype(np.int64)
        # A pair of numbers is taken as one value of 16 bytes.
        held = self.keys.view(np.complex128)[:, 0].take(place).view(np.uint64).reshape(-1, 2)
        long = size > KEPT_BYTES
        short_at = np.flatnonzero(((held[:, 0] != key[:, 0]) | (held[:, 1] != key[:, 1])) & ~long)
        new_at = np.append(short_at, np.flatnonzero(long))
        first, counts = self.first[place].astype(np.int64), self.counts[place].astype(np.int64)
        numbers: dict[bytes, int] = {}
        words = [k[: k[15]] for k in key[short_at].view("S16").ravel().tolist()]
        which = [numbers.setdefault(w, len(numbers)) for w in words]
        n_short, spans = len(numbers), zip(start[long].tolist(), size[long].tolist(), strict=True)
        which += [numbers.setdefault(data[a : a + n].tobytes(), len(numbers)) for a, n in spans]
        plain = self.library.encode_ordinary
        found = [plain(w.decode()) if len(w) < len(SPECIAL) else self.ids(w.decode()) for w in numbers]
        self.encoded += len(found)
        n = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint16, n.sum())
        which = np.array(which, np.int64)
        first[new_at], counts[new_at] = (self.filled + np.cumsum(n) - n)[which], n[which]
        # The new ids stand behind the kept ones; those of long words are not kept.
        if self.filled + len(ids) <= KEPT_IDS:
            kept = self.kept
            kept[self.filled : self.filled + len(ids)] = ids
            # Of words with one place one stays.
            at, row = np.unique(place[short_at], return_index=True)
            own = short_at[row]
            self.keys[at], self.first[at], self.counts[at] = key[own], first[own], counts[own]
            self.filled += int(n[:n_short].sum())
        else:  # full: begun anew
            kept = np.append(self.kept[: self.filled], ids)
            self.keys[:], self.filled = 0, 0
        ends = np.cumsum(counts)
        return kept[np.repeat(first - ends + counts, counts) + np.arange(ends[-1])], counts


@lru_cache(2)
def _kept_tokens(ranks_path: str, pattern: str) -> ByteTokens:
    """One for all tasks of a worker."""
    return ByteTokens(ranks_path, pattern)


def tokenize(
    docs: DataFrame, ranks_path: str, pattern: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id``, ``n`` and ``ids`` (16-bit little-endian ids with the end id), a row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _kept_tokens(ranks_path, pattern)
        for batch in batches:
            for block in blocks(batch.column("text")):
                ids, n = tokens.block_ids(block)
                ids = np.insert(ids, np.cumsum(n), end_id)
                at = np.append(0, np.cumsum(2 * (n + 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, block.count),
                        pa.array(n + 1),
                        pa.Array.from_buffers(
                            pa.large_binary(), block.count, [None, pa.py_buffer(at), pa.py_buffer(ids.astype("<u2"))]
                        ).cast(pa.binary()),
                    ],
                    names=["doc_id", "n", "ids"],
                )

    return texts_of(docs, id_column, text_column).mapInArrow(run, "doc_id long, n long, ids binary")
