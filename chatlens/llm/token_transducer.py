"""Token counts by a deterministic transducer over bytes, compiled from the merges of a tokenizer model.

Of every prefix of a text the tokenizer's last token is determined: it is the one token that ends there and that does not merge
with the last token of the prefix before it (that is, the two together are tokenised as these two). What later bytes can
change reaches back no further than the longest token that may still be growing. So a state holds that tail, the last tokens
of the prefixes in it and how their counts lie to each other, and a transition carries by how much the count of
the prefix grows (less than 0 where a merge swallows tokens). The weights on a text's way add up to its number of tokens.
Transitions are compiled when a text first takes them; the tokenizer's library is asked for its pieces and scores only.

Texts are cut into chunks of equal length that all step together. A merge tokenizer never forms a piece over some borders
(before a space that follows another character, around a line break: checked against the vocabulary), where the machine is in
its initial state whatever came before, so a chunk with a border maps all entry states to one exit state. The stretch before a
chunk's first border is run from a guessed state and, in the scan over the chunks, from its true entry state until both runs
meet, mostly after a few characters; what does not meet is run again by chunk, with a memo of chunk maps.

Defined cases: a null text is empty; an empty text has 0 tokens; the sign that stands for spaces in pieces (U+2581) is a space,
as for the library; characters without a piece are counted by their bytes; repeated rows are counted each; an empty
table gives an empty result; other columns are ignored. A text of any length passes in windows of ``_WINDOW`` bytes. Rows are
independent: no shuffle. The machine is emptied when it holds ``MAX_TRANSITIONS``, so memory is bounded.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.blocks import Block, blocks, mix
from chatlens.llm.shared import texts_of

CHUNK = 256
#: A window adds at most as many transitions as it has bytes, so the table is at most half full.
MAX_TRANSITIONS = 1 << 20
_WINDOW = 1 << 20
_SLOTS = 1 << 22
_SPACE, _LINE = 0x20, 0x0A
_MARK = "▁"


class Merges:
    """Pieces of a merge tokenizer and the order of its merges."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.score = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        if any(_MARK in p.lstrip(_MARK) for p in self.score) or any("\n" in p for p in self.score):
            raise ValueError("pieces of this model reach over spaces or line breaks")
        if any(c not in self.score for p in self.score for c in p):
            raise ValueError("pieces of this model hold characters that are no pieces")
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p))}
        self.longest = max(map(len, self.score))
        self.pairs: dict[tuple[str, str], bool] = {}

    def split(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair, of equal ones the first, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stand(self, before: str, piece: str) -> bool:
        """Whether a piece stays as it is behind another (or at the beginning)."""
        key = before, piece
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MAX_TRANSITIONS:
                self.pairs.clear()
            known = self.pairs[key] = self.split(before + piece) == ([before, piece] if before else [piece])
        return known


#: The tail that may grow, the last token and the relative count of each prefix from its beginning on, bytes of a character
#: that is not complete.
State = tuple[str, tuple[str, ...], tuple[int, ...], bytes]
INITIAL: State = ("", ("",), (0,), b"")


class Transducer:
    """The machine of one tokenizer model (sentencepiece file)."""

    def __init__(self, model_path: str):
        self.merges = Merges(model_path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.next = np.zeros(_SLOTS, np.int32)
        self.weight = np.zeros(_SLOTS, np.int8)
        self.states: list[State] = [INITIAL]
        self.number = {INITIAL: 0}
        self.transitions = 0

    def _of(self, state: State) -> int:
        number = self.number.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def after(self, state: State, byte: int) -> tuple[State, int]:
        """The state after one more byte, and by how much the count grows."""
        tail, tokens, counts, begun = state
        if begun and not 0x80 <= byte < 0xC0 or not begun and 0x80 <= byte < 0xC0:
            return INITIAL, 0  # inside a character: only from a guessed state, or past the end
        begun += bytes((byte,))
        lead = begun[0]
        if len(begun) < (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
            return (tail, tokens, counts, begun), 0
        char = _MARK if byte == _SPACE and len(begun) == 1 else begun.decode()
        if char not in self.merges.score:
            return INITIAL, len(begun)  # byte pieces; nothing merges over them
        tail += char
        for size in range(min(len(tail), self.merges.longest), 0, -1):
            piece = tail[-size:]
            if piece in self.merges.score and self.merges.stand(tokens[-size], piece):
                break
        else:
            raise ValueError(f"no piece ends {tail!r}")
        grown = counts[-size] + 1
        keep = len(tail)
        while keep and tail[-keep:] not in self.merges.prefixes:
            keep -= 1
        tokens, counts = (*tokens, piece)[-keep - 1 :], (*counts, grown)[-keep - 1 :]
        return (tail[len(tail) - keep :], tokens, tuple(c - grown for c in counts), b""), grown

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one byte each, and what the counts grow by."""
        key = (state.astype(np.uint64) << np.uint64(8)) + byte + np.uint64(1)
        slot = (mix(key) & np.uint64(_SLOTS - 1)).astype(np.int64)
        open_ = np.flatnonzero(self.keys[slot] != key)
        while len(open_):
            seen = self.keys[slot[open_]]
            missing = open_[seen == 0]
            if len(missing):
                self._compile(np.unique(key[missing]))
            slot[open_] = (slot[open_] + (seen != 0)) & (_SLOTS - 1)
            open_ = open_[self.keys[slot[open_]] != key[open_]]
        return self.next[slot], self.weight[slot]

    def _compile(self, keys: np.ndarray) -> None:
        slots = (mix(keys) & np.uint64(_SLOTS - 1)).astype(np.int64)
        for key, slot in zip(keys.tolist(), slots.tolist(), strict=True):
            while self.keys[slot] not in (0, key):
                slot = (slot + 1) & (_SLOTS - 1)
            if self.keys[slot] == key:
                continue
            state, weight = self.after(self.states[(key - 1) >> 8], (key - 1) & 255)
            self.keys[slot], self.next[slot], self.weight[slot] = key, self._of(state), weight
            self.transitions += 1

    def count(self, block: Block) -> np.ndarray:
        """Tokens of each text of a block."""
        block = _with_spaces(block)
        # The tokenizer puts a space before every text that is not empty.
        sizes = np.diff(block.offsets)
        full = sizes > 0
        begins = np.concatenate(([0], np.cumsum(sizes + full)))
        data = np.full(begins[-1], _SPACE, np.uint8)
        first = np.zeros(len(data), bool)
        first[begins[:-1][full]] = True
        data[~first] = block.data
        space, line = data == _SPACE, data == _LINE
        border = first | line
        border[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
        grown = np.zeros(len(data) + 1, np.int64)
        state = INITIAL
        for a in range(0, len(data), _WINDOW):
            if self.transitions > MAX_TRANSITIONS:
                self.clear()
            part = slice(a, a + _WINDOW)
            weights, exit_ = self._run(data[part], border[part], self._of(state))
            grown[a + 1 : a + 1 + len(weights)] = weights
            state = self.states[exit_]
        total = np.cumsum(grown)
        return total[begins[1:]] - total[begins[:-1]]

    def _run(self, data: np.ndarray, border: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """What each byte adds, and the state at the end, of bytes entered in a state."""
        n = len(data)
        width = -(-n // CHUNK)

        def chunks(values: np.ndarray, fill) -> np.ndarray:
            padded = np.full(width * CHUNK, fill, values.dtype)
            padded[:n] = values
            return np.ascontiguousarray(padded.reshape(width, CHUNK).T)

        lanes, marks = chunks(data, _SPACE), chunks(border, True)
        reached = np.zeros((CHUNK, width), np.int32)
        weights = np.zeros((CHUNK, width), np.int8)
        # The guess: a chunk is entered between two segments.
        state = np.zeros(width, np.int32)
        for t in range(CHUNK):
            state, weights[t] = self.step(np.where(marks[t], 0, state), lanes[t])
            reached[t] = state
        # The scan: the stretch before a chunk's first border again, from what the chunk before is left in.
        head = np.where(marks.any(axis=0), marks.argmax(axis=0), CHUNK)
        entries = np.concatenate(([entry], reached[-1][:-1]))
        todo = np.flatnonzero((head > 0) & (entries != 0))
        rounds, memo = 0, {}
        while len(todo):
            if rounds < 4:
                changed = self._again(lanes, head, reached, weights, todo, entries[todo])
                after = todo[changed] + 1
                after = after[after < width]
                entries[after] = reached[-1][after - 1]
                todo = after[head[after] > 0]
                rounds += 1
                continue
            # Long stretches that keep their phase: chunk after chunk, equal ones once.
            k = int(todo[0])
            key = int(entries[k]), int(head[k]), lanes[:, k].tobytes()
            before = int(reached[-1][k])
            if key in memo:
                reached[:, k], weights[:, k] = memo[key]
            else:
                self._again(lanes, head, reached, weights, todo[:1], entries[todo[:1]])
                if len(memo) < 256:
                    memo[key] = reached[:, k].copy(), weights[:, k].copy()
            todo = todo[1:]
            if int(reached[-1][k]) != before and k + 1 < width:
                entries[k + 1] = reached[-1][k]
                if head[k + 1] > 0 and (not len(todo) or todo[0] != k + 1):
                    todo = np.concatenate(([k + 1], todo))
        flat = weights.T.reshape(-1)[:n]
        # Past the end the last chunk is filled with single spaces.
        end = n - (width - 1) * CHUNK
        return flat, int(reached[end - 1][width - 1]) if n else entry

    def _again(self, lanes, head, reached, weights, todo: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Runs the heads of chunks from given states until they meet the run before; says whose exit has changed."""
        state, on = entries.astype(np.int32), np.arange(len(todo))
        exits = reached[-1][todo].copy()
        for t in range(int(head[todo].max())):
            on = on[head[todo[on]] > t]
            if not len(on):
                break
            lane = todo[on]
            now, weight = self.step(state[on], lanes[t][lane])
            met = reached[t][lane] == now
            reached[t][lane], weights[t][lane], state[on] = now, weight, now
            on = on[~met]
        return reached[-1][todo] != exits


def _with_spaces(block: Block) -> Block:
    """The block with U+2581 written as a space."""
    mark = _MARK.encode()
    if mark not in block.data.tobytes():
        return block
    texts = [block.text(i).replace(mark, b" ") for i in range(block.count)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    return Block(block.first, data, np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64))


@lru_cache(maxsize=2)
def machine_of(model_path: str) -> Transducer:
    """One machine for all tasks of a worker."""
    return Transducer(model_path)


def count_tokens(
    docs: DataFrame,
    model_path: str,
    limit: int = 4096,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens), a row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(model_path)
        for batch in batches:
            for block in blocks(batch.column("text"), _WINDOW):
                tokens = machine.count(block)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, block.count),
                        pa.array(np.diff(block.offsets)),
                        pa.array(tokens),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    counted = texts_of(docs, id_column, text_column).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
