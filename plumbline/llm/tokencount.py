"""Token counts by finite-state transducers.

A byte-level BPE is compiled into two deterministic machines:

* ``Splitter`` reads bytes and marks where a pretoken starts. It has 8 states and is complete, so the bytes of
  many texts are cut into chunks of equal length, every chunk is run from all 8 states at once into a map
  from entry to exit state, and the maps are composed by a parallel prefix scan. Each chunk then knows its
  true entry state and marks its starts.
* ``Counter`` reads the bytes of one pretoken and emits, with every transition, by how much the number of
  tokens of the part read so far changes. A state holds, for each earlier token end from which a longer
  token could still reach beyond the byte just read, the distance, the token that ends there and its count
  relative to now. These states are built when first met, kept in a table of bounded size, and the table starts anew
  when full. All pretokens of a batch advance one byte at a time together.

The encoding of a BPE is the only token sequence in which each adjacent pair is stable, i.e. encodes to itself,
and prefixes of an encoding are encodings. So the last token of every prefix decides all that follows.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import tokens
from plumbline.llm.common import columns, slices, texts

CHUNK = 64
#: Characters after which the state of a chunk seldom depends on its entry.
HEAD = 8
#: Bytes of text that are counted together.
BATCH_BYTES = 2_000_000

# Character classes of the splitter. SAME marks the later bytes of a character, which change nothing.
LETTER, ONE, E_AFTER, L_AFTER, LETTER_E, NUMBER, SPACE, WHITE, QUOTE, OTHER, END, SAME = range(12)
N_CLASS = 12
# States: START (a token just ended), in a run, or after a quote that may begin a contraction.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, IN_WHITE, AT_QUOTE, IN_QUOTE = range(8)
N_STATE = 8


def _step(state: int, now: int, ahead: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this character; ``ahead`` is the class of the next one."""
    letter, white = now <= LETTER_E, now in (SPACE, WHITE)
    if now == SAME:
        return state, False
    if now == END:
        return START, True
    if state == IN_QUOTE:
        return START, False
    if state == AT_QUOTE:
        if now == ONE:
            return START, False
        if now == E_AFTER and ahead == LETTER_E or now == L_AFTER and ahead == L_AFTER:
            return IN_QUOTE, False
        if now in (QUOTE, OTHER):
            return IN_OTHER, False
    if white:
        ends_run = ahead not in (SPACE, WHITE, END)
        return (IN_SPACE if now == SPACE else IN_WHITE), ends_run if state in (IN_SPACE, IN_WHITE) else True
    run = IN_LETTERS if letter else IN_NUMBERS if now == NUMBER else IN_OTHER
    joined = state in (run, IN_SPACE)
    return (AT_QUOTE if now == QUOTE and not joined else run), not joined


@functools.cache
def _split_tables() -> tuple[np.ndarray, np.ndarray]:
    nxt, starts = np.zeros(N_STATE * N_CLASS * N_CLASS, np.intp), np.zeros(N_STATE * N_CLASS * N_CLASS, bool)
    for state in range(N_STATE):
        for now in range(N_CLASS):
            for ahead in range(N_CLASS):
                at = (state * N_CLASS + now) * N_CLASS + ahead
                nxt[at], starts[at] = _step(state, now, ahead)
    return nxt, starts


class Splitter:
    """Marks the bytes at which pretokens start."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self._library = Tokenizer.from_file(path).pre_tokenizer
        self.classes = np.full(0x110000, 255, np.uint8)
        for code in range(128):
            self.classes[code] = self._class_of(chr(code))
        self.classes[0] = self._class_of("\0")

    def _class_of(self, char: str) -> int:
        """Letters, numbers, white space and others as the tokenizers library splits them."""
        special = {"'": QUOTE, " ": SPACE, "e": LETTER_E, "l": L_AFTER, "r": E_AFTER, "v": E_AFTER} | dict.fromkeys("stmd", ONE)
        if char in special:
            return special[char]
        for kind, side in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self._library.pre_tokenize_str(side + char + side)) == 1:
                return kind
        return WHITE

    def byte_classes(self, data: np.ndarray) -> np.ndarray:
        """Class of each byte: that of its character at the first byte, SAME at the others. 0xFF ends a text."""
        out = np.full(len(data), SAME, np.uint8)
        ascii_ = data < 128
        out[ascii_] = self.classes[data[ascii_]]
        out[data == 255] = END
        lead = np.flatnonzero((data >= 0xC0) & (data < 255))
        if len(lead):
            b = data[lead].astype(np.uint32)
            size = 2 + (b >= 0xE0) + (b >= 0xF0)
            code = b & (0x7F >> size).astype(np.uint32)
            for k in (1, 2, 3):
                more = size > k
                code[more] = code[more] << 6 | (data[lead[more] + k] & 0x3F)
            kinds = self.classes[code]
            if (kinds == 255).any():
                for c in np.unique(code[kinds == 255]).tolist():
                    self.classes[c] = self._class_of(chr(c))
                kinds = self.classes[code]
            out[lead] = kinds
        return out

    def starts(self, data: np.ndarray) -> np.ndarray:
        """Offsets of the bytes at which a pretoken or an end mark starts. ``data`` ends with 0xFF."""
        nxt, _ = _split_tables()
        now = self.byte_classes(data)
        # class of the next character: looked up at the next byte that begins one
        begins = np.flatnonzero(now != SAME)
        ahead = np.full(len(now), END, np.uint8)
        ahead[begins[:-1]] = now[begins[1:]]
        symbol = now.astype(np.intp) * N_CLASS + ahead
        n = -(-len(symbol) // CHUNK)
        padded = np.full(n * CHUNK, SAME * N_CLASS + END, np.intp)
        padded[:len(symbol)] = symbol
        grid = np.ascontiguousarray(padded.reshape(n, CHUNK).T)
        maps = np.tile(np.arange(N_STATE, dtype=np.intp), (n, 1))
        for row in grid[:HEAD]:
            maps = nxt[maps * (N_CLASS * N_CLASS) + row[:, None]]
        # after a few characters nearly every chunk is in one state whatever it began in: those go on as one
        alike = (maps == maps[:, :1]).all(axis=1)
        sure, open_ = np.flatnonzero(alike), np.flatnonzero(~alike)
        found = np.empty((CHUNK, n), bool)
        maps[sure] = self._walk(grid, found, sure, maps[sure, 0], HEAD, CHUNK)[:, None]
        rest = maps[open_]
        for row in grid[HEAD:, open_]:
            rest = nxt[rest * (N_CLASS * N_CLASS) + row[:, None]]
        maps[open_] = rest
        entry = self._entries(maps)
        self._walk(grid, found, np.arange(n), entry, 0, HEAD)
        self._walk(grid, found, open_, entry[open_], 0, CHUNK)
        return np.flatnonzero(found.T.reshape(-1)[:len(symbol)])

    @staticmethod
    def _walk(grid: np.ndarray, found: np.ndarray, chunks: np.ndarray, state: np.ndarray, first: int, last: int) -> np.ndarray:
        """Runs chunks from known states, notes where tokens start and returns the exit states."""
        nxt, marks = _split_tables()
        for j in range(first, last):
            at = state * (N_CLASS * N_CLASS) + grid[j, chunks]
            found[j, chunks], state = marks[at], nxt[at]
        return state

    @staticmethod
    def _entries(maps: np.ndarray) -> np.ndarray:
        """Entry state of every chunk: inclusive scan of the maps by doubling, applied to START."""
        done, width = maps, 1
        while width < len(done):
            joined = done.copy()
            joined[width:] = np.take_along_axis(done[width:], done[:-width], axis=1)
            done, width = joined, width * 2
        return np.concatenate([[START], done[:-1, START]])


class Counter:
    """The transducer that counts the tokens of a pretoken."""

    #: Cells of the transition table: 128 MB of memory for each Python worker.
    CELLS = 1 << 25

    def __init__(self, path: str):
        spec = tokens.definition(path)
        self.ids = spec["ids"]
        self.rank = {pair: i for i, pair in enumerate(spec["merges"])}
        self.prefixes = {t[:k] for t in self.ids for k in range(1, len(t))}
        self.stable: dict[tuple[bytes, bytes], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.column = np.zeros(256, np.intp)  # of each byte met so far; column 0 is never filled
        self.width = 64
        self.cells = np.full(1024 * self.width, -1, np.int32)  # next state * 256 + change of the count + 128
        # a state: ends of tokens as (distance back, last token there or b"" at the start, tokens there less tokens now), and the bytes since the farthest
        self.states = [((0, b"", 0),)]
        self.tails = [b""]
        self.number = {(self.states[0], b""): 0}

    def encode(self, word: bytes) -> list[bytes]:
        """Plain BPE by rank; only short words are encoded this way."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranked = [(self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:]))]
            best, i = min(ranked)
            if best == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stable(self, left: bytes, right: bytes) -> bool:
        key = left, right
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > 2_000_000:
                self.stable.clear()
            known = self.stable[key] = self.encode(left + right) == ([left, right] if left else [right])
        return known

    def _build(self, state: int, byte: int) -> None:
        tail = self.tails[state] + bytes([byte])
        for back, left, count in self.states[state]:
            token = tail[len(tail) - back - 1:]
            if token in self.ids and self._stable(left, token):
                break
        change = count + 1
        ends = [(b + 1, left, c - change) for b, left, c in self.states[state] if tail[len(tail) - b - 1:] in self.prefixes]
        ends.append((0, token, 0))
        ends = tuple(ends)
        tail = tail[len(tail) - ends[0][0]:] if ends[0][0] else b""
        number = self.number.setdefault((ends, tail), len(self.states))
        if number == len(self.states):
            self.states.append(ends)
            self.tails.append(tail)
        self.cells[state * self.width + self.column[byte]] = number << 8 | change + 128

    def _make_room(self, fresh: int, columns: np.ndarray, must: bool) -> bool:
        """Room for ``fresh`` more states and for the bytes met; False when the table is full, unless it ``must`` grow."""
        unmet = columns[self.column[columns] == 0]
        used = int(self.column.max()) + len(unmet) + 1
        width = self.width
        while width < used:
            width *= 2
        rows = len(self.cells) // self.width
        while rows < len(self.states) + fresh:
            rows *= 2
        if rows * width > self.CELLS and not must:
            return False
        self.column[unmet] = np.arange(used - len(unmet), used)
        if (rows, width) != (len(self.cells) // self.width, self.width):
            old = self.cells.reshape(-1, self.width)
            grown = np.full((rows, width), -1, np.int32)
            grown[:len(old), :self.width] = old
            self.cells, self.width = grown.reshape(-1), width
        return True

    def counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each pretoken ``data[start:start + length]``."""
        order = np.argsort(-length, kind="stable")
        start, left = start[order], length[order]
        active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), side="right")
        state, total = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for j in range(int(left[0]) if len(left) else 0):
            n = int(active[j])
            byte = data[start[:n] + j]
            cell = self.cells[state[:n] * self.width + self.column[byte]]
            missing = np.flatnonzero(cell < 0)
            if len(missing):
                keys = np.unique(state[missing] << 8 | byte[missing])
                if not self._make_room(len(keys), np.unique(byte[missing]), must=len(start) == 1):
                    return self._again(data, start, left, order)
                for key in keys.tolist():
                    self._build(key >> 8, key & 255)
                cell = self.cells[state[:n] * self.width + self.column[byte]]
            total[:n] += (cell & 255) - 128
            state[:n] = cell >> 8
        out = np.empty(len(total), np.int64)
        out[order] = total
        return out

    def _again(self, data, start, length, order) -> np.ndarray:
        """The table is full: start it anew and count half of the pretokens at a time. For a single one it grows."""
        self._clear()
        parts = np.array_split(np.arange(len(start)), 2)
        total = np.concatenate([self.counts(data, start[p], length[p]) for p in parts])
        out = np.empty(len(total), np.int64)
        out[order] = total
        return out


@functools.cache
def machines(path: str) -> tuple[Splitter, Counter]:
    return Splitter(path), Counter(path)


def count_tokens(data: list[bytes], path: str) -> np.ndarray:
    """Tokens of every text."""
    splitter, counter = machines(path)
    special = tokens.definition(path)["special"]
    found = re.compile(b"|".join(re.escape(s.encode()) for s in special)) if special else None
    total = np.zeros(len(data), np.int64)
    parts, owner = [], []
    for i, text in enumerate(data):
        if found and found.search(text):
            pieces = found.split(text)
            total[i] += len(pieces) - 1
            parts.extend(pieces)
            owner.extend([i] * len(pieces))
        else:
            parts.append(text)
            owner.append(i)
    if not parts:
        return total
    joined = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    starts = splitter.starts(joined)
    ends = np.append(starts[1:], len(joined))
    word = joined[starts] != 255
    n = counter.counts(joined, starts[word], (ends - starts)[word])
    of = np.cumsum(~word)[word]  # ends of texts before a pretoken: the number of its text
    np.add.at(total, np.array(owner)[of], n)
    return total


def count(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Null and empty texts have no bytes and no tokens. Repeated rows are counted one by one, null ids stay null,
    an empty table gives no rows. Special strings in a text are one token each.
    """
    inner = columns(docs, doc_id=id_col, text=text_col)
    kind = inner.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                data = texts(batch, "text")
                n = count_tokens(data, tokenizer)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(n), pa.array(n > limit)],
                                                 ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return inner.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("doc_id", id_col)
