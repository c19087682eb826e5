"""Token counts by a compiled finite-state transducer.

The tokenizer file (layout 'word' of wordids: lower case, pre-tokens with word ends) becomes a
deterministic transducer over the UTF-8 bytes of normalised texts whose transitions carry the
number of tokens emitted. A character's last byte decides; the bytes before it emit nothing.

States inside a pre-token. Byte-pair encodings have a local test: a token sequence is the
encoding of its text exactly if each neighbouring pair is the encoding of its own text. So each
prefix of a word has one last token, found from the last tokens of shorter prefixes. Only
positions from which some vocabulary entry can still reach over the current end matter later.
A state is therefore the longest suffix that begins a vocabulary entry, and for those positions
in it the last token and the token count relative to the current end. That is finite, and equal
states are merged. A transition emits the change of the token count, which may be negative. The
end of a word emits what its closing token (with the word-end mark) changes.

States between pre-tokens: a start, and the few that decide contractions.

States are made when first met and kept in a dense table of at most MOST_STATES. Where a run of
texts would pass that, as random letters do, the run is counted by the library word by word, and
the table starts anew. So a worker's memory does not grow with its texts.

Chunks. Texts are laid end to end, cut into chunks, and all chunks step through the table at once.
White space leads every state to the start, so what follows a chunk's first white space is the same
for every entry state; what goes before it, the chunk's head, is its state map: from an entry state
to (exit state, tokens of the head). A map is held on some entry states only: what the chunk before
leads to when it is entered at the start, then whatever the maps before lead to, until each map's
exits are entries of the next one. Chunks that the same bytes precede share new entries, so that
repeating texts close as fast as others. Maps are then composed by a parallel prefix scan, doubling
the number of chunks that a map spans, which names each chunk's true entry at once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from vitrine.llm import common
from vitrine.llm.wordids import PLAIN, byte_named, layout

END = "\0"
START, APOS, APOS_R, APOS_V, APOS_L = range(5)
_SHORT = {(APOS, "s"): "'s", (APOS, "t"): "'t", (APOS, "m"): "'m", (APOS, "d"): "'d", (APOS_R, "e"): "'re", (APOS_V, "e"): "'ve", (APOS_L, "l"): "'ll"}
_OPEN = {"r": APOS_R, "v": APOS_V, "l": APOS_L}
_HELD = {APOS: "", APOS_R: "r", APOS_V: "v", APOS_L: "l"}
WIDTH, BIAS, SHIFT, PART = 128, 128, 8, "part"
#: States a table has at most, some 3 KB each, and neighbouring tokens remembered; they change speed alone.
MOST_STATES, MOST_PAIRS = 200_000, 2_000_000
BLANKS = bytes.maketrans(b"\t\n\r", b"   ")
#: Control characters, which the plain alphabet lacks, are spelt in two bytes as UTF-8 would if it allowed that.
CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: Columns. White space is 0. Bytes that begin a character have columns of their own, upper-case letters none.
#: Only a character's later bytes can follow its earlier ones, so those share columns with the others.
BEGINS = [b for b in (32, *range(33, 65), *range(91, 127), *range(0xC0, 0xF5))]
COLUMN = np.zeros(256, dtype=np.uint8)
COLUMN[BEGINS] = np.arange(len(BEGINS))
COLUMN[0x80:0xC0] = np.arange(1, 65)
#: Bytes before a chunk by which chunks share entry states.
BEFORE = 8
CHUNK = 512
#: Characters given to the library at once, unless one word is longer.
AT_ONCE = 1 << 20


class Full(Exception):
    """A table has all the states it may have."""


class Transducer:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        if layout(config) != "word":
            raise ValueError("only tokenizer files of the 'word' layout can be compiled")
        self.special = [x["content"] for x in config["added_tokens"]]
        mark = config["model"]["end_of_word_suffix"]
        closed = lambda t: t[: -len(mark)] + END if t.endswith(mark) else t
        self.vocabulary = {closed(t) for t in config["model"]["vocab"]}
        self.prefixes = {t[:k] for t in self.vocabulary for k in range(len(t) + 1)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in config["model"]["merges"])
        self.ranks = {(closed(a), closed(b)): r for r, (a, b) in enumerate(pairs)}
        self.pair_ok: dict[tuple[str | None, str], bool] = {}
        self.kinds: dict[str, str] = {}
        self.fresh()

    def fresh(self) -> None:
        self.keys: list = [START, APOS, APOS_R, APOS_V, APOS_L]
        self.numbers = {k: k for k in self.keys}
        self.table = np.full(4096 * WIDTH, -1, dtype=np.int32)

    # the tokenizer's own merging, used on pairs of tokens only

    def merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            rank, i = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 30:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    @staticmethod
    def symbols(text: str) -> list[str]:
        out = list(text.removesuffix(END))
        if text.endswith(END):
            out[-1] += END
        return out

    def follows(self, before: str | None, token: str) -> bool:
        """Whether token after before (None: at the word's beginning) is how their text is encoded."""
        known = self.pair_ok.get((before, token))
        if known is None:
            if len(self.pair_ok) >= MOST_PAIRS:
                self.pair_ok.clear()
            want = [token] if before is None else [before, token]
            known = self.pair_ok[before, token] = self.merged(self.symbols("".join(want))) == want
        return known

    # states inside a pre-token: (kind, suffix, ((distance, last token, count less the present count), ...))

    def extended(self, state: tuple, byte: str) -> tuple[tuple, int]:
        kind, suffix, ends = state
        text = suffix + byte
        last = change = None
        for distance, before, count in ends:  # far to near
            token = text[len(suffix) - distance :]
            if token in self.vocabulary and self.follows(before, token):
                last, change = token, count + 1
                break
        assert last is not None and change is not None
        grown = [(d + 1, t, c - change) for d, t, c in ends] + [(0, last, 0)]
        while text not in self.prefixes:
            text = text[1:]
        return (kind, text, tuple(x for x in grown if x[0] <= len(text) and (x[0] == 0 or text[len(text) - x[0] :] in self.prefixes))), change

    def begun(self, kind: str, text: str) -> tuple[tuple, int]:
        state, total = (kind, "", ((0, None, 0),)), 0
        for byte in byte_named(text):
            state, n = self.extended(state, byte)
            total += n
        return state, total

    def closing(self, state: tuple) -> int:
        _, suffix, ends = state
        for distance, before, count in ends:
            token = suffix[len(suffix) - distance :] + END
            if distance and token in self.vocabulary and self.follows(before, token):
                return count + 1
        raise AssertionError("each word has an encoding")

    def alone(self, text: str, kind: str = "O") -> int:
        state, n = self.begun(kind, text)
        return n + self.closing(state)

    def kind(self, c: str) -> str:
        """L letter, N number, S white space, O other: asked from the library itself."""
        found = self.kinds.get(c)
        if found is None:
            got = [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(f"a{c}a")]
            twice = self.library.pre_tokenizer.pre_tokenize_str(c + c)
            found = "L" if len(got) == 1 else "S" if not twice else "N" if len(twice) == 2 else "O"
            self.kinds[c] = found
        return found

    def step(self, state, c: str) -> tuple[object, int]:
        """The next state and the tokens emitted, for any character of a normalised text."""
        kind = self.kind(c)
        if isinstance(state, tuple):
            if state[0] == kind:
                n = 0
                for byte in byte_named(c):
                    state, k = self.extended(state, byte)
                    n += k
                return state, n
            done = self.closing(state)
            after, n = self.step(START, c)
            return after, done + n
        if state == START:
            if kind == "S":
                return START, 0
            if c == "'":
                return APOS, 0
            return (START, self.alone(c)) if kind == "N" else self.begun(kind, c)
        if (state, c) in _SHORT:
            return START, self.alone(_SHORT[state, c])
        if state == APOS and c in _OPEN:
            return _OPEN[c], 0
        if state == APOS and kind == "O":
            return self.begun("O", "'" + c)
        n, after = self.alone("'"), START
        if _HELD[state]:
            after, k = self.begun("L", _HELD[state])
            n += k
        after, k = self.step(after, c)
        return after, n + k

    def after(self, key, column: int) -> tuple[object, int]:
        """The next state and the tokens emitted, for one byte of UTF-8 by its column."""
        if not (isinstance(key, tuple) and key[0] == PART):
            if BEGINS[column] < 0x80:
                return self.step(key, chr(BEGINS[column]))
            return (PART, key, bytes([BEGINS[column]])), 0
        _, state, held = key
        if not 0 < column <= 64:  # no character goes on like that; only a wrongly guessed entry could meet it
            return self.after(state, column)
        held += bytes([0x7F + column])
        if len(held) < (2 if held[0] < 0xE0 else 3 if held[0] < 0xF0 else 4):
            return (PART, state, held), 0
        return self.step(state, chr((held[0] & 0x1F) << 6 | held[1] & 0x3F) if len(held) == 2 else held.decode(errors="replace"))

    # the dense table

    def number(self, key) -> int:
        found = self.numbers.get(key)
        if found is None:
            if len(self.keys) >= MOST_STATES:
                raise Full
            found = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) * WIDTH > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, dtype=np.int32)])
        return found

    def compiled(self, cells: np.ndarray) -> None:
        for cell in np.unique(cells).tolist():
            after, n = self.after(self.keys[cell // WIDTH], cell % WIDTH)
            if not -BIAS <= n < BIAS:
                raise Full
            at = self.number(after)
            self.table[cell] = at << SHIFT | n + BIAS

    def run(self, columns: np.ndarray, states: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Steps all lanes through columns (steps x lanes) at once; out gets what each step emits."""
        for k in range(len(columns)):
            cells = states * WIDTH + columns[k]
            found = self.table.take(cells)
            if found.min(initial=0) < 0:
                self.compiled(cells[found < 0])
                found = self.table.take(cells)
            out[k] = (found & (1 << SHIFT) - 1) - BIAS
            states = found >> SHIFT
        return states

    def heads(self, by_step: np.ndarray, lengths: np.ndarray, chunks: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For chunks entered in some states: the states after their heads, and the tokens of these."""
        states, counts, live = entries.astype(np.int32), np.zeros(len(chunks), dtype=np.int64), np.arange(len(chunks))
        for k in range(CHUNK):
            live = live[lengths[chunks[live]] > k]
            if not len(live):
                break
            got = np.empty((1, len(live)), dtype=np.int8)
            states[live] = self.run(by_step[k : k + 1, chunks[live]], states[live], got)
            counts[live] += got[0]
        return states, counts

    def maps(self, by_step: np.ndarray, lengths: np.ndarray, resets: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunks' state maps as rows (chunk and entry state in one number, exit state, tokens).

        resets: chunks with white space; exits: each chunk's exit if it is entered at the start.
        """
        lanes = len(exits)
        before = np.zeros(lanes, dtype=np.uint64)
        before[1:] = np.ascontiguousarray(by_step[-BEFORE:, :-1].T).view(np.uint64).ravel()
        inner = np.flatnonzero(np.r_[False, ~resets[:-1]])  # chunks that more than one state may enter
        inner = inner[np.argsort(before[inner], kind="stable")]
        alike = before[inner]
        todo = np.arange(lanes, dtype=np.int64) << 32 | np.r_[0, exits[:-1]]
        known, rows = np.empty(0, dtype=np.int64), []
        while len(todo):
            chunk, entry = todo >> 32, todo & 0xFFFFFFFF
            states, counts = self.heads(by_step, lengths, chunk, entry)
            leave = np.where(resets[chunk], exits[chunk], states).astype(np.int64)
            rows.append((todo, leave, counts))
            known = np.union1d(known, todo)
            on = ~resets[chunk] & (chunk + 1 < lanes)
            todo = np.setdiff1d(chunk[on] + 1 << 32 | leave[on], known)
            if len(todo):
                same, state = np.unique(np.stack([before[todo >> 32], (todo & 0xFFFFFFFF).astype(np.uint64)]), axis=1)
                first, many = np.searchsorted(alike, same), np.searchsorted(alike, same, side="right")
                many -= first
                if many.sum() <= 4 * lanes:
                    at = inner[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    todo = np.setdiff1d(at << 32 | np.repeat(state.astype(np.int64), many), known)
        keys, leave, counts = map(np.concatenate, zip(*rows, strict=True))
        return keys, leave, counts

    def emitted(self, row: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Tokens of each text of a row of bytes. Texts begin at begins and end in white space."""
        n = len(row)
        lanes = -(-n // CHUNK)
        padded = np.zeros(lanes * CHUNK, dtype=np.uint8)
        padded[:n] = COLUMN[row]
        by_step = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
        out = np.zeros((CHUNK, lanes), dtype=np.int8)
        exits = self.run(by_step, np.zeros(lanes, dtype=np.int32), out)
        space = by_step == 0
        resets = space.any(axis=0)
        lengths = np.where(resets, space.argmax(axis=0) + 1, CHUNK)
        of_heads = composed(*self.maps(by_step, lengths, resets, exits), lanes)
        out[np.arange(CHUNK)[:, None] < lengths] = 0
        found = np.add.reduceat(out.T.reshape(-1)[:n], begins, dtype=np.int64)
        # a head ends with the text that its chunk begins in
        np.add.at(found, np.searchsorted(begins, np.arange(lanes) * CHUNK, side="right") - 1, of_heads)
        return found

    def stepped(self, text: str) -> int:
        """Tokens of one text, character by character, without a table."""
        state, total = START, 0
        for c in self.library.normalizer.normalize_str(text) + " ":
            state, n = self.step(state, c)
            total += n
        return total

    def by_library(self, text: str) -> int:
        """Tokens of one text, in parts that end in white space; a word longer than a part is stepped."""
        total = at = 0
        while at < len(text):
            end = len(text)
            if end - at > AT_ONCE:
                end = max(text.rfind(c, at, at + AT_ONCE) for c in " \n\r\t") + 1
                if not end:
                    later = [x for c in " \n\r\t" if (x := text.find(c, at + AT_ONCE)) >= 0]
                    end = min(later) + 1 if later else len(text)
            part, at = text[at:end], end
            total += self.stepped(part) if len(part) > AT_ONCE else len(self.library.encode(part, add_special_tokens=False).ids)
        return total

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text (null: none), added tokens' strings counting one each."""
        totals, parts, owners = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            pieces = [text or ""]
            for s in self.special:
                pieces = [x for p in pieces for x in p.split(s)]
            totals[i] = sum((text or "").count(s) for s in self.special)
            parts += (own := [p for p in pieces if p])
            owners += [i] * len(own)
        if parts:
            rows = [self.normalised(p) for p in parts]
            begins = np.cumsum([0, *[len(r) + 1 for r in rows[:-1]]])
            try:
                found = self.emitted(np.frombuffer(b" ".join([*rows, b""]), dtype=np.uint8), begins).tolist()
            except Full:
                self.fresh()
                found = [self.by_library(p) for p in parts]
            for i, n in zip(owners, found, strict=True):
                totals[i] += n
        return totals

    def normalised(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            return text.lower().encode().translate(BLANKS)
        out = self.library.normalizer.normalize_str(text).encode().translate(BLANKS)
        return CONTROL.sub(lambda m: bytes([0xC0 | m[0][0] >> 6, 0x80 | m[0][0] & 0x3F]), out)


def composed(keys: np.ndarray, leave: np.ndarray, counts: np.ndarray, lanes: int) -> np.ndarray:
    """What each chunk's head emits, by a prefix scan over the rows of state maps()."""
    order = np.argsort(keys)
    keys, leave, counts = keys[order], leave[order], counts[order]
    chunk, to = keys >> 32, np.arange(len(keys))
    on = chunk + 1 < lanes
    to[on] = np.searchsorted(keys, chunk[on] + 1 << 32 | leave[on])
    entered, span = np.zeros(lanes, dtype=np.int64), 1  # each chunk's row; to: the row that is span chunks on
    while span < lanes:
        n = min(span, lanes - span)
        entered[span : span + n] = to[entered[:n]]
        to, span = to[to], 2 * span
    return counts[entered]


@cache
def transducer(path: str) -> Transducer:
    """One per Python worker and file."""
    return Transducer(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of docs, whole texts, one pass, no shuffle.

    Null texts count as empty: 0 bytes, 0 tokens. Rows with equal or null keys stay rows of their
    own. A text of any length, with or without white space, is counted in bounded memory. Other columns of docs are not read, so their names cannot clash. An empty table gives none.
    tokenizer: the path of the file, to be found under the same path by every executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(tokenizer)
        for batch in batches:
            for part in common.slices(batch, 1):
                texts = part.column(1).to_pylist()
                n = fst.counts(texts)
                sizes = pa.compute.fill_null(pa.compute.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
