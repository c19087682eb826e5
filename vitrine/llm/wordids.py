"""Exact token ids of whole texts, remembered by pre-token.

A byte-pair tokenizer cuts a text into pre-tokens and encodes each alone, so the ids of a
pre-token never depend on its neighbours. Texts whose characters all lie in a plain alphabet
(printable ASCII, tab, newline, return, and the Latin-1 letters) are cut here by the
tokenizer file's own pattern, each distinct pre-token of some texts is looked up once, and only
pre-tokens not met before go to the library. Any other
text, any text that holds an added token's string, and any file with another layout go to the
library whole. Either way the ids are those of Tokenizer.encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_LOW, _ANY = "a-zß-öø-ÿ", "A-Za-zÀ-ÖØ-öø-ÿ"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_TAIL = "'(?:[stmd]|re|ve|ll)"  # the same, for alternatives that begin otherwise to be tried first
#: Pre-token patterns over the plain alphabet, by layout; fixed values that follow the tokenizer files.
WORD_END = re.compile(rf"[{_LOW}]+|{_TAIL}|[0-9]|[^\s0-9{_LOW}]+")
BYTE_LEVEL = re.compile(rf" ?[{_ANY}]+|{_TAIL}| ?[0-9]+| ?[^\s0-9{_ANY}]+|\s+(?!\S)|\s+")
#: Bytes of remembered pre-tokens, and of an entry beside its two strings; they change speed alone. When half of
#: the bytes are new, what was not asked for since the last time is forgotten.
REMEMBERED, ENTRY = 96 << 20, 190


#: A blank between two other characters, where each layout begins a new pre-token or has none; long texts are cut there.
BLANK = re.compile(r"(?<=\S) (?=\S)")
STRETCH = 1 << 20

#: Byte-level tokenizers name printable bytes by themselves and the rest by code points from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}


def byte_named(text: str) -> str:
    """A text as byte-level tokenizers see it: one character for each UTF-8 byte."""
    return text.encode().decode("latin-1").translate(BYTE_NAMES)


def layout(config: dict) -> str | None:
    """'word' (lower case, word ends), 'byte' (byte level with its own pattern), or None."""
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "byte"
    steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    split = parts[0].get("pattern", {}).get("Regex") if parts else None
    if steps == ["NFC", "Replace", "Lowercase"] and split == rf"{_SHORT}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+":
        return "word"
    return None


class WordIds(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.library, self.held = Tokenizer.from_file(path), 0
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.added = [x["content"] for x in config.get("added_tokens", [])]
        self.layout = layout(config)
        self.cut = {"word": WORD_END, "byte": BYTE_LEVEL}.get(self.layout or "", None)

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = array("I", [x.id for x in self.library.model.tokenize(byte_named(piece))]).tobytes()
        size = ENTRY + len(piece) * (1 if piece.isascii() else 2) + len(found)
        if self.held + size > REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0
        if size <= REMEMBERED // 2:
            self[piece] = found
            self.held += size
        return found

    def plain(self, text: str) -> bool:
        return self.cut is not None and PLAIN.fullmatch(text) is not None and not any(x in text for x in self.added)

    def stretches(self, text: str) -> Iterator[str]:
        """A text in parts of about STRETCH characters whose pre-tokens are those of the text, as far as blanks allow."""
        begin = 0
        while len(text) - begin > STRETCH and (at := BLANK.search(text, begin + STRETCH)):
            yield text[begin : at.start()]
            begin = at.start()
        yield text[begin:] if begin else text

    def _looked_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, how many each has)."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        each = list(map(self.__getitem__, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
        flat, at = np.frombuffer(b"".join(each), dtype="<u4"), coded.indices.to_numpy()
        many = sizes[at]
        first = (np.cumsum(sizes) - sizes)[at] - (np.cumsum(many) - many)
        return flat[np.repeat(first, many) + np.arange(many.sum())], many

    def each(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """For each whole text (null: empty) its ids, as unsigned 32-bit numbers."""
        out: list[np.ndarray] = []
        pieces: list[str] = []
        waiting: list[tuple[int, int, int]] = []  # text, its first and last piece

        def look_up() -> None:
            if pieces:
                ids, many = self._looked_up(pieces)
                ends = np.append(0, np.cumsum(many))
                for i, a, b in waiting:
                    new = ids[ends[a] : ends[b]]
                    out[i] = new if not len(out[i]) else np.concatenate([out[i], new])
            pieces.clear(), waiting.clear()

        for i, text in enumerate(texts):
            out.append(np.empty(0, dtype="<u4"))
            if not text:
                continue
            if not self.plain(text):
                out[i] = np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
                continue
            for part in self.stretches(text.lower() if self.layout == "word" else text):
                begin = len(pieces)
                pieces += self.cut.findall(part)
                waiting.append((i, begin, len(pieces)))
                if len(pieces) > STRETCH // 2:
                    look_up()
        look_up()
        return out

    def ids(self, text: str | None) -> bytes:
        """The ids of the whole text (null: empty) as little-endian unsigned 32-bit bytes."""
        return self.each([text])[0].tobytes()


@cache
def word_ids(path: str) -> WordIds:
    """One per Python worker and file."""
    return WordIds(path)
