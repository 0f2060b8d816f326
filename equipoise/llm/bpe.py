"""Encoding of many texts with a tokenizer of the ``tokenizers`` library, remembering words."""

from __future__ import annotations

import os
import re
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from equipoise.llm.common import AT_TASK_END

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core

#: Texts that are encoded together, in bytes: words they share are looked up once.
ENCODE_BYTES = 1 << 22
#: Bytes of the words and ids that a worker remembers, and what a word takes besides its own; further ones are encoded each time.
REMEMBERED_BYTES, WORD_BYTES = 128 << 20, 220
#: The same for a lean encoder, which forgets its words at the end of a task and leaves memory to what runs beside it.
LEAN_ENCODE_BYTES, LEAN_REMEMBERED_BYTES = 1 << 20, 16 << 20
MOST_SIGNS = 4096
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space between other white space: there the tokenizer's pieces may cross the space.
INNER_SPACE = rf"{WHITE} ({WHITE}|\z)|\A \z"
TAIL = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)\Z")


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text, to be sent to the executors; its size has the bound of a vocabulary."""
    return Path(path).read_text(encoding="utf-8")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, equal to the library's.

    A text is cut at single spaces; the pieces' ids are encoded once by the library and remembered.
    That is exact where the tokenizer splits before a space that stands between other characters (byte
    level with its regular expression), or drops white space (word ends). Texts for which it may not
    be are encoded whole. Letters with ASCII signs behind them are two pieces for both kinds.
    """

    def __init__(self, definition: str, lean: bool = False):
        from tokenizers import Tokenizer

        self.library, self.lean = Tokenizer.from_str(definition), lean
        self.drops_space = not self._ids(" ") and self._ids("a b") == self._ids("a") + self._ids("b")
        vocabulary = self.library.get_vocab()
        marks = (lambda t: t.endswith("</w>")) if self.drops_space else (lambda t: t.startswith("Ġ"))
        self.mark = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.mark[[i for t, i in vocabulary.items() if marks(t)]] = True
        self.newline = b"" if self.drops_space else self._ids("\n")
        self.cuts = self.drops_space or (self.newline and self._ids("a b") == self._ids("a") + self._ids(" b"))
        self.forget()

    def forget(self) -> None:
        self.spaced: dict[str, bytes] = {}  # ids of " " + word
        self.bare: dict[str, bytes] = self.spaced if self.drops_space else {}
        self.signs: dict[str, bytes] = {}
        self.step: dict[str, bytes] = {}  # of the words encoded now
        self.room = LEAN_REMEMBERED_BYTES if self.lean else REMEMBERED_BYTES

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _bulk(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters, with a space before each, in one call; the result is cut at the tokens that begin (or end) a word."""
        ids = self._fast([" " + " ".join(words)])[0]
        at = np.flatnonzero(self.mark[ids])
        if len(at) != len(words):
            return {}
        bounds = np.concatenate([[0], at + 1]) if self.drops_space else np.append(at, len(ids))
        raw = ids.tobytes()
        return {w: raw[4 * a : 4 * b] for w, a, b in zip(words, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)}

    def _word(self, word: str, spaced: bool) -> bytes:
        known = self.spaced if spaced else self.bare
        if (value := known.get(word)) is not None or (known is self.spaced and (value := self.step.get(word)) is not None):
            return value
        lines = word.split("\n") if "\n" in word else ()
        if len(lines) > 1 and all(lines) and not any(map(str.isspace, word.replace("\n", ""))):
            value = self._word(lines[0], spaced) + b"".join(self.newline + self._word(x, False) for x in lines[1:])
        elif (parts := TAIL.match(word)) and parts[1].lower().isalpha():
            value = self._word(parts[1], spaced) + self._sign(parts[2])
        else:
            value = self._ids(" " + word if spaced else word)
        self._remember(known, word, value)
        return value

    def _sign(self, text: str) -> bytes:
        """ASCII signs behind a word: there are few, and most words need one, so they are kept apart from the words."""
        if (value := self.signs.get(text)) is None:
            value = self._ids(text)
            if len(self.signs) < MOST_SIGNS and len(text) < 8:
                self.signs[text] = value
        return value

    def _remember(self, known: dict[str, bytes], word: str, value: bytes) -> None:
        if self.room > 0:
            self.room -= len(word) + len(value) + WORD_BYTES
            known[word] = value

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it. Words that the task does not remember are encoded together.

        A byte-level tokenizer begins a token with a space at each of them and nowhere else, so all words
        without white space, or with single line breaks inside, come apart again. One with word ends marks
        every piece of a word, so only words of letters do, and others are put together from those.
        """
        values = [*map(self.spaced.get, words)]
        missing = [i for i, v in enumerate(values) if v is None]
        if self.drops_space:
            together = dict.fromkeys(m[1] if (m := TAIL.match(w)) else w for w in map(words.__getitem__, missing))
            together = [w for w in together if w not in self.spaced and w.lower().isalpha()]
        else:
            together = [w for w in map(words.__getitem__, missing) if (p := w.split()) and (p[0] == w or p == w.split("\n"))]
        self.step = self._bulk(together) if together else {}
        for word, value in self.step.items():
            if self.room <= 0:
                break
            self._remember(self.spaced, word, value)
        get = self.step.get
        for i in missing:
            values[i] = get(words[i]) or self._word(words[i], True)
        return values

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, without special tokens, and the bounds of each text; null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = np.ones(len(texts), dtype=bool)
        if self.cuts:
            whole = np.zeros(len(texts), dtype=bool) if self.drops_space else pc.match_substring_regex(texts, INNER_SPACE).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        counts = np.diff(parts.offsets.to_numpy())
        coded = parts.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = self._words(words)
        # the first word of a text has no space before it
        firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        bare = [self._ids(t) if w else self._word(words[i], False) for t, w, i in zip(texts.to_pylist() if whole.any() else [""] * len(texts), whole, index[firsts], strict=True)]
        index[firsts] = len(values) + np.arange(len(firsts))
        values += [b"" if not v else v for v in bare]
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        source = np.frombuffer(b"".join(values), dtype=np.uint32)
        begins, sizes_of = (np.cumsum(sizes) - sizes)[index], sizes[index]
        ends = np.cumsum(sizes_of)
        total = int(ends[-1]) if len(ends) else 0
        self.step = {}
        ids = source[np.repeat(begins - (ends - sizes_of), sizes_of) + np.arange(total)]
        return ids, np.concatenate([[0], ends[np.cumsum(counts) - 1]]).astype(np.int64)


_current: list[tuple[str, Encoder]] = []


def encode_bytes(lean: bool) -> int:
    return LEAN_ENCODE_BYTES if lean else ENCODE_BYTES


def encoder(definition: str, lean: bool = False) -> Encoder:
    """The worker's encoder, made anew for another tokenizer."""
    if not _current or _current[0][0] != definition or _current[0][1].lean != lean:
        _current[:] = [(definition, Encoder(definition, lean))]
    return _current[0][1]


def _forget_words() -> None:
    for _, known in _current:
        if known.lean:
            known.forget()


AT_TASK_END.append(_forget_words)
