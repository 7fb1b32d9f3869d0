"""Token ids by a byte-level tokenizers file, with the ids of words remembered as bytes.

For tokenizers that keep every byte and cut texts into words with at most one
leading space, as ``byte_bpe_50k.json`` does. A space that stands beside a
visible character always begins a word, a line feed between two visible ones is
a word of its own, and a word of letters ends where punctuation begins; so the
ids of a text are those of its parts between such places, one after the other.
What isn't known to be cut there goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterable, Iterator

from .common import claim
from .tokens import _PLAIN, _byte_letters

#: Chunks and words that a worker remembers, and the longest it remembers.
REMEMBER, LONGEST = 400_000, 64
#: ASCII punctuation; it ends a word of letters, but what follows an apostrophe may not.
_TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Bytes that begin a character that may be white space.
_UNSURE = frozenset([*range(33), 127, 0xC2, 0xE1, 0xE2, 0xE3])
_SURE_SPACE = re.compile(rb" (?=[!-~])")
#: The line feed first: it is searched for.
_SURE_LINE = re.compile(rb"\n(?<=[!-~]\n)(?=[!-~])")
_PROBES = [" a", "the", " straße", "été", " ungewöhnlich", " ÿzq", "niño"]


class ByteTokenizer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.whole.get_added_tokens_decoder().values()) or b"(?!)")
        letters = _byte_letters()
        self.letters = "".join(letters.get(b, chr(b)) for b in range(256))
        #: Ids of chunks after a space or, where they begin with one, after a sure line feed; None where it isn't sure.
        self.known: dict[bytes, bytes | None] = {}
        #: Ids of words of letters after a space, and of all other parts.
        self.spaced: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.direct = all(self._word(w.encode()) == self._encoded(w.encode()) for w in _PROBES)
        self.line = self._encoded(b"\n")

    def _word(self, word: bytes) -> bytes:
        """Ids of a word that pre-tokenization leaves whole."""
        return array("I", [t.id for t in self.model.tokenize(charmap_decode(word, "strict", self.letters)[0])]).tobytes()

    def _encoded(self, part: bytes) -> bytes:
        return array("I", self.whole.encode_batch_fast([part.decode("utf-8", "replace")], add_special_tokens=False)[0].ids).tobytes()

    def _remembered(self, part: bytes, plain: bool) -> bytes:
        ids = self.words.get(part)
        if ids is None:
            ids = self._word(part) if plain and self.direct else self._encoded(part)
            if len(part) <= LONGEST:
                self.words[part] = ids
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of text between sure places: an optional space, a word, punctuation."""
        core = chunk.rstrip(_TAIL)
        word = core.removeprefix(b" ")
        if word.isalpha() or _PLAIN(word.decode("utf-8", "replace")):
            return self._remembered(core, True) + (self._remembered(chunk[len(core) :], False) if len(core) < len(chunk) else b"")
        if b"\n" in word:
            lines = _SURE_LINE.split(chunk)
            if len(lines) > 1:
                return self.line.join(map(self._chunk, lines))
        return self._remembered(chunk, False)

    def _learn(self, fresh: Iterable[bytes]) -> None:
        """Ids of chunks with the space or line feed before them; None for those that may begin with white space, or with nothing."""
        known, spaced, words, letters, tokenize = self.known, self.spaced, self.words, self.letters, self.model.tokenize
        for chunk in fresh:
            core = chunk.rstrip(_TAIL)
            if self.direct and (core.isalpha() or _PLAIN(core.decode("utf-8", "replace"))):  # the most common case, without detours
                ids = spaced.get(core)
                if ids is None:
                    spaced[core] = ids = array("I", [t.id for t in tokenize(charmap_decode(b" " + core, "strict", letters)[0])]).tobytes()
                if len(core) < len(chunk):
                    tail = chunk[len(core) :]
                    ids += words.get(tail) or self._remembered(tail, False)
                known[chunk] = ids
            elif chunk[:1] == b"\n" and len(chunk) > 1 and chunk[1] not in _UNSURE:
                known[chunk] = self.line + self._chunk(chunk[1:])
            else:
                known[chunk] = None if not chunk or chunk[0] in _UNSURE else self._chunk(b" " + chunk)

    def _carefully(self, text: bytes) -> bytes:
        if self.special.search(text):
            return self._encoded(text)
        first, *others = _SURE_SPACE.split(text)
        return self._chunk(first) + b"".join(self._chunk(b" " + c) for c in others)

    def ids(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        texts = list(texts)
        # A line feed after a space is no sure one, and what it begins must not pass for one.
        split = [[t] if b" \n" in t else _SURE_LINE.sub(b" \n", t).split(b" ") for t in texts]
        wanted: set[bytes] = set().union(*[chunks[1:] for chunks in split])
        fresh = wanted.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBER:
            self.known = {c: self.known[c] for c in wanted.difference(fresh)}
        for held in (self.spaced, self.words):
            if len(held) > REMEMBER:
                held.clear()
        self._learn(fresh)
        look = self.known.__getitem__
        for text, (first, *chunks) in zip(texts, split):
            try:
                if b" \n" in text or self.special.search(text):
                    yield self._carefully(text)
                else:
                    yield self._chunk(first) + b"".join(map(look, chunks))
            except TypeError:  # a chunk without ids of its own
                yield self._carefully(text)
        for chunk in fresh:
            if len(chunk) > LONGEST:
                del self.known[chunk]
                self.spaced.pop(chunk.rstrip(_TAIL), None)


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def byte_tokenizer(path: str) -> ByteTokenizer:
    """One per worker process, until another operator works there."""
    claim("byte tokens", _TOKENIZERS.clear)
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]
