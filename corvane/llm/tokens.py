"""Token ids by a tokenizers file, with the ids of text chunks remembered as bytes.

For tokenizers that lower the case and drop white space, so that the ids of a
chunk between white space don't depend on its neighbours, as
``word_bpe_49k.json`` does. A chunk that isn't known is cut once more, before
its trailing ASCII punctuation; what is then a plain lower-case word goes to
the tokenizer's model directly, all else through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

from .common import claim, trim

#: Chunks and parts of chunks that a worker remembers, and the longest it remembers.
REMEMBER, LONGEST = 100_000, 48
#: ASCII punctuation, but for the apostrophe, which may begin a token with the letters after it.
_TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Words of which normalisation lowers the case and nothing else, and which pre-tokenization keeps whole.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_PROBES = ["a", "the", "straße", "été", "ungewöhnlich", "ÿzq", "niño"]


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models use for bytes: visible Latin-1 stands for itself, the others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkTokenizer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        added = [re.escape(t.content.lower().encode()) for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(added) or b"(?!)")
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.direct = True
        self.direct = all(self._word(w) == self._encoded([w])[0] for w in _PROBES)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _encoded(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, chunks: Iterable[bytes]) -> None:
        """Add chunks to the known ones; ASCII words with a tail of punctuation take the short way."""
        parts, known, word = self.parts, self.known, self._word
        later = []
        for chunk in chunks:
            core = chunk.rstrip(_TAIL)
            if core.isalpha() and self.direct:
                lower = core.lower()
                ids = parts.get(lower)
                if ids is None:
                    parts[lower] = ids = word(lower.decode())
                if len(core) == len(chunk):
                    known[chunk] = ids
                    continue
                tail = parts.get(chunk[len(core) :])
                if tail is not None:
                    known[chunk] = ids + tail
                    continue
            later.append(chunk)
        if later:
            self._learn_odd(later)

    def _learn_odd(self, chunks: list[bytes]) -> None:
        parts, cut, odd = self.parts, [], []
        for chunk in chunks:
            lower = chunk.lower()
            core = lower.rstrip(_TAIL)
            word = core.decode("utf-8", "replace")
            plain = _PLAIN(word)
            if plain:
                word = word.lower()
                core, tail = word.encode(), lower[len(core) :]
            elif self.special.search(lower):  # an added token, which must keep its case and its end
                core, word = chunk, chunk.decode("utf-8", "replace")
                tail = b""
            elif not core[-1:].isalnum():  # its end and the punctuation may be one token
                core, word, tail = lower, lower.decode("utf-8", "replace"), b""
            else:
                tail = lower[len(core) :]
            cut.append((chunk, core, tail))
            if core not in parts:
                if self.direct and plain:
                    parts[core] = self._word(word)
                else:
                    parts[core] = b""
                    odd.append(core)
            if tail not in parts:
                parts[tail] = b""
                odd.append(tail)
        for part, ids in zip(odd, self._encoded([p.decode("utf-8", "replace") for p in odd])):
            parts[part] = ids
        for chunk, core, tail in cut:
            self.known[chunk] = parts[core] + parts[tail]

    def ids(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [t.split() for t in texts]  # at ASCII white space only
        wanted: set[bytes] = set().union(*split)
        fresh = wanted.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBER:
            self.known = {c: self.known[c] for c in wanted.difference(fresh)}
        self._learn(fresh)
        look = self.known.__getitem__
        for chunks in split:
            yield b"".join(map(look, chunks))
        for chunk in fresh:
            if len(chunk) > LONGEST:
                del self.known[chunk]
                for part in (chunk, chunk.lower(), chunk.lower().rstrip(_TAIL)):
                    self.parts.pop(part, None)
        if len(self.parts) > REMEMBER:
            self.parts = {}


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process, until another operator works there."""
    claim("tokens", _TOKENIZERS.clear)
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
        trim()  # what reading the file took
    return _TOKENIZERS[path]
