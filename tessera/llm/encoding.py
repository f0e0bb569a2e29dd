"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

A byte-level BPE never merges across the pieces of its splitting pattern, so a text may be cut into
pieces first, the pieces encoded on their own and the ids strung together: the result equals that of the
whole text. Pieces repeat, so a cache of their ids replaces most of the work. The cache is bounded and
only saves time. The pattern is spelt out for characters up to U+00FF, where letter, digit and space
classes are settled; other texts are cut only before single spaces, which is safe for any character.

The ids are those of the library's plain call, encode(text, add_special_tokens=False). So strings of added tokens, such
as <|endoftext|>, become their ids wherever they stand: texts are cut at them first.
"""

from __future__ import annotations

import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_PIECES = re.compile(f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A space that is followed by a character other than white space begins a token, whatever stands before.
_CUT = re.compile(r"(?= \S)")
#: Pieces in each of the cache's two generations, and characters of the longest piece that it keeps.
CACHE, LONGEST = 250_000, 48

_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(text: str) -> tuple[list[str], bool]:
    """The pieces of a text, and whether each is one piece of the tokenizer's own pattern."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _CUT.split(text), False
    return _PIECES.findall(text), True


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {c: array("I", [i]).tobytes() for c, (i, _) in added.items()}
        self.plain = not any(t.single_word or t.lstrip or t.rstrip for _, t in added.values())  # else where they match depends on what stands around
        self.cut = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the generation before: what is used again moves on, the rest goes

        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def _one(self, piece: str) -> bytes:
        """Ids of one piece of the pattern, by the merges of the library's model alone."""
        letters = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _parts(self, text: str | None) -> list[tuple[str, bool]]:
        """The texts between added tokens, and those tokens (True)."""
        if not text:
            return []
        if self.cut is None:
            return [(text, False)]
        return [(p, k % 2 == 1) for k, p in enumerate(self.cut.split(text)) if p]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is an empty text."""
        if self.cut is not None and any(t and self.cut.search(t) for t in texts):
            return [self._with_added(t) for t in texts]
        return self._encode(texts)

    def _with_added(self, text: str | None) -> bytes:
        if not self.plain and text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        parts = self._parts(text)
        ids = iter(self._encode([p for p, special in parts if not special]))
        return b"".join(self.added[p] if special else next(ids) for p, special in parts)

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        cut, single, mixed = [], set(), set()
        for t in texts:
            p, one = pieces(t) if t else ([], True)
            cut.append(p)
            (single if one else mixed).update(p)
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        missing = (single | mixed) - known.keys()
        again = missing & before.keys()
        known.update((c, before[c]) for c in again)
        missing -= again
        whole = list(missing & mixed)
        known.update((c, array("I", e.ids).tobytes()) for c, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True))
        fresh = missing - mixed
        known.update((c, self._one(c)) for c in fresh)
        get = known.__getitem__
        out = [b"".join(map(get, p)) for p in cut]
        for c in missing:
            if len(c) > LONGEST:
                del known[c]
        return out
