"""Token ids of texts with a public tokenizer file, remembering what parts of texts gave."""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RUN = re.compile(r"\s\s")
# A blank between two other characters always starts a new part for a byte-level tokenizer of
# this kind, so parts between such blanks can be encoded on their own.
_BLANK = re.compile(r"(?<=\S) (?=\S)")
# Signs that form one unit when they follow letters. Apostrophes may start a contraction instead.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LIMIT = 192 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letters that byte-level vocabularies write for bytes 0..255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class _Memo(dict):
    """Ids of parts that follow a blank, made on first use; ``held`` estimates their bytes.

    Parts that an older memo knows are taken from there.
    """

    def __init__(self, coder: "Encoder", older: dict[str, bytes]):
        self.coder, self.older, self.held = coder, older, 0

    def __missing__(self, part: str) -> bytes:
        coder = self.coder
        known = self.older.get(part)
        if known is not None:
            value = known
        elif part.isalpha():
            value = coder.unit(" " + part)
        else:
            word = part.rstrip(_SIGNS)
            if word and word.isalpha():
                value = self[word] + coder.signs(part[len(word):])
            else:
                value = coder.any_part(" ", part)
        self[part] = value
        self.held += 150 + len(part) + len(value)
        return value


class Encoder:
    """Ids as bytes of little-endian unsigned 32-bit numbers.

    Words repeat far more often than the tokenizer's own cache can hold, so each distinct part
    of a text is encoded once while it stays in a memo of bounded size. Letters followed by signs
    go straight to the tokenizer's model, anything else through the whole tokenizer.

    With ``generations`` a full memo becomes the older one, from which parts that are met again
    are taken over, so that frequent parts stay; both together hold about ``limit`` bytes.
    """

    def __init__(self, path: str, limit: int = _LIMIT, generations: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(_byte_letters()))
        self.limit, self.generations = limit // 2 if generations else limit, generations
        self.parts = _Memo(self, {})
        self.known_signs: dict[str, bytes] = {}

    def unit(self, unit: str) -> bytes:
        """Ids of one unit of the tokenizer's own splitting."""
        if unit.isascii() and unit != "\n":
            spelled = unit.replace(" ", self.letters[32])
        else:
            spelled = unit.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(spelled)]).tobytes()

    def signs(self, signs: str) -> bytes:
        if signs not in self.known_signs:
            if len(self.known_signs) > 10_000:
                self.known_signs.clear()
            self.known_signs[signs] = self.unit(signs)
        return self.known_signs[signs]

    def any_part(self, lead: str, part: str) -> bytes:
        out = []
        whole = lead + part
        for number, line in enumerate(part.split("\n")):
            if number:
                out.append(self.signs("\n"))
                lead = ""
            word = line.rstrip(_SIGNS)
            if not line or (word and not word.isalpha()):
                ids = self.tokenizer.encode(whole, add_special_tokens=False).ids
                return array("I", ids).tobytes()
            signs = line[len(word):]
            if not word:
                out.append(self.signs(lead + signs))
                continue
            out.append(self.parts[word] if lead else self.unit(word))
            if signs:
                out.append(self.signs(signs))
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every whole text; a null text has none."""
        out = []
        part_ids = self.parts.__getitem__
        collecting = gc.isenabled()
        gc.disable()  # the memo's entries hold no cycles, but every collection would visit them
        try:
            for text in texts:
                if not text:
                    out.append(b"")
                    continue
                if _RUN.search(text) or text[0] == " " or text[-1] == " ":
                    parts = _BLANK.split(text)
                else:
                    parts = text.split(" ")
                first = self.any_part("", parts[0])
                del parts[0]
                out.append(first + b"".join(map(part_ids, parts)))
                if self.parts.held > self.limit:
                    older = self.parts if self.generations else {}
                    self.parts.older = {}
                    self.parts = _Memo(self, older)
                    part_ids = self.parts.__getitem__
        finally:
            if collecting:
                gc.enable()
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str | None = None, limit: int = _LIMIT, generations: bool = False) -> Encoder:
    """The encoder of this Python worker for a tokenizer file."""
    key = (path or tokenizer_path(), limit, generations)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def slices(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The ranges of ``by_size`` for the texts in a batch's second column, still in Arrow."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    low = before = 0
    while low < len(ends):
        high = min(len(ends), int(np.searchsorted(ends, before + most)) + 1)
        yield batch.slice(low, high - low)
        low, before = high, ends[high - 1]


def by_size(texts: list[str | None], most: int = 1 << 21):
    """Ranges of a batch with about ``most`` characters each, so that memory stays bounded."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
