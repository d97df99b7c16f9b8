"""Token ids by the tokenizers library, piece by piece: equal pieces of a partition's texts are encoded once.

Most of the library's time goes into its normalizer and pre-tokenizer. Pieces of plain Latin letters with closing punctuation
are cut here in the same way, and only the library's BPE model sees their words; all other pieces take the whole pipeline.
An added token written out in a text, such as <|endoftext|>, has its own id, as in the library's plain call.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

from brickloom.llm.common import pieces

END = array("I", [2]).tobytes()
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u0237"  # letters of every Unicode version in use
_PLAIN = re.compile(rf" ?[{_LETTERS}]+[.,;:!?]*(?:\n[{_LETTERS}]+[.,;:!?]*)*")
_PARTS = re.compile(rf" ?[{_LETTERS}]+|[.,;:!?]+|\n")
_OPEN: dict[str, Pieces] = {}


def _byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others counted up from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Words(dict):
    """Ids of plain words by the library's model."""

    def __init__(self, tok, lower: bool):
        self.model, self.lower, self.table = tok.model, lower, _byte_characters()

    def __missing__(self, word: str) -> bytes:
        if len(self) > 400_000:
            self.clear()
        form = word.lstrip(" ").lower() if self.lower else word
        if not form.isascii():
            form = form.encode().decode("latin-1").translate(self.table)
        elif form[0] == " ":
            form = self.table[32] + form[1:]
        tokens = self.model.tokenize(form)
        self[word] = ids = array("I", [t.id for t in tokens]).tobytes()
        return ids


class Pieces(dict):
    """Ids of pieces that follow a blank; the text's first piece is looked up by ``encode`` alone."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # a vocabulary that normalizes drops white space and lowers case
        self.lower = self.tok.normalizer is not None
        self.words = Words(self.tok, self.lower)
        self.marks: dict[str, bytes] = {}

    def whole(self, piece: str) -> bytes:
        return array("I", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, piece: str) -> bytes:
        core = piece.removeprefix(" ")
        if core.isascii() and core.isalpha():
            return self.words[piece]
        if not _PLAIN.fullmatch(piece) or self.lower and not unicodedata.is_normalized("NFC", piece) or "\u0130" in piece:
            return self.whole(piece)
        out = []
        for part in _PARTS.findall(piece):
            if part[-1].isalpha():
                out.append(self.words[part])
            else:
                if part not in self.marks:
                    self.marks[part] = self.whole(part)
                out.append(self.marks[part])
        return b"".join(out)

    def __missing__(self, piece: str) -> bytes:
        if len(self) > 400_000:
            self.clear()
        self[piece] = ids = self.encode(" " + piece)
        return ids


def token_ids(path: str, texts: list[str | None]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of every text, with id 2 at the end; a null text is empty."""
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)  # one tokenizer and memory per worker process and vocabulary file
    known, out = _OPEN[path], []
    for text in texts:
        cut = pieces(text or "")
        first = [known.encode(cut[0])] if cut else []
        out.append(b"".join([*first, *[known[p] for p in cut[1:]], END]))
    return out
