"""Token ids of whole texts by the ``tokenizers`` library, with each distinct
pre-token encoded once per worker.

A text of common characters (ASCII, Latin letters, usual marks: ``ODD`` finds any
other) is split into its pre-tokens by a regular expression, and each goes to the
library's BPE model.  Of any other text the pieces between blanks are looked
at: neither tokenizer family kept here lets a pre-token cross from a non-blank to a
blank, so a piece with an odd character goes through the library's full pipeline, and the
rest as above.  A text that holds a special token's string goes through the pipeline whole.

Pre-tokens repeat, so their ids are kept: at most ``KEPT_BYTES`` (or what the caller says) of the newest and
those asked for among as many before them, none longer than ``KEPT_LENGTH`` characters.  This
bounds memory, not the result, to some 128 MB a worker, until a pass of another operator
begins there (``common.frames``).  ``tests/llm/`` holds the result against the library's plain call on whole texts.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from codesieve.llm.common import RESIDENT

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"  # without U+0130, whose lower case is two characters
BLANK = "\\t-\\r "
WHITE = BLANK + "\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ODD = re.compile(f"[^{BLANK}!-~{LETTER}«»°©–—‘’“”…•€]")
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"
WITH_BLANKS = re.compile(f" ?[{LETTER}]+| ?[0-9]+|{CONTRACTION}| ?[^{BLANK}{LETTER}0-9]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
WITHOUT_BLANKS = re.compile(f"[{LETTER}]+|[0-9]|(?i:{CONTRACTION})|[^{BLANK}{LETTER}0-9]+")
KEPT_BYTES = 64_000_000
KEPT_LENGTH = 64
ENTRY_BYTES = 190  # of a dictionary entry, its key's and its value's headers


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE:
    printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, plain_specials: bool = False, kept_bytes: int | None = None):
        from tokenizers import Tokenizer
        super().__init__()
        self._all = Tokenizer.from_file(path)
        self._all.encode_special_tokens = plain_specials
        self._specials = [] if plain_specials else [t.content.lower() for t in self._all.get_added_tokens_decoder().values()]
        self._model, self._normalizer = self._all.model, self._all.normalizer
        ends = bool(getattr(self._model, "end_of_word_suffix", None))
        self._split = (WITHOUT_BLANKS if ends else WITH_BLANKS).findall
        self._characters = _byte_characters()
        self._most = kept_bytes
        self._size, self._old = 0, {}  # bytes kept; entries not asked for since the last turn

    def _whole(self, text: str) -> bytes:
        return np.array(self._all.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, run: str) -> bytes:
        ids = self._old.pop(run, None)
        if ids is None:
            own = run
            if self._normalizer:
                own = run.lower() if run.isascii() else self._normalizer.normalize_str(run)
            if not (own.isascii() and own.isalpha()):  # those characters stand for themselves
                own = own.encode("utf-8").decode("latin-1").translate(self._characters)
            ids = array("I", [t.id for t in self._model.tokenize(own)]).tobytes()
        if len(run) <= KEPT_LENGTH:
            self._size += ENTRY_BYTES + len(run) + len(ids)
            if self._size > (self._most or KEPT_BYTES):
                self._old, self._size = dict(self), 0
                self.clear()
            self[run] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._specials and "<" in text:
            low = text.lower()
            if any(s in low for s in self._specials):
                return self._whole(text)
        if not ODD.search(text):
            return b"".join(map(self.__getitem__, self._split(text)))
        out: list[bytes] = []
        for piece in PIECE.findall(text):
            if ODD.search(piece):
                out.append(self._whole(piece))
            else:
                out += map(self.__getitem__, self._split(piece))
        return b"".join(out)


def encoder(path: str, plain_specials: bool = False, kept_bytes: int | None = None) -> Encoder:
    """The worker's encoder for the tokenizer file ``path``, loaded once.  With ``plain_specials``
    the strings of special tokens in a text are ordinary text."""
    key = path, plain_specials, kept_bytes
    if key not in RESIDENT:
        RESIDENT.clear()  # a reused worker keeps one
        RESIDENT[key] = Encoder(path, plain_specials, kept_bytes)
    return RESIDENT[key]

