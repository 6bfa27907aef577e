"""Encoding of whole texts with a public byte-level BPE, fast enough to run over a corpus.

Ids are those of ``tokenizers`` on the named file without special tokens added. ``tiktoken`` has the same vocabulary and
gives the same ids several times faster, so it encodes all texts but those that hold a special token's string, or a
character whose class (letter, number, blank) may differ between the two libraries' Unicode tables, or a run of blanks or
a word so long that ``tiktoken`` would run out of stack or of time on it.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import tiktoken
from tokenizers import Tokenizer

JSON, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: Longest run of blanks that ``tiktoken`` is given.
MAX_RUN = 20_000
_LONG_RUN = re.compile(rf"\s{{{MAX_RUN}}}")


def _agreed() -> re.Pattern:
    """What is outside the characters on whose class all Unicode tables agree: assigned since Unicode 3.2, or pictographs."""
    old = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and c != 0x180E and unicodedata.ucd_3_2_0.category(chr(c)) == unicodedata.category(chr(c))]
    runs: list[list[int]] = []
    for c in [*old, *range(0x1F300, 0x1F800), *range(0x1F900, 0x1FA00)]:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


class Encoder:
    """``folder`` holds the two files of the vocabulary."""

    def __init__(self, folder: str) -> None:
        import public_tokenizers

        self.slow = Tokenizer.from_file(str(Path(folder, JSON)))
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, RANKS).read_bytes().splitlines())}
        self.quick = tiktoken.Encoding(RANKS, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.disputed = _agreed()
        #: Bytes of each token; the one without a rank is the special token.
        self.sizes = np.full(self.slow.get_vocab_size(), len(SPECIAL), np.int64)
        self.sizes[list(ranks.values())] = [len(x) for x in ranks]

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; none for null."""
        if not text:
            return b""
        if SPECIAL in text or self.disputed.search(text) or (len(text) >= MAX_RUN and _LONG_RUN.search(text)):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.quick.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, Encoder] = {}


def encoder(folder: str) -> Encoder:
    """One for each worker and folder."""
    if folder not in _encoders:
        _encoders[folder] = Encoder(folder)
    return _encoders[folder]


def default_folder() -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path(JSON)).parent)


def starts(sizes: Sequence[int]) -> np.ndarray:
    """Where each of consecutive spans begins."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return ends - np.asarray(sizes, np.int64)
