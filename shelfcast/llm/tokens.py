"""Token ids of a public byte-level BPE."""

from __future__ import annotations

import re
import sys

import numpy as np

from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

# Texts of these characters alone go through the faster of two libraries, which give them the same ids.
_COMMON = re.compile("[\t\n\r -~¡-ɏͰ-ӿ]*")
# The pattern by which byte-level BPE of this family parts a text (a fixed value).
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_sign() -> dict[str, int]:
    """Byte that each sign of a byte-level vocabulary stands for: printable Latin-1 signs stand for themselves, the
    others for the remaining bytes in order, from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The ids that ``tokenizers`` gives with ``add_special_tokens=False``.

    path: a byte-level BPE file of ``tokenizers``, at the same place on every executor. Texts of common characters
    go to ``tiktoken`` with the vocabulary of that file, about four times faster; all others to ``tokenizers``.
    controls: whether the file's added tokens, met in a text, have their own ids, as ``tokenizers`` does unless
    told otherwise; without it they are ordinary text.
    """

    def __init__(self, path: str, controls: bool = False):
        self.path, self.controls = path, controls
        self.model, self.fast, self.added = None, None, ()

    def __getstate__(self):
        return {"path": self.path, "controls": self.controls, "model": None, "fast": None, "added": ()}

    def _load(self) -> None:
        import json
        import os

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(self.path)
        self.model.encode_special_tokens = not self.controls
        with open(self.path, encoding="utf-8") as file:
            stated = json.load(file)
        special = {t["content"] for t in stated["added_tokens"]}
        signs = _byte_of_sign()
        ranks = {bytes(signs[c] for c in t): i for t, i in stated["model"]["vocab"].items() if t not in special}
        self.added = tuple(special) if self.controls else ()
        self.fast = tiktoken.Encoding("words", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.model is None:
            self._load()
        if _COMMON.fullmatch(text) and not any(t in text for t in self.added):
            return self.fast.encode_ordinary(text)
        return self.model.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.asarray(self.ids(text), "<u4").tobytes()
