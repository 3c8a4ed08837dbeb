"""Token ids of texts by a vocabulary file of the ``tokenizers`` library, with the words seen before remembered.

For byte-level BPE files without prefix space, a text whose white space is single spaces and line feeds falls into
chunks (a space and what follows it, or a line feed) that are encoded alone; each worker keeps a bounded memory of
chunks. Any other text is encoded whole.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# The published byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space but single spaces and line feeds, and the mark that cuts chunks: such texts are encoded whole.
_WHOLE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["  ", " \n", "\n ", "\n\n", "\0"]
_REMEMBERED = 800_000


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        if (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                and model.get("type") == "BPE" and not spec.get("normalizer") and not spec.get("post_processor")):
            byte = _byte_of()
            ranks = {bytes(byte[c] for c in token): n for token, n in model["vocab"].items() if token not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text[-1:] in (" ", "\n") or any(w in text for w in _WHOLE):
            return self._encode(text)
        known, chunks = self.known, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        found = list(map(known.get, chunks))
        if None in found:
            if len(known) > _REMEMBERED:
                known.clear()
            for n, ids in enumerate(found):
                if ids is None:
                    chunk = chunks[n]
                    if (ids := known.get(chunk)) is None:
                        ids = known[chunk] = self._encode(chunk)
                    found[n] = ids
        return b"".join(found)

    def _encode(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One per Python worker and file."""
    return Ids(path)
