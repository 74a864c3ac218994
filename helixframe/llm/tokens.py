"""Token ids of a public byte-level BPE."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np


def _vocabulary(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _added_tokens(path: str) -> dict[str, int]:
    """Ids of a tokenizer file's added tokens, which are cut out of a text before anything else."""
    with open(path, encoding="utf-8") as file:
        whole = file.read()
    # only that list is parsed: the vocabulary and merges beside it would take some hundred MB
    added, _ = json.JSONDecoder().raw_decode(whole, re.search(r'"added_tokens"\s*:\s*', whole).end())
    if any(a[flag] for a in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that match as they stand are known")
    return {a["content"]: a["id"] for a in added}


@lru_cache(maxsize=2)
def shared_encoder(path: str | None = None) -> Encoder:
    """One encoder a worker process, whose tables its tasks share."""
    return Encoder(path)


class Encoder:
    """``packed(text)``: little-endian 32-bit ids of the whole text.

    The public vocabulary's added tokens are cut out of a text first; the parts between are encoded each on its own, and
    their ids are taken from the encoder's buffer without a Python number each.
    """

    def __init__(self, path: str | None = None, pattern: str | None = None) -> None:
        self.added: dict[str, bytes] = {}
        if path is None or pattern is None:
            import public_tokenizers

            if path is None:
                self.added = {k: np.array([v], "<u4").tobytes() for k, v in _added_tokens(public_tokenizers.path("byte_bpe_50k.json")).items()}
            path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
            pattern = pattern or public_tokenizers.PATTERN
        self.encoding = _vocabulary(path, pattern)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def packed(self, text: str) -> bytes:
        if self.cut is None or not any(token in text for token in self.added):
            return self._ordinary(text)
        return b"".join(self.added[part] if i % 2 else self._ordinary(part) for i, part in enumerate(self.cut.split(text)))

    def _ordinary(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
