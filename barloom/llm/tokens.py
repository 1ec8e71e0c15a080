"""Byte-level BPE ids of whole texts, exactly as the `tokenizers` library gives them."""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: Texts with only these characters split alike in both libraries; others go to `tokenizers` itself.
PLAIN = re.compile(r"[^\x00-\x7f\xa1-ɏ]")
#: Fixed value: the splitting pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _codec(path: str):
    """(tokenizers' Tokenizer, a tiktoken Encoding over the same vocabulary, special strings)."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    special = [t["content"] for t in whole.get("added_tokens", [])]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast, special


def encode(texts: list[str], path: str) -> list[list[int]]:
    """Ids of each text, without special tokens added.

    tiktoken merges the same vocabulary several times faster; a text with a character outside ASCII and
    the Latin letters, or with a special token's string, is left to `tokenizers`.
    """
    slow, fast, special = _codec(path)
    found: list[list[int] | None] = []
    hard = []
    for i, text in enumerate(texts):
        if (not text.isascii() and PLAIN.search(text)) or any(s in text for s in special):
            hard.append(i)
            found.append(None)
        else:
            found.append(fast.encode_ordinary(text))
    for i in hard:
        found[i] = slow.encode(texts[i], add_special_tokens=False).ids
    return found
