"""Token ids of the byte-level tokenizer, fast.

The vocabulary comes as a ``tokenizers`` file and as ranks for ``tiktoken``, which encodes four times as fast. Both give
the same ids wherever both split words alike; so texts of letters up to U+024F and common marks take the fast way, and
any other text, and any with a special token's string in it, goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np

from larkspur.llm.token_counts import tokenizer

#: A character outside Latin letters and common punctuation.
RARE = re.compile("[^\t\n\r -~¡-¬®-ɏ‐-―‘-„•…]")
_ready: dict[str, Callable] = {}


def encoder(path: str) -> Callable[..., np.ndarray]:
    """A function of a text (and an id to put at its end) that gives its ids as little-endian unsigned 32-bit."""
    if path not in _ready:
        _ready[path] = _make(path)
    return _ready[path]


def _make(path: str) -> Callable[..., np.ndarray]:
    slow = tokenizer(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    fast = _fast(path)
    odd = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def encode(text: str, end: int | None = None) -> np.ndarray:
        if fast is None or RARE.search(text) or odd.search(text):
            ids = np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
        else:
            ids = fast(text)
        return ids if end is None else np.append(ids, np.uint32(end)).astype("<u4")

    return encode


def _fast(path: str) -> Callable[[str], np.ndarray] | None:
    """The same vocabulary for ``tiktoken``, if its file stands beside and both agree on a probe."""
    import os

    import public_tokenizers
    import tiktoken

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return None
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    made = tiktoken.Encoding("larkspur", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    probe = "It's  a\tprobe,\n\n 12.5 of Größe é--x  "
    if list(made.encode_ordinary(probe)) != tokenizer(path).encode(probe, add_special_tokens=False).ids:
        return None
    inner = made._core_bpe
    return lambda text: np.frombuffer(inner.encode_to_tiktoken_buffer(text, set()), "<u4")
