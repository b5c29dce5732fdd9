"""Token ids of whole texts."""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np

#: Fixed value: how byte-level vocabularies of this family cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _same_merges(path: str):
    """The file's vocabulary for a faster encoder, if the ids of its tokens follow the order of its
    merges, so that merging by least id is the same as merging by the list. Else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab.get("".join(m), -1) for m in merges]
    merged = set(ids)
    if any(x >= y for x, y in zip(ids, ids[1:])) or ids[0] <= max(vocab[c] for c in letters):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if all(c in letters for c in t)}
    # The special token's text is spelled in plain letters too, but no merges lead to it.
    ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i in merged}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


class ByteTokenizer:
    """Ids of a byte-level BPE tokenizer file. Texts that may hold a special token go to the file's
    own library; all others take a faster encoder with the same vocabulary, where the file allows it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.quick = _same_merges(path)

    def encode(self, text: str) -> np.ndarray:
        if self.quick is None or any(t in text for t in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(array("I", self.quick(text)), "<u4")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)
