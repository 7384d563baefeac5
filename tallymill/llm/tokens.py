"""Token ids of a byte-level vocabulary file, fast enough for whole corpora.

The file is one of the ``tokenizers`` library. Its vocabulary is in merge order,
so the ids are also merge ranks, and ``tiktoken`` gives the same ids several
times faster; files for which that does not hold are refused.
"""

from __future__ import annotations

import json
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: how byte-level vocabularies part a text before merging.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    visible Latin-1 characters for themselves, the rest from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, parts = spec["model"], spec["pre_tokenizer"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        decoded = byte_of()
        ranks = {
            bytes(decoded[c] for c in token): i
            for token, i in model["vocab"].items()
            if token not in special
        }
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in merges]
        if (
            model["type"] != "BPE" or parts["type"] != "ByteLevel" or parts["add_prefix_space"]
            or spec["normalizer"] is not None or order != sorted(order)
        ):
            raise ValueError(f"{path}: not a byte-level vocabulary in merge order")
        self.special = set(special)
        self.encoding = tiktoken.Encoding(
            "file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    def ids(self, text: str) -> np.ndarray:
        """Special tokens in the text are read as such, none is added."""
        return self.encoding.encode_to_numpy(
            text, allowed_special=self.special, disallowed_special=()
        )
