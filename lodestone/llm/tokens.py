"""Token ids of whole texts under a public byte-level vocabulary."""

from __future__ import annotations

import json

import numpy as np

from .kernels import process_cache

END = 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The ids that `tokenizers` gives for a file of byte-level BPE, without special tokens around a text. The file's own vocabulary and
    pattern are run by tiktoken, several times as fast; tests hold both to the same ids. A text that holds the string of an added token
    (such as <|endoftext|>), which that library reads as the token, goes through the library itself."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self._library = path, None
        model = json.load(open(path, encoding="utf-8"))
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        # byte-level vocabularies write each byte as a printable character
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.size = max([*model["model"]["vocab"].values(), *self.special.values()]) + 1
        ranks = {bytes(char[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self._bpe = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path)
            return self._library.encode(text, add_special_tokens=False).ids
        return self._bpe.encode_ordinary(text)

    def array(self, text: str) -> np.ndarray:
        return np.array(self.ids(text), np.uint32)

    def text(self, ids) -> str:
        return self._bpe.decode([int(i) for i in ids], errors="strict")


def encoder(path: str | None = None) -> Encoder:
    """One per process and file."""
    path = path or default_vocabulary()
    cache = process_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]
