"""Public tokenizers as the operators use them: ids of texts, and the bytes of every id.

A vocabulary is named by its file, either a path or the bare name of a file of the installed ``public_tokenizers``;
the name is resolved in the task, so that every executor reads its own copy. Tokenizers are read, never trained.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary_path(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, the others
    follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A byte-level BPE of a ``tokenizers`` file.

    The merges run in tiktoken on the same vocabulary (five times faster, the same ids: ids are in merge order, which
    is checked here); ``special`` says whether special tokens' strings in a text become their ids.
    """

    def __init__(self, path: str, special: bool):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        own = {t["content"]: t["id"] for t in file["added_tokens"]}
        letters = _byte_of_letter()
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in own}
        merged = [ranks[bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in file["model"]["merges"]]
        if merged != sorted(merged) or file["pre_tokenizer"]["type"] != "ByteLevel" or file["normalizer"]:
            raise ValueError(f"{path}: not a byte-level vocabulary in the order of its merges")
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=own if special else {})
        self.special = frozenset(own) if special else frozenset()
        self.bytes: list[bytes] = [b""] * (1 + max([*ranks.values(), *own.values()]))
        for token, i in ranks.items():
            self.bytes[i] = token
        for token, i in own.items():
            self.bytes[i] = token.encode()

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())


class Pieces:
    """A sentencepiece model; it puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype=np.uint32)


@lru_cache(maxsize=4)
def byte_level(name: str, special: bool = False) -> ByteLevel:
    return ByteLevel(vocabulary_path(name), special)


@lru_cache(maxsize=4)
def piece_model(name: str) -> Pieces:
    return Pieces(vocabulary_path(name))
