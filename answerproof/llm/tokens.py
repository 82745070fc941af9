"""Public byte-level vocabularies inside tasks: ids and the bytes of each id.

Vocabulary files stay where they are installed; a path is a parameter, and each Python worker opens
its own copy once.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"

# Fixed value: the pre-tokenizer's split of byte-level vocabularies of this family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space this long overflows the stack of the quick encoder's pattern.
LONG_RUN = 100_000
LONG_BLANK = re.compile(r"\s{%d}" % LONG_RUN)


def installed(path: str) -> str:
    """A file name without a folder is one of the installed public vocabularies."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that print
    stand for themselves, the others take the characters from 256 on, in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level vocabulary in the json form of ``tokenizers``, encoded by a quicker library that
    gives the same ids: merges apply in the order of ids, which is checked when the file is read.
    Files of another kind, and texts the quick encoder cannot take, go through ``tokenizers``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.pieces = [b""] * self.size
        for piece, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.pieces[i] = piece
        self.plain, self.marked = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        split = spec.get("pre_tokenizer") or {}
        flags = [(t["lstrip"], t["rstrip"], t["single_word"], t["normalized"]) for t in spec["added_tokens"]]
        quick = (
            model["type"] == "BPE"
            and not model.get("dropout")
            and not model.get("ignore_merges")
            and spec.get("normalizer") is None
            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
            and made == sorted(set(made))
            and len(made) + 256 == len(ranks)
            and not any(map(any, flags))
        )
        self.quick = (
            tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special) if quick else None
        )

    def encode(self, text: str, special: bool = False) -> np.ndarray:
        """Ids of a text. ``special``: the strings of special tokens become their ids, as they do in
        ``tokenizers`` by default; otherwise they are ordinary text."""
        if self.quick is None or (len(text) >= LONG_RUN and LONG_BLANK.search(text)):
            library = self.marked if special else self.plain
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        if special:
            return self.quick.encode_to_numpy(text, allowed_special="all")
        return self.quick.encode_to_numpy(text, disallowed_special=())


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str = BYTE_BPE) -> ByteBpe:
    return ByteBpe(installed(path))


class PieceBpe:
    """A sentencepiece vocabulary whose pieces stand for bytes: U+2581 is a space, <0xHH> a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.pieces = []
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            self.pieces.append(
                bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            )

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


@functools.lru_cache(maxsize=4)
def piece_bpe(path: str = PIECE_BPE) -> PieceBpe:
    return PieceBpe(installed(path))
