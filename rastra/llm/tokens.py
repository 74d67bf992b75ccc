"""Byte-level BPE ids inside Arrow tasks. The vocabulary file is a parameter and stays where it is installed."""

from __future__ import annotations

import functools
import json

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
SPLITTER = '"type": "ByteLevel"'
#: How the vocabulary's own pre-tokenizer splits a text.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the rest as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def id_bytes(vocabulary: str = VOCABULARY) -> int:
    """How many bytes an id of the vocabulary needs: 2 or 4."""
    with open(vocabulary_path(vocabulary), encoding="utf-8") as f:
        model = json.load(f)
    top = max([*model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))])
    return 2 if top < 1 << 16 else 4


@functools.cache
def encoder(vocabulary: str = VOCABULARY):
    """text -> array of ids, equal to Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids.

    The file's own vocabulary runs in tiktoken's merge loop, which gives the same ids for about a quarter of the CPU;
    what that library refuses goes to the tokenizers library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary_path(vocabulary)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    to_byte = _byte_of_char()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    exact = Tokenizer.from_file(path)
    own = "".join(json.dumps(model.get("pre_tokenizer")))
    if SPLITTER not in own:
        raise ValueError(f"{vocabulary}: only byte-level pre-tokenizers with the known split are supported")

    def encode(text: str) -> np.ndarray:
        try:
            ids = fast.encode_to_numpy(text, allowed_special="all") if text else ()
        except BaseException as e:  # the library panics on some runs of a million equal characters
            if type(e).__name__ != "PanicException":
                raise
            ids = exact.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4")

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, all pieces but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]
