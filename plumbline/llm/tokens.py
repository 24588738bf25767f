"""Token ids of whole texts."""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np


@functools.cache
def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def symbol_bytes(symbols: str) -> bytes:
    return bytes(map(_byte_of_symbol().__getitem__, symbols))


@functools.cache
def definition(path: str) -> dict:
    """The definition of a byte-level BPE in a tokenizer file: merges in order, ids by bytes, special strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before, model = spec["pre_tokenizer"], spec["model"]
    if before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"] or model["type"] != "BPE" or spec["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE")
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ids = {symbol_bytes(s): i for s, i in model["vocab"].items() if s not in special}
    pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    return {"ids": ids, "merges": [(symbol_bytes(a), symbol_bytes(b)) for a, b in pairs], "special": special}


@functools.cache
def encoder(path: str):
    """Encoder of a byte-level BPE: the ids of the tokenizers library for the same file, found faster.

    Every merge of such a file makes the token with the next id, so ids serve as merge ranks.
    Special strings inside texts become their ids, which is that library's default.
    """
    import public_tokenizers
    import tiktoken
    spec = definition(path)
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=spec["ids"], special_tokens=spec["special"])


#: White space characters from which on a stretch is encoded without the split pattern, whose look-ahead would go back over it.
LONG_SPACE = 100_000
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)   # fixed values: Unicode's white space


def ids_of(text: str, path: str) -> np.ndarray:
    """All ids of a whole text as unsigned 32-bit numbers."""
    library = encoder(path)
    if len(text) < LONG_SPACE:
        return library.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    parts, at = [], 0
    for found in _SPACE.finditer(text):
        # all of it is one match, but for the last character where a text goes on that is no special string
        start, end = found.span()
        end -= end < len(text) and not any(text.startswith(x, end) for x in library.special_tokens_set)
        parts += [library.encode_to_numpy(text[at:start], allowed_special="all", disallowed_special=()), np.array(library._encode_single_piece(text[start:end]), np.uint32)]
        at = end
    parts.append(library.encode_to_numpy(text[at:], allowed_special="all", disallowed_special=()))
    return np.concatenate(parts)


def ranks_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
