"""Vocabulary files of byte-level BPE tokenizers, read on each worker from a path that is a parameter."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import regex


def byte_letters() -> dict[str, int]:
    """The letters by which a .json vocabulary writes the 256 bytes: printable ones stand for themselves, the others follow 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(4)
def merges(path: str) -> tuple[dict[bytes, int], list[tuple[int, int, int]], list[str]]:
    """(token bytes to id, merges as (left id, right id, new id) in order, strings of added tokens) of a .json file."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    letters, added = byte_letters(), [x["content"] for x in d.get("added_tokens", [])]
    ids = d["model"]["vocab"]
    raw = {k: bytes(map(letters.__getitem__, k)) for k in ids if k not in set(added)}
    out = []
    for m in d["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        out.append((ids[a], ids[b], ids[a + b]))
    return {raw[k]: v for k, v in ids.items() if k in raw}, out, added


@lru_cache(4)
def splitter(pattern: str):
    return regex.compile(pattern).findall


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
