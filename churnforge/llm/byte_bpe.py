"""Byte-level BPE ids exactly as the tokenizers library gives them.

Texts of characters below U+0250 only - whose Unicode classes no version of
the tables has changed - run through the same merge table in tiktoken, several
times faster; all other texts run through the library itself. The merge table
is read from the one tokenizer file; where it is not in rank order, every text
runs through the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

# Unicode White_Space (what \s means to the pre-tokenizer), and
# the byte-level pre-tokenizer's pattern.
SPACES = "\t-\r \x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BOUNDARY = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")
_WIDE = re.compile("[ɐ-\U0010ffff]")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        spec = json.loads(data)
        pre = spec.get("pre_tokenizer") or {}
        if (spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True)
                or pre.get("add_prefix_space")):
            raise ValueError("not a plain byte-level tokenizer")
        added = {t["content"]: t for t in spec.get("added_tokens") or []}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{SPACES}]", c) for c, t in added.items()):
            raise ValueError("an added token spans white space")
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        raw = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.byte_lens = np.zeros(max([*raw.values(), *(t["id"] for t in added.values())]) + 1, np.int64)
        for token, i in raw.items():
            self.byte_lens[i] = len(token)
        for content, t in added.items():
            self.byte_lens[t["id"]] = len(content.encode())
        self.fast = self._fast(spec, raw, {c: t["id"] for c, t in added.items()})

    def _fast(self, spec: dict, raw: dict[bytes, int], added: dict[str, int]):
        """The same merges in tiktoken, if ids rise with merge ranks."""
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab.get(a + b, -1) for a, b in pairs]
        if made != sorted(set(made)) or (made and made[0] < 256) or len(raw) != 256 + len(made):
            return None
        import tiktoken
        return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=raw, special_tokens=added)

    def ids(self, text: str) -> np.ndarray:
        """Ids of one text, special strings handled as the library's default does."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and not _WIDE.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def token_starts(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each token begins."""
        lens = self.byte_lens[ids]
        return np.cumsum(lens) - lens


def stable_cuts(text: str, start: int, end: int) -> list[int]:
    """Characters of text[start:end], start excluded, at which every
    tokenisation begins a token: white space after a character that is none.
    The pre-tokenizer matches from left to right, never looks behind, and ends
    every match there."""
    return [m.start() for m in _BOUNDARY.finditer(text, start, end) if m.start() > start]


_WORKER: dict[bytes, ByteBpe] = {}


def worker_bpe(data: bytes) -> ByteBpe:
    """One encoder per Python worker."""
    if data not in _WORKER:
        _WORKER[data] = ByteBpe(data)
    return _WORKER[data]
