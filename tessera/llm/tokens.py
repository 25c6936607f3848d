"""Exact byte-pair encoding of whole texts with a bounded memo of words.

The byte-level pre-tokenizer parts a text before every single space that stands between two other characters, and
never looks back beyond such a place.  So a text without runs of white space is encoded word by word, and words that
occurred before are looked up.  Any other text is encoded as a whole.  Ids are those that the ``tokenizers`` library
gives for the same file (the tests compare them); merging rare words by rank is left to ``tiktoken``, which is faster.
A text is first parted at the file's added tokens, which have ids of their own.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Words that a worker remembers; beyond it the memo starts anew.
MEMO = 400_000
#: White space other than the space and the line feed.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
# Fixed value: how byte-level vocabularies of this kind part a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if printable, else the next letter from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[bytes, int]:
    """Bytes of each token to its id, which is also its merge rank; added special tokens are left out."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    special = {x["content"] for x in found["added_tokens"]}
    return {bytes(letters[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in special}


@lru_cache(maxsize=2)
def added_tokens(path: str) -> dict[str, int]:
    """Added tokens to their ids; those that take white space or ask for whole words or normalised text are not read."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(x[k] for x in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that are not matched as they stand")
    return {x["content"]: x["id"] for x in found}


def has_runs(text: str) -> bool:
    """Whether a space may stand beside other white space, or ends the text: word by word would not be exact there."""
    return "  " in text or " \n" in text or "\n " in text or text.endswith(" ") or any(c in text for c in OTHER_SPACE)


class Encoder:
    """Ids of whole texts, and the characters that each token covers.

    With ``added``, an added token in a text gets its id, as the library does by default; without, it is read as plain
    text, as the library does under ``encode_special_tokens``.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken
        ranks = vocabulary(path)
        own = added_tokens(path) if added else {}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in own.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")")
        self.core = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max([*ranks.values(), *own.values()]) + 1, np.int64)
        self.spaced = np.zeros(len(self.width), bool)
        for token, i in ranks.items():
            self.width[i] = len(token)
            self.spaced[i] = token[0] == 0x20
        for token, i in own.items():
            self.width[i] = len(token.encode())
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.core.encode_ordinary(text), "<u4")

    def learn(self, words: list[str]) -> None:
        """Encodes new words in one text; only the first token of each begins with a space."""
        ids = self.whole(" " + " ".join(words))
        raw, at = ids.tobytes(), [*(np.flatnonzero(self.spaced[ids]) * 4).tolist(), 4 * len(ids)]
        self.memo.update(zip(words, [raw[a:b] for a, b in zip(at, at[1:])]))

    def raw(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if any(t in text for t in self.added):
            return b"".join([self.added.get(part) or self.plain(part) for part in self.parts.split(text)])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text or has_runs(text):
            return self.whole(text).tobytes()
        head, *rest = text.split(" ")
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            body = b"".join([memo[w] for w in rest])
        except KeyError:
            self.learn(list(set(rest).difference(memo)))
            body = b"".join([memo[w] for w in rest])
        return self.whole(head).tobytes() + body

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), "<u4")

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token; one that holds a part of a character's bytes covers that character."""
        to = np.cumsum(self.width[self.ids(text)])
        begin = np.concatenate([[0], to[:-1]]) if len(to) else to
        if len(to) and not text.isascii():
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
            begin, to = char[begin], char[to - 1] + 1
        return begin, to
