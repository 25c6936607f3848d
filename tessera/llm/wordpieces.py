"""Exact ids of a word-based vocabulary with a bounded memo of the parts between blanks.

The tokenizer of such a file drops white space and never merges across it, so a text is encoded part by part between
spaces and line feeds, and parts that occurred before are looked up.  New parts of Latin letters, digits and signs are
merged by ``tiktoken`` from the same ranks, with the end of a word as a byte of its own; all other new parts go to the
``tokenizers`` library, whose ids the tests compare.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import regex

from tessera.llm.tokens import byte_letters

#: Parts that a worker remembers; beyond it the memo starts anew.
MEMO = 600_000
#: Parts, one in a line, that no normal form changes and that hold no white space: all of Latin.
LATIN = re.compile("^[!-~¡-ɏ]+$", re.MULTILINE)
#: Stands for the end of a word; no Latin part holds it.
WORD_END = "\x01"
# Fixed value: how vocabularies of this kind part a text.
PIECES = regex.compile(r"('s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+)")
SUFFIX = "</w>"


def latin_core(path: str):
    """A ``tiktoken`` encoding of words that end in WORD_END, and the file's id of each of its ids."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    letters, special = byte_letters(), {x["content"] for x in found["added_tokens"]}
    vocab = {t: i for t, i in found["model"]["vocab"].items() if t not in special}
    ranks = {bytes([b]): b for b in range(256)}
    ids = np.full(512 + max(vocab.values()) + 1, -1, np.int64)
    for token, i in vocab.items():
        ends = token.endswith(SUFFIX) and token != SUFFIX
        raw = bytes(letters[c] for c in (token[:-len(SUFFIX)] if ends else token))
        if ends:  # the last byte and the end are joined before anything else
            rank = 256 + raw[0] if len(raw) == 1 else 512 + i
            raw += WORD_END.encode()
        else:
            rank = raw[0] if len(raw) == 1 else 512 + i
        ranks[raw], ids[rank] = rank, i
    return tiktoken.Encoding(path, pat_str=rf"[^{WORD_END}\n]+{WORD_END}|\n", mergeable_ranks=ranks, special_tokens={}), ids


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker per core already
        from tokenizers import Tokenizer
        self.core = Tokenizer.from_file(path)
        self.added = [t.content for t in self.core.get_added_tokens_decoder().values()]
        self.latin, self.latin_ids = latin_core(path)
        self.line = self.latin.encode_ordinary("\n")[0]
        # a sign that is one token holds other parts apart
        self.mark, self.mark_id = next((c, ids[0]) for c in map(chr, range(0x2500, 0x2700)) for ids in [self.whole(c).tolist()] if len(ids) == 1)
        self.memo: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.core.encode(text, add_special_tokens=False).ids, "<u4")

    def note(self, parts: list[str], ids: np.ndarray, between: np.ndarray) -> None:
        """Remembers the ids of parts that were encoded in one text, apart from the places ``between`` them."""
        raw, cuts = ids.astype("<u4").tobytes(), (4 * between).tolist()
        if len(cuts) != len(parts) - 1:
            raise RuntimeError("parts of a text were not held apart")
        self.memo.update(zip(parts, [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)])]))

    def learn(self, parts: list[str]) -> None:
        joined = "\n".join(parts)
        if self.mark in joined or any(t in joined for t in self.added):
            alone = [p for p in parts if self.mark in p or any(t in p for t in self.added)]
            self.memo.update((p, self.whole(p).tobytes()) for p in alone)
            parts = list(set(parts).difference(alone))
            joined = "\n".join(parts)
        latin = LATIN.findall(joined)
        if latin:
            found = np.array(self.latin.encode_ordinary(PIECES.sub(rf"\1{WORD_END}", "\n".join(latin).lower())), np.int64)
            self.note(latin, self.latin_ids[found], np.flatnonzero(found == self.line))
        if len(latin) < len(parts):
            other = list(set(parts).difference(latin))
            found = self.whole(f" {self.mark} ".join(other))
            self.note(other, found, np.flatnonzero(found == self.mark_id))

    def raws(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; what is new in all of them is learned at once."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
            memo[""] = b""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = {p for parts in split for p in parts if p not in memo}
        if new:
            self.learn(list(new))
        return [b"".join([memo[p] for p in parts]) for parts in split]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
