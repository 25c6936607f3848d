"""License scans by template markup: wording that must stand, parts that may, and parts that may differ.

A template is compiled to an automaton over words.  ``[[...]]`` may be left out, ``<<n>>`` stands for any 0 to n words,
everything else must stand word by word.  A text is accepted where the whole automaton runs over consecutive words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import pick

# Phrases of the base rule and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The opening wording of public licenses with its optional and replaceable parts.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released [[under]] [[the]] mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this <<4>> and associated documentation files",
    "cc-by-4.0": "cc by [[version]] 4 0",
    "cc-by-nc-4.0": "cc by nc [[sa]] [[nd]] 4 0",
    "cc-by-sa-4.0": "cc by sa 4 0",
    "gpl-3.0": "gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[or any later version]]",
    "gpl-2.0": "gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[or any later version]]",
    "lgpl": "gnu lesser general public license",
    "agpl": "gnu affero general public license",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "isc": "permission to use copy modify and or distribute this <<2>> for any purpose with or without fee is hereby granted",
    "notice": "copyright [[c]] <<8>> all rights reserved",
}

#: Letters A-Z to lower case, every other ASCII character that is no digit or small letter to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Automaton:
    """States 0..n; per state the word steps, whether any word steps on, and the states reached without a word."""

    def __init__(self, template: str):
        self.step: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.skip: list[set[int]] = [set()]
        optional = None
        for part in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", template):
            if part == "[[":
                optional = len(self.step) - 1
            elif part == "]]":
                self.skip[optional].add(len(self.step) - 1)
            elif part.startswith("<<"):
                begin, n = len(self.step) - 1, int(part[2:-2])
                for s in range(begin, begin + n):
                    self.any[s] = self.grow()
                for s in range(begin, begin + n):
                    self.skip[s].add(begin + n)
            else:
                at = len(self.step) - 1
                self.step[at][part.encode()] = self.grow()
        self.end = len(self.step) - 1
        self.words = {w for s in self.step for w in s}
        self.first = frozenset(w for s in self.closed({0}) for w in self.step[s])
        must = re.sub(r"\[\[.*?\]\]|<<\d+>>", " ", template).split()
        self.anchor = max(must, key=len).encode()  # a word that every match holds

    def grow(self) -> int:
        self.step.append({})
        self.any.append(None)
        self.skip.append(set())
        return len(self.step) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skip[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return out

    def accepts(self, words: list[bytes], at: int) -> bool:
        """Whether the template stands from this word on."""
        states = self.closed({0})
        while states and self.end not in states:
            if at == len(words):
                return False
            word = words[at]
            nxt = {s for i in states for s in (self.step[i].get(word), self.any[i]) if s is not None}
            states = self.closed(nxt)
            at += 1
        return self.end in states


@lru_cache(maxsize=1)
def automata() -> dict[str, Automaton]:
    return {name: Automaton(t) for name, t in TEMPLATES.items()}


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions of a phrase in words that are joined, begun and ended by single spaces."""
    out, word, seen = [], 0, 0
    needle = b" " + phrase + b" "
    at = joined.find(needle)
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = joined.find(needle, at + 1)
    return out


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    joined = b" " + b" ".join(words) + b" "
    found, base = [], set()
    for phrase, label in PHRASES.items():
        at = places(joined, phrase.encode())
        found += at
        base |= {label} if at else set()
    own = set()
    for name, machine in automata().items():
        if b" " + machine.anchor + b" " in joined:
            starts = [i for w in machine.first for i in places(joined, w)]
            if any(machine.accepts(words, i) for i in starts):
                own.add(name)
    score = 1.0 if own else 0.5 if base else 0.0
    return (len(words), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score)


FOUND = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scanned(text: Column) -> Column:
    @F.pandas_udf(FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scan(t) for t in texts], columns=[x.split()[0] for x in FOUND.split(", ")])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return run(text)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document; score 1 if a template is accepted, 0.5 if only a base phrase stands, else 0.

    Null and empty texts have no words and no labels; repeated rows are scanned alike; an empty table gives an empty
    result.
    """
    return pick(docs, doc_id="bigint", text="string").select("doc_id", scanned(F.col("text")).alias("s")).select("doc_id", "s.*")
