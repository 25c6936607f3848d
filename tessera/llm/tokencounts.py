"""Token counts of fields and sections from one encoding of each whole document.

A document is encoded once with the characters of every token.  Its sections are character spans; tokens and spans
meet in an interval join.  A token that touches several spans belongs to the one that holds most of its characters,
the first of these on a tie, so the counts of disjoint spans add up to the tokens that touch any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import pick, tokenizer_path
from tessera.llm.packing import VOCABULARY, encoder

COUNTED = "doc_id bigint, section int, start bigint, stop bigint, n_tokens bigint, n_crossing bigint"


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections, each with its line feed; an empty text is one empty section."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1  # no line feed after the last
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends = ends[:-1]  # a text that ends with a line feed has no further line
    return np.concatenate([[0], ends[:-1]]), ends


def attributed(begin: np.ndarray, to: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens per span, those of them that touch another span too, and tokens that touch none; spans sorted by start."""
    n = len(start)
    first = np.searchsorted(np.maximum.accumulate(stop), begin, "right")
    last = np.maximum(np.searchsorted(start, to, "left"), first)
    met = last - first
    token = np.repeat(np.arange(len(begin)), met)
    span = np.arange(len(token)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(first, met)
    shared = np.minimum(to[token], stop[span]) - np.maximum(begin[token], start[span])
    token, span, shared = token[shared > 0], span[shared > 0], shared[shared > 0]
    order = np.lexsort((span, -shared, token))
    token, span = token[order], span[order]
    head = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    touched = np.bincount(token, minlength=len(begin))
    return np.bincount(span[head], minlength=n), np.bincount(span[head], touched[token[head]] > 1, minlength=n).astype(np.int64), int((touched == 0).sum())


def token_counts(docs: DataFrame, spans: DataFrame | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per section: doc_id, section, start, stop (characters), n_tokens, n_crossing (of them, tokens cut by a border).

    Sections are the lines of the text, or the rows of ``spans`` (doc_id, section, start, stop); with ``spans``,
    section -1 counts the tokens outside.  A null text counts as an empty one: one empty line without tokens; a
    document without spans gives its -1 row alone; spans of an id with several rows go to each of them; spans that are
    null, empty or reversed hold no tokens; an empty table gives an empty result.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    given = spans is not None
    if given:
        each = pick(spans, doc_id="bigint", section="int", start="bigint", stop="bigint").filter("doc_id is not null")
        by = each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "section"))).alias("spans"))  # the fields of one document
        rows = rows.join(by, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(vocabulary), added=True)
        for batch in batches:
            ids, sections, starts, stops, counts, crossing = [], [], [], [], [], []
            lists = batch.column(2) if given else None
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = text or ""
                begin, to = enc.offsets(text)
                if given:
                    own = [(s["start"] or 0, max(s["stop"] or 0, s["start"] or 0), s["section"]) for s in lists[i].as_py() or []]
                    own.sort(key=lambda s: s[:2])
                    start, stop = (np.array([s[k] for s in own], np.int64) for k in (0, 1))
                    names = [*(s[2] for s in own), -1]
                else:
                    start, stop = line_spans(text)
                    names = list(range(len(start)))
                n, cut_, outside = attributed(begin, to, start, stop)
                if given:
                    start, stop, n, cut_ = np.append(start, 0), np.append(stop, len(text)), np.append(n, outside), np.append(cut_, 0)
                ids += [doc] * len(n)
                sections += names
                for kept, x in ((starts, start), (stops, stop), (counts, n), (crossing, cut_)):
                    kept.append(x)
            numbers = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (starts, stops, counts, crossing)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sections, pa.int32()), *numbers], ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return rows.mapInArrow(run, COUNTED)
