"""Licence scan: exact phrases by words, short notices with bounded errors.

A text is brought to lower-cased words parted by one blank, whole batches at a time. Base
phrases are looked for as they stand. A notice with at most ``k`` edits is cut in k + 1 pieces,
one of which must then occur unchanged (pigeonhole); only around such a piece does the regex
library's bounded-error matching run, which confirms the edits and gives the span.

Defined cases: a null or empty text has no words, no spans and score 0; a notice found at
overlapping candidates is reported once; of matches at one place the one with fewest edits counts;
spans are word numbers of the whole text. Repeated rows are scanned each; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LOWER, chunks, small_batches, words
from .tiling import WORD_BYTES

#: Phrases of the base and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Opening sentences of well-known notices, and labels.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by": "Licensed under CC BY",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-released": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: One edit is allowed for so many characters of a notice.
PER_EDIT = 12
MAX_EDITS = 6


def normal(text: str) -> str:
    """A notice in the form in which texts are searched."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out, _ = normalise(raw, np.array([0, len(raw)]))
    return out[0].decode().strip()


def normalise(raw: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each row as b" word word ... word " and its number of words."""
    raw = LOWER[raw]
    start, end, first = words(raw, at, WORD_BYTES)
    count = np.diff(first)
    inside = WORD_BYTES[raw]
    # Keep word bytes, and put a blank before each word.
    kept = np.cumsum(np.concatenate([[0], inside]))
    total = int(kept[-1]) + len(start)
    out = np.full(total, 32, np.uint8)
    length = end - start
    begin = kept[start] + np.arange(len(start)) + 1
    places = np.arange(int(kept[-1])) + np.repeat(np.arange(len(start)) + 1, length)
    out[places] = raw[inside]
    cut = np.append(begin - 1, total)[first]
    joined = out.tobytes()
    return [joined[a:b] + b" " if b > a else b"" for a, b in zip(cut[:-1], cut[1:])], count


class Notice:
    def __init__(self, label: str, text: str):
        self.label, self.text = label, normal(text).encode()
        self.edits = max(1, min(MAX_EDITS, len(self.text) // PER_EDIT))
        size = len(self.text) / (self.edits + 1)
        cuts = [round(i * size) for i in range(self.edits + 2)]
        self.pieces = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.pattern = regex.compile(b"(?b)(?:" + regex.escape(self.text) + b"){e<=%d}" % self.edits)

    def find(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the occurrences that do not overlap."""
        spots = set()
        for offset, piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                spots.add(at - offset)
                at = text.find(piece, at + 1)
        out, size = [], len(self.text)
        lo = hi = None
        for spot in [*sorted(spots), None]:
            if lo is not None and (spot is None or spot - self.edits > hi):
                window_at = max(0, lo)
                stop = min(len(text), hi + size + self.edits)
                out += [(window_at + m.start(), window_at + m.end(), sum(m.fuzzy_counts)) for m in self.pattern.finditer(text[window_at:stop])]
                lo = None
            if spot is not None:
                lo, hi = (spot - self.edits if lo is None else lo), spot + self.edits
        return out


def scan_text(text: bytes, notices: list[Notice]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, int]], float]:
    """Base places (label, start word), notice spans (label, first and last word, edits), score."""
    found, spans, score = [], [], 0.0
    for phrase, label in PHRASES.items():
        needle = b" " + phrase.encode() + b" "
        at = text.find(needle)
        while at >= 0:
            found.append((label, at))
            score = 1.0
            at = text.find(needle, at + 1)
    for notice in notices:
        for a, b, edits in notice.find(text):
            body = text[a:b].strip()
            a += len(text[a:b]) - len(text[a:b].lstrip())
            spans.append((notice.label, a, a + max(0, len(body) - 1), edits))
            score = max(score, 1 - edits / len(notice.text))
    if not found and not spans:
        return [], [], score
    # The number of a word is that of the blanks up to it, less one: one sorted array serves all places.
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)

    def words_at(places: list[int]) -> list[int]:
        return (np.searchsorted(blanks, places, "right") - 1).tolist()

    base = list(zip([label for label, _ in found], words_at([at for _, at in found])))
    first, last = words_at([s[1] for s in spans]), words_at([s[2] for s in spans])
    return base, [(s[0], a, b, s[3]) for s, a, b in zip(spans, first, last)], score


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("edits", T.LongType())])))])
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int64())]))


def scan(docs: DataFrame, text: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """Replace ``text`` by what the scan finds in it."""
    wanted = NOTICES if notices is None else notices
    others = [f for f in docs.schema.fields if f.name != text]
    clash = {f.name for f in others} & set(RESULT.names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")

    def run(batches):
        ready = [Notice(label, words_) for label, words_ in wanted.items()]
        for batch in batches:
            cols = [[] for _ in RESULT.names]
            for _, _, raw, at in chunks(batch, text):
                rows, count = normalise(raw, at)
                for row, n in zip(rows, count.tolist()):
                    base, spans, score = scan_text(row, ready)
                    places, own = [p for _, p in base], sorted({label for label, _ in base})
                    values = (n, len(base), min(places, default=None), max(places, default=None), ",".join(own),
                              ",".join(sorted({*own, *(s[0] for s in spans)})), score,
                              [{"label": a, "first": b, "last": c, "edits": e} for a, b, c, e in sorted(spans, key=lambda s: (s[1], s[0]))])
                    for c, v in zip(cols, values):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in others), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=[*(f.name for f in others), *RESULT.names])

    return small_batches(docs).mapInArrow(run, T.StructType([*others, *RESULT.fields]))
