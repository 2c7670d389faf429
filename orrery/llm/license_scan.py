"""License scans: short notices found in spite of typing errors.

A notice of which up to k characters may differ is split into k + 1 pieces; wherever it occurs, one piece stands
unchanged. All pieces of all notices are searched at once; each hit opens a window around the one place of the notice that
it allows, in which the regex library's bounded-error matching verifies the notice and reports its best span. Phrases counted exactly come beside it.

Notices are searched in a flat text, in which white space, with the marks that begin lines of comments, is one blank; spans are
given in the whole text. Of overlapping notices the one with the smallest share of errors stands, then the longest, then the first.

A null text is an empty one: no words, no places, no labels, score 0. Texts are taken whole, whatever their length. Equal rows give
equal results, an empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import map_rows, spread

#: Phrases counted exactly, and their labels. Fixed values of the query's contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices searched with errors, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("licensed under the apache license, version 2.0", "apache-2.0"),
    ("licensed under the gnu general public license, version 3", "gpl-3.0"),
    ("licensed under the gnu general public license, version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under cc by-nc 4.0", "cc-by-nc-4.0"),
    ("licensed under cc by-sa 4.0", "cc-by-sa-4.0"),
    ("creative commons attribution 4.0 international license", "cc-by-4.0"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
)
#: Of so many characters of a notice one may be wrong: inserted, left out or replaced.
CHARS_AN_ERROR = 10

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
LOWER = {c: c + 32 for c in range(65, 91)}
#: What becomes one blank in the flat text: ends of lines with the mark of a comment behind them, or other white space than one blank.
GAP = re.compile(r"(?=[\n\t\r\f\v]| \s)(?:(?:\s*\n[ \t]*(?:(?:[*#;>%|]+|//+|--+)(?=\s|$)[ \t]*)?)+|[ \t\r\f\v]+)")


class Flat:
    """A text with each gap as one blank, and where its places are in the text."""

    def __init__(self, low: str):
        pieces, self.flat, self.text = [], [0], [0]
        at = size = 0
        for m in GAP.finditer(low):
            if m.end() - m.start() > 1:
                # up to the gap and its blank places move in step, then they start anew
                pieces.append(low[at : m.start()])
                size += m.start() - at + 1
                at = m.end()
                self.flat.append(size)
                self.text.append(at)
            else:
                pieces.append(low[at : m.start()])
                size += m.end() - at
                at = m.end()
        self.string = " ".join([*pieces, low[at:]])

    def place(self, i: int) -> int:
        k = bisect.bisect_right(self.flat, i) - 1
        return self.text[k] + i - self.flat[k]


def split_pieces(notice: str, k: int) -> list[tuple[str, int]]:
    """k + 1 pieces that make up the notice, with their places."""
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES):
        import ahocorasick
        import regex

        self.notices = [(n, label, len(n) // CHARS_AN_ERROR) for n, label in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            for piece, at in split_pieces(n, k):
                seeds.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={k}}}") for n, _, k in self.notices]
        self.phrases = []
        for phrase, label in phrases:
            ws = phrase.split(" ")
            self.phrases.append((max(ws, key=len), re.compile(f"(?={re.escape(ws[0])}(?<!{WORD}{re.escape(ws[0])}){''.join(f'{BREAK}+{re.escape(w)}' for w in ws[1:])}(?!{WORD})){re.escape(ws[0])}"), label))

    def words(self, low: str) -> np.ndarray:
        """Where words start."""
        cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = (cp > 127) | ((cp >= 48) & (cp <= 57)) | ((cp >= 97) & (cp <= 122))
        return np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))

    def exact(self, low: str) -> list[tuple[int, str]]:
        return [(m.start(), label) for longest, pattern, label in self.phrases if longest in low for m in pattern.finditer(low)]

    def approximate(self, low: str) -> list[tuple[int, int, str, int, int]]:
        """start, end, label, errors and length of notice of every verified occurrence, by start."""
        source = Flat(low)
        flat = source.string
        begins: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(flat):
            for i, at in uses:
                begins.setdefault(i, []).append(end + 1 - size - at - self.notices[i][2])
        out = []
        for i, places in begins.items():
            n, label, k = self.notices[i]
            places.sort()
            at = 0
            while at < len(places):
                # hits of one occurrence lie within 2 k; such a window is too short for a second occurrence beside the best
                upto = bisect.bisect_right(places, places[at] + 2 * k)
                if m := self.fuzzy[i].search(flat, max(places[at], 0), min(places[upto - 1] + len(n) + 2 * k, len(flat))):
                    out.append((source.place(m.start()), source.place(m.end() - 1) + 1, label, sum(m.fuzzy_counts), len(n)))
                at = upto
        # of overlapping notices the one with the smallest share of errors stands, then the longest
        kept: list[tuple[int, int, str, int, int]] = []
        taken: list[tuple[int, int]] = []
        for x in sorted(out, key=lambda x: (x[3] / x[4], -x[4], x)):
            at = bisect.bisect_left(taken, (x[1],))
            if at == 0 or taken[at - 1][1] <= x[0]:
                taken.insert(at, (x[0], x[1]))
                kept.append(x)
        return sorted(kept)

    def scan(self, text: str | None):
        low = text or ""
        low = low.lower() if low.isascii() else low.translate(LOWER)
        starts = self.words(low) if low else np.zeros(0, np.int64)
        base = self.exact(low)
        found = self.approximate(low)
        at = [int(np.searchsorted(starts, s)) for s, _ in base]
        labels = sorted({x for _, x in base})
        score = 1.0 if base else max((1 - e / n for *_, e, n in found), default=0.0)
        return len(starts), len(base), min(at, default=None), max(at, default=None), ",".join(labels), ",".join(sorted({*labels, *(f[2] for f in found)})), score, [{"start": s, "end": e, "label": x, "errors": k} for s, e, x, k, _ in found]


def scan(docs: DataFrame, notices=NOTICES, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the spans of notices found with errors allowed."""

    def make():
        s = Scanner(notices, phrases)
        return lambda key, text: [(key, *s.scan(text))]

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string,errors:int>>"
    return map_rows(spread(docs.select(F.col(id_col), F.col(text_col))), make, schema)
