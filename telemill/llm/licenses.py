"""License notices in whole texts: exact phrases of words, and short notices with a bounded number of errors.

Fuzzy search works in two steps.  A notice that may have k errors is cut into k + 1 pieces; whatever the errors, one
piece stands unchanged in the text (pigeonhole), so one pass of an Aho-Corasick automaton over all pieces of all
notices finds every place that can hold one.  A bit-parallel pass over these stretches leaves the ends at which at most
k errors are possible.  There the ``regex`` library looks for the whole notice with at most k insertions, deletions and
substitutions, which proves the match and gives its span and number of errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .arrow import map_columns
from .shingles import word_bounds
from .spans import Spans

#: Phrases of words whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices in lower case, with the labels that the fuzzy search gives.
NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0-notice",
    "this work is licensed under the gnu general public license, version 3": "gpl-3.0-notice",
    "this program is free software: you can redistribute it and/or modify": "gpl-program-notice",
    "licensed under cc by-nc 4.0": "cc-by-nc-4.0-notice",
    "licensed under cc by-sa 4.0": "cc-by-sa-4.0-notice",
    "released under the mit license": "mit-notice",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit-grant",
    "redistribution and use in source and binary forms, with or without modification, are permitted": "bsd-grant",
    "this source code form is subject to the terms of the mozilla public license, v. 2.0": "mpl-2.0-notice",
    "all rights reserved": "all-rights-reserved",
}

_LOWER_TEXT = {c: c + 32 for c in range(65, 91)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BETWEEN = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


@dataclass(frozen=True)
class Place:
    label: str
    start: int
    end: int
    edits: int
    length: int


def errors_allowed(notice: str) -> int:
    """One error for every twelve characters, one at least."""
    return max(1, len(notice) // 12)


def possible_ends(notice: str, text: str, a: int, b: int, most: int) -> list[tuple[int, int]]:
    """Runs of neighbouring places (first, last) in a..b where something at most ``most`` edits from the notice may end.

    The columns of the table of distances of all that ends at a place, as bit vectors of their differences.
    """
    letters: dict[str, int] = {}
    for i, c in enumerate(notice):
        letters[c] = letters.get(c, 0) | 1 << i
    full, last = (1 << len(notice)) - 1, 1 << (len(notice) - 1)
    up, down, score = full, 0, len(notice)
    runs: list[tuple[int, int]] = []
    for place, c in enumerate(text[a:b], a + 1):
        match = letters.get(c, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right, left = (down | ~(diagonal | up)) & full, diagonal & up
        score += bool(right & last) - bool(left & last)
        vertical = match | down
        right, left = right << 1, left << 1
        up, down = (left | ~(vertical | right)) & full, right & vertical & full
        if score <= most:
            if runs and runs[-1][1] == place - 1:
                runs[-1] = (runs[-1][0], place)
            else:
                runs.append((place, place))
    return runs


class FuzzyNotices:
    """Finds ``notices`` in lower-cased texts; ``errors`` gives the bound for each."""

    def __init__(self, notices: dict[str, str] = NOTICES, errors=errors_allowed):
        import ahocorasick
        import regex

        self.seeds = ahocorasick.Automaton()
        self.notices: list[tuple[str, str, int, object]] = []
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, label) in enumerate(notices.items()):
            k = errors(notice)
            if len(notice) <= k:
                raise ValueError("a notice needs more characters than errors")
            self.notices.append((notice, label, k, regex.compile(rf"(?be)(?:{regex.escape(notice)}){{e<={k}}}")))
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at.setdefault(notice[a:b], []).append((i, a))
        for piece, owners in at.items():
            self.seeds.add_word(piece, (len(piece), owners))
        self.seeds.make_automaton()

    def windows(self, lower: str) -> dict[int, list[tuple[int, int]]]:
        """Per notice the stretches that can hold it; those that overlap are one."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, owners) in self.seeds.iter(lower):
            begin = end + 1 - size
            for i, offset in owners:
                notice, _, k, _ = self.notices[i]
                a, b = max(0, begin - offset - k), begin - offset + len(notice) + k
                have = found.setdefault(i, [])
                if have and a <= have[-1][1]:
                    have[-1] = (min(a, have[-1][0]), max(b, have[-1][1]))
                else:
                    have.append((a, b))
        return found

    def find(self, lower: str) -> list[Place]:
        """Places in order.  Of places that overlap, the one with the smaller share of errors stands (then the first)."""
        found: list[Place] = []
        for i, stretches in self.windows(lower).items():
            notice, label, k, pattern = self.notices[i]
            open_ = []
            for a, b in stretches:
                b = min(b, len(lower))
                open_ += [(max(a, first - len(notice) - k), last) for first, last in possible_ends(notice, lower, a, b, k)]
            while open_:
                a, b = open_.pop()
                if m := pattern.search(lower, a, b):  # the best of the stretch; others may stand on either side
                    found.append(Place(label, m.start(), m.end(), sum(m.fuzzy_counts), len(notice)))
                    open_ += [(x, y) for x, y in ((a, m.start()), (m.end(), b)) if x < y and (x, y) != (a, b)]
        taken = Spans()
        out = [p for p in sorted(found, key=lambda p: (p.edits / p.length, p.start, p.label)) if taken.take(p.start, p.end)]
        return sorted(out, key=lambda p: (p.start, p.end, p.label))


def phrase_places(low: bytes, starts: np.ndarray, phrases: dict[str, str] = PHRASES) -> list[tuple[str, int]]:
    """(label, index of the first word) for every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases.items():
        words = phrase.encode().split()
        if not all(w in low for w in words):
            continue
        # The look-ahead lets places overlap.
        pattern = re.compile(rb"(?<!" + _WORD + rb")(?=" + _BETWEEN.join(words) + rb"(?!" + _WORD + rb"))")
        out += [(label, int(np.searchsorted(starts, m.start()))) for m in pattern.finditer(low) if _INSIDE[low[m.start()]]]
    return out


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Per row of ``docs``: words, base places, fuzzy places (``spans``: label, start, end, edits), labels and a score.

    Starts and ends count characters of the text.  The score is 1 if there is a phrase or an exact notice, else the
    largest share of a notice's characters that stand without error, else 0.  A null text counts as empty; null or
    repeated ids and repeated rows are rows like any other; an empty table gives no rows; other columns are ignored.
    """

    def run(cols: dict, fuzzy: FuzzyNotices) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for key, text in zip(cols["doc_id"], cols["text"], strict=True):
            lower = (text or "").translate(_LOWER_TEXT)
            low = lower.encode()
            starts, _ = word_bounds(_INSIDE[np.frombuffer(low, np.uint8)])
            base = phrase_places(low, starts, phrases)
            places = fuzzy.find(lower)
            labels = {label for label, _ in base}
            score = 1.0 if base else max((1 - p.edits / p.length for p in places), default=0.0)
            row = (
                key, len(starts), len(base), min((w for _, w in base), default=None), max((w for _, w in base), default=None),
                ",".join(sorted(labels)), ",".join(sorted(labels | {p.label for p in places})), max(0.0, score), [(p.label, p.start, p.end, p.edits) for p in places],
            )
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: int, stop: int, edits: int>>"
    return map_columns(docs.select("doc_id", "text"), run, schema, lambda: FuzzyNotices(notices))
