"""License notices in texts: exact phrases, and fuzzy short notices with their spans.

Texts are lower-cased (A-Z) and cut into words. A notice with up to e edits is found
in two steps. Cut into e + 1 pieces, at least one piece of it is unharmed wherever it
occurs (pigeonhole), so the pieces' exact occurrences, found by one Aho-Corasick pass
over the text, locate all candidates. Each candidate's surroundings go to the regex
library, whose bounded-error matching verifies the edits and gives the span.

Texts are used whole. Null and empty texts have no words and no labels. Rows are
scanned one by one, so repeated rows and null ids stay. Extra columns are ignored. An
empty table gives an empty result.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAPS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

# Exact phrases and their labels (fixed values).
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}


@dataclass(frozen=True)
class Notice:
    """A short notice as words with single spaces, in parts with the edits each may have.

    A part without a space at either end is a naming word, which tells the notice from
    others; it must stand as a whole word, a short one exactly.
    """

    label: str
    parts: tuple[tuple[str, int], ...]

    @property
    def text(self) -> str:
        return "".join(text for text, _ in self.parts)

    @property
    def edits(self) -> int:
        return sum(edits for _, edits in self.parts)

    @property
    def pattern(self) -> str:
        found = []
        for text, edits in self.parts:
            part = rf"(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}"
            names = not text.startswith(" ") and not text.endswith(" ")
            found.append(rf"(?<![^ ]){part}(?![^ ])" if names else part)
        return "".join(found)


NOTICES = (
    Notice("mit", (("released under the ", 2), ("mit", 0), (" license", 1))),
    Notice("mit", (("permission is hereby ", 2), ("granted", 1), (" free of ", 1), ("charge", 1),
                   (" to any person obtaining a copy", 2))),
    Notice("apache", (("licensed under the ", 2), ("apache", 1), (" license version", 1))),
    Notice("gpl", (("under the ", 1), ("gnu", 0), (" ", 0), ("general", 1), (" public license", 2))),
    Notice("lgpl", (("gnu ", 0), ("lesser", 1), (" general public license", 2))),
    Notice("agpl", (("gnu ", 0), ("affero", 1), (" general public license", 2))),
    Notice("cc-by-nc", (("licensed under ", 2), ("cc by nc", 0))),
    Notice("cc-by", (("creative ", 1), ("commons", 1), (" ", 0), ("attribution", 1), (" license", 1))),
    Notice("bsd", (("redistribution", 1), (" and use in ", 1), ("source", 1), (" and ", 1),
                   ("binary", 1), (" forms", 1))),
    Notice("mpl", (("subject to the terms of the ", 3), ("mozilla", 1), (" public license", 2))),
)


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece): the notice cut into one piece more than it may have edits."""
    count = notice.edits + 1
    edges = [len(notice.text) * n // count for n in range(count + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(edges, edges[1:])]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        import ahocorasick

        self.notices = notices
        # The first match from the left, its edits then made as few as can be: the best
        # match of a window would hide others before it.
        self.patterns = [
            regex.compile(rf"(?e){n.pattern}")
            for n in notices
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(notices):
            for offset, piece in pieces(notice):
                seeds.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def fuzzy(self, line: str) -> list[tuple[str, int, int, int, int]]:
        """(label, begin, end, edits, notice) of each notice found in a line of words."""
        windows: dict[int, list[list[int]]] = {}
        for last, (length, places) in self.automaton.iter(line):
            for number, offset in places:
                notice = self.notices[number]
                begin = last + 1 - length - offset - notice.edits
                end = begin + len(notice.text) + 2 * notice.edits
                own = windows.setdefault(number, [])
                if own and begin <= own[-1][1]:
                    own[-1][0] = min(own[-1][0], begin)
                    own[-1][1] = max(own[-1][1], end)
                else:
                    own.append([begin, end])
        found = []
        for number, own in windows.items():
            pattern, label = self.patterns[number], self.notices[number].label
            for begin, end in own:
                for match in pattern.finditer(line, max(0, begin), min(len(line), end)):
                    found.append(
                        (label, match.start(), match.end(), sum(match.fuzzy_counts), number)
                    )
        return sorted(found)

    def scan(self, text: str | None) -> dict:
        """Counts, places, labels, score and spans of one text."""
        plain = (text or "").translate(_LOWER) if text and not text.islower() else (text or "")
        line = _GAPS.sub(" ", plain).strip(" ")
        words = line.count(" ") + 1 if line else 0
        starts, base = [], set()
        padded = f" {line} "
        for phrase, label in PHRASES.items():
            at = padded.find(f" {phrase} ")
            while at >= 0:
                starts.append(padded.count(" ", 0, at))
                base.add(label)
                at = padded.find(f" {phrase} ", at + 1)
        spans = self.fuzzy(line)
        best = max((1 - e / len(self.notices[n].text) for *_, e, n in spans), default=0.0)
        return {
            "n_words": words,
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {label for label, *_ in spans})),
            "score": 1.0 if base else max(0.0, best),
            "spans": [
                {"label": label, "begin": a, "end": b, "edits": e, "text": line[a:b]}
                for label, a, b, e, _ in spans
            ],
        }


@lru_cache(maxsize=2)
def _scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


_COLUMNS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
    "spans": pa.list_(pa.struct([
        ("label", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()),
        ("text", pa.string()),
    ])),
}
SCHEMA = (
    "doc_id BIGINT, n_words BIGINT, n_base BIGINT, first_word BIGINT, last_word BIGINT, "
    "base_labels STRING, labels STRING, score DOUBLE, "
    "spans ARRAY<STRUCT<label: STRING, begin: INT, end: INT, edits: INT, text: STRING>>"
)


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per document; spans are places in the text's words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(notices)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(
                        pa.array([r[name] for r in rows], kind) for name, kind in _COLUMNS.items()
                    )],
                    names=["doc_id", *_COLUMNS],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
