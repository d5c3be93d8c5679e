"""Template residue, filler, error pages and script notices in place of content.

A multi-pattern automaton marks what known phrases cover of a cell; a cell whose letters are mostly
covered is residue. Unfilled placeholders and repeated filler words, which no list of phrases can hold,
are marked the same way. Quotations, code spans and formulas cover nothing, so text that explains such
strings stays below the threshold.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shutterstack.llm.notices import ERROR, FILLER, LOOSE, SCRIPT, SHOWN, phrases
from shutterstack.session import broadcast_if_small, checkpointed, ship_package

#: Share of a cell's letters that marked text has to reach; the share of firm phrases from which loose ones count, and the share to be reached with them.
THRESHOLD, FIRM, LOOSELY = 0.6, 0.15, 0.85

# The words of the usual filler text.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi "
    "aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
_NAMED = r"[A-Za-z_][\w .-]{0,60}?"
_FIELD = "name|title|company|organi[sz]ation|author|founder|date|year|city|country|address|e-?mail|phone|url|link|topic|subject|product|course|department|position"
#: Placeholders nobody filled in, in the notations of common template engines and forms.
PLACEHOLDER = re.compile(
    r"\{\{[^\S\n]*" + _NAMED + r"[^\S\n]*\}\}|\{%.{1,60}?%\}|<%=?.{1,60}?%>|\$\{" + _NAMED + r"\}|#\{" + _NAMED + r"\}|@@\w{1,60}@@|__[A-Z][A-Z_]*__|%[A-Z][A-Z_]+%|\[\[" + _NAMED + r"\]\]"
    r"|(?<![\w\]])\[(?=(?-i:[A-Z]))(?:[\w]+[ _-]){0,3}(?:" + _FIELD + r")(?:[ _-][\w]+)?\](?![(\[\w])"
    r"|\[(?:insert|your|add|enter|replace|todo|tbd)\b[^\]\n]{0,60}\]|<<" + _NAMED + r">>|<[A-Za-z][\w ]{0,60}? here>|&lt;[A-Za-z][\w ]{0,60}?&gt;|(?<![\\$\w{}])\{[A-Za-z][\w ]{2,60}\}(?!\})",
    re.I,
)
_UPPER_ONLY = re.compile(r"__[A-Z][A-Z_]*__|%[A-Z][A-Z_]+%")
_QUOTED = re.compile(r"``.+?``|`[^`\n]*`|\$\$.+?\$\$|\$(?!\{)[^$\n]+\$|\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|«[^»\n]{1,300}»|„[^“”\n]{1,300}[“”]", re.S)
_TAG = re.compile(r"(?<!<)</?(?:html|head|body|center|title|h[1-6]|p|div|span|noscript|b|i|strong|em|br|hr|a|pre)(?:\s+[\w-]+\s*=[^<>]*)?\s*/?>(?!>)", re.I)
_UNIT = re.compile(r"[.!?](?=\s)|[\n|]")
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")
_IDENTIFIER = re.compile(r"(?:request id|reference|code)\s*[:#]?\s*#?\s*([0-9a-f-]{2,64})\b")

#: Scripts written without spaces, whose words have no boundaries to look for.
_UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def build_automata():
    """The firm phrases, with the kinds each belongs to, and the loose ones that stand between them, each in an automaton."""
    import ahocorasick

    firm, loose = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, kind in phrases().items():
        if kind & ~LOOSE:
            firm.add_word(phrase, (len(phrase), kind))
        if kind & (LOOSE | SHOWN):
            loose.add_word(phrase, (len(phrase), kind))
    firm.make_automaton()
    loose.make_automaton()
    return firm, loose


def _runs_on(left: str, right: str) -> bool:
    """Whether two neighbouring characters are of one word."""
    return left.isalnum() and right.isalnum() and not _UNSPACED.match(left) and not _UNSPACED.match(right)


def _letters(text: str) -> int:
    return sum(len(m) for m in _WORD.findall(text))


def _blank(match: re.Match) -> str:
    return "\x00" * len(match.group())


class Detector:
    """Tells which cells are residue. One is built in each Python worker."""

    def __init__(self, threshold: float = THRESHOLD):
        self.threshold, self.lorem = threshold, frozenset(LOREM)
        self.firm, self.loose = build_automata()

    @staticmethod
    def _matches(automaton, text: str) -> list[tuple[int, int, int]]:
        found = []
        for end, (length, kind) in automaton.iter(text):
            start = end + 1 - length
            if not (start and _runs_on(text[start - 1], text[start])) and not (end + 1 < len(text) and _runs_on(text[end], text[end + 1])):
                found.append((start, end + 1, kind))
        return found

    def _covered(self, text: str, total: int, *choices: int) -> bool:
        """Whether phrases of the kinds of any choice cover enough letters. What was to be shown counts beside another phrase, and loose phrases where the others cover enough."""
        found, words = self._matches(self.firm, text), None
        shown = [(i, j) for i, j, kind in found if kind & SHOWN]
        for kinds in choices:
            own = [(i, j) for i, j, kind in found if kind & kinds]
            if sum(j - i for i, j in own) + sum(j - i for i, j in shown) + (len(text) if kinds & ERROR and own else 0) < FIRM * total:
                continue
            if not own:
                continue
            cover = bytearray(len(text))
            for i, j in own:
                cover[i:j] = b"\x01" * (j - i)
            for i, j in shown:
                if any(cover[j : j + 2]):
                    cover[i:j] = b"\x01" * (j - i)
            if kinds & ERROR:
                for m in _IDENTIFIER.finditer(text):
                    cover[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
            words = words or [m.span() for m in _WORD.finditer(text)]
            share = sum(cover.count(1, i, j) for i, j in words) / total
            if share >= self.threshold:
                return True
            # a single common word is no notice, whatever stands around it
            if share >= FIRM and any(" " in text[i:j] or _UNSPACED.match(text, i) for i, j in own):
                for i, j, _ in self._matches(self.loose, text):
                    cover[i:j] = b"\x01" * (j - i)
                if sum(cover.count(1, i, j) for i, j in words) >= LOOSELY * total:
                    return True
        return False

    def _template_share(self, text: str, total: int) -> float:
        """Share of the letters in sentences, lines and table cells that hold an unfilled placeholder, with the labels of a form beside it."""
        spans = [m.span() for m in PLACEHOLDER.finditer(text) if not (m.group()[0] in "_%" and not _UPPER_ONLY.fullmatch(m.group()))]
        if not spans:
            return 0.0
        starts, covered = [s for s, _ in spans], 0
        for start, stop in self._lines(text):
            # placeholders hold no line break, so those of a line are next to each other
            own = spans[bisect_left(starts, start) : bisect_left(starts, stop)]
            row = text[start:stop]
            if not own:
                continue
            if row.lstrip().startswith("|"):
                covered += _letters(row)
                continue
            cuts = [start, *(start + m.end() for m in _UNIT.finditer(row)), stop]
            held = {bisect_right(cuts, p) - 1 for s, e in own for p in (s, e - 1)}
            covered += sum(_letters(text[cuts[i] : cuts[i + 1]]) for i in held if i + 1 < len(cuts))
        return covered / total

    @staticmethod
    def _lines(text: str) -> Iterator[tuple[int, int]]:
        start = 0
        for line in text.split("\n"):
            yield start, start + len(line)
            start += len(line) + 1

    def text_cell(self, cell: str) -> bool:
        """An unfilled template, filler, an error or unavailability page or a script notice."""
        body = _QUOTED.sub(_blank, _TAG.sub(" ", cell))
        words = _WORD.findall(body.lower())
        total = sum(map(len, words)) + _letters("".join(m.group() for m in _QUOTED.finditer(cell)))
        if not words:
            return False
        if len(words) >= 5 and (len(set(words)) <= 2 or sum(len(w) for w in words if w in self.lorem) >= 0.8 * total):
            return True
        if len(words) >= 4 and "ipsum" in words and sum(len(w) for w in words if w in self.lorem) >= self.threshold * total:
            return True
        if self._template_share(body, total) >= self.threshold:
            return True
        flat = _SPACE.sub(" ", re.sub(r"[*_#>]+", " ", body).lower().replace("’", "'")).strip()
        return self._covered(flat, total, SCRIPT, ERROR, FILLER, SCRIPT | ERROR)

    def output_cell(self, cell: str) -> bool:
        """A script notice in place of an output. Every such phrase names scripts or what waits for them."""
        low = cell.lower()
        if "script" not in low and "js" not in low and "checking your browser" not in low:
            return False
        body = _QUOTED.sub(_blank, _TAG.sub(" ", low))
        total = _letters(body) + _letters("".join(m.group() for m in _QUOTED.finditer(low)))
        flat = _SPACE.sub(" ", re.sub(r"[*_#>]+", " ", body).replace("’", "'")).strip()
        return bool(total) and self._covered(flat, total, SCRIPT) and re.search(r"script|\bjs\b|browser", flat) is not None


def _residue_batches(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    detector = Detector(threshold)
    for batch in batches:
        texts, lists = batch.column("text"), batch.column("cells")
        cells = lists.flatten()
        offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))]).astype(np.int64)
        kinds, first, size = cells.field("kind").to_pylist(), cells.field("first_char").to_pylist(), cells.field("n_chars").to_pylist()
        ids, out = batch.column("doc_id"), []
        for row in range(batch.num_rows):
            text = texts[row].as_py()
            if not text:
                continue
            whole = not lists[row].is_valid
            for kind, start, length in [("markdown", 0, len(text))] if whole else zip(*(x[offsets[row] : offsets[row + 1]] for x in (kinds, first, size))):
                if start is None or not length or kind not in ("markdown", "output"):
                    continue
                body = text[max(0, start) : start + length]
                if detector.text_cell(body) if kind == "markdown" else detector.output_cell(body):
                    out.append(row)
                    break
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(out, pa.int64()))], names=["doc_id"])


def without_residue(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay: all rows and columns but those of the doc_ids that ``residue_documents`` gives. A row without doc_id stays.

    Only the ids found are shuffled or broadcast (if a count shows them to be few); of the documents, where they are many, the rows are.
    """
    found = checkpointed(residue_documents(documents.where("doc_id is not null"), threshold))
    return documents.join(broadcast_if_small(found), "doc_id", "left_anti").select(*documents.columns)


def residue_documents(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``(doc_id)``: the documents with a text cell that is residue, or an output that is a script notice.

    A cell counts if phrases, placeholders or filler words make up at least ``threshold`` of its letters;
    letters in quotations, code spans and formulas count as content. Whole texts are read, each cell on its
    own; code is never looked at. A document without a list of cells is taken as one text cell; null and empty texts and cells are no
    case, nor are empty notebooks. A cell beyond the end of its text is cut there. A doc_id that is repeated is
    given once, a null one too. Other columns are never read, and nothing is shuffled but the ids found.
    """
    ship_package(documents.sparkSession)
    rows = documents.select("doc_id", "text", "cells")
    found = rows.mapInArrow(lambda batches: _residue_batches(batches, threshold), documents.select("doc_id").schema)
    return found.distinct()
