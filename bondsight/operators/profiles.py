"""Rating tables inside texts, by profile: each profile is a walk over a document's lines, run as a Python UDTF.

A walk keeps a small state from line to line (a heading waits for its table, a table takes rows) and gives a row for
each agency's line: what it says, or why it says nothing. Only texts that can hold a table of the profile reach Python,
which a pattern decides in the scan. Lines that look like nothing cost one test.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bondsight.functions import scales
from bondsight.functions import textfns as tf

#: Lines that may stand between a heading and its table, rows that a table may have; months as headings spell them.
MOST_WAITING, MOST_ROWS = 3, 8
STATED = rf"(?i)\bas of\s+((?:{'|'.join(tf.MONTHS)})\s+\d{{1,2}},\s+\d{{4}})\b"
#: Footnote marks after an agency's name.
FOOTNOTES = r"(?:\(\w{1,2}\)|[*†‡])+$"
ROW = "n int, start int, end int, agency string, label string, outlook string, watch string, as_of date, skip string"


class Line(NamedTuple):
    n: int
    start: int
    end: int
    text: str

    @property
    def cells(self) -> list[str]:
        return [c.strip() for c in self.text.split("|")]


def lines_at(text: str) -> list[Line]:
    out, at = [], 0
    for n, line in enumerate(text.split("\n")):
        out.append(Line(n, at, at + len(line), line))
        at += len(line) + 1
    return out


def agency_of(name: str) -> str | None:
    """The agency that a cell names, footnote marks aside."""
    return scales.AGENCY_OF.get(" ".join(re.sub(FOOTNOTES, "", name.strip()).replace("’", "'").lower().split()))


def long_term_last(header: str) -> bool | None:
    """Whether the long-term column follows the short-term one; null if there is no long-term column."""
    low = header.lower().replace("-", " ")
    return 0 <= low.find("short term") < low.find("long term") if "long term" in low else None


def reading(first: Line, last: Line, cells: list[str], agency: str, prefer_last: bool, day=None) -> tuple:
    """A row of ROW from an agency's cells after the first: the long-term label, and the first outlook or watch after it."""
    found = [(i, x) for i, c in enumerate(cells) if i and (x := scales.label_of(agency, c))]
    if not found:
        return first.n, first.start, last.end, agency, None, None, None, None, "no_long_term_label"
    i, label = found[-1 if prefer_last else 0]
    outlook, watch = next((x for c in cells[i + 1 :] if (x := tf.outlook_of(c)) != (None, "none")), (None, "none"))
    return first.n, first.start, last.end, agency, label, outlook, watch, day, None


def as_of_rows(lines: list[Line], names: list[str]) -> Iterator[tuple]:
    """E-11: rows under a heading on ratings "as of <Month D, YYYY>", dated by it.

    At most MOST_WAITING lines come before the first row, a header among them telling which column counts; the table ends
    at the first line that is no agency's, or with MOST_ROWS rows. An agency alone on its line goes on in the next if
    that begins with a cell mark. A line that waits for a table is no heading itself.
    """
    day, waited, rows, prefer_last, done = None, 0, 0, False, -1
    for line, after in zip(lines, [*lines[1:], None], strict=True):
        if line.n <= done:
            continue
        if day:
            cells, end = line.cells, line
            agency = agency_of(cells[0]) if len(cells) > 1 else None
            if len(cells) == 1 and after and "|" in after.text and not after.cells[0]:
                agency, cells, end = agency_of(line.text), after.cells, after
            if agency:
                yield reading(line, end, cells, agency, prefer_last, day)
                rows, done = rows + 1, end.n
                if rows == MOST_ROWS:
                    day = None
                continue
            if not rows:
                header = long_term_last(line.text)
                prefer_last = prefer_last if header is None else header
                waited += 1
                if waited > MOST_WAITING:
                    day = None
                continue
            day = None
        found = re.search(STATED, line.text) if "rating" in line.text.lower() else None
        if found and (dates := tf.find_dates(found[1])):
            day, waited, rows, prefer_last = dates[0][0], 0, 0, False


def current_rows(lines: list[Line], names: list[str]) -> Iterator[tuple]:
    """E-12: the row of an entity under a header that begins with the agency and names the long term; undated.

    Lines that begin with a cell mark go on with the row. A row that names an agency first is a header, not an entity.
    """
    header = row = None
    for line in [*lines, None]:
        if row and line and line.text.startswith("|"):
            row = (row[0], line, row[2] + line.cells[1:])
            continue
        if row:
            first, last, cells = row
            known = not names or " ".join(cells[0].lower().split()) in names
            yield reading(first, last, cells, *header) if known else (first.n, first.start, last.end, header[0], None, None, None, None, "entity_mismatch")
            row = header = None
        if line is None:
            return
        cells = line.cells
        agency = agency_of(cells[0]) if len(cells) > 1 else None
        if header and len(cells) > 1 and cells[0] and not agency:
            row = (line, line, cells)
            continue
        header = (agency, prefer) if agency and (prefer := long_term_last(line.text)) is not None else None


def dated_rows(lines: list[Line], names: list[str]) -> Iterator[tuple]:
    """E-13: rows "date | label ..." below an agency's own line and a header of date and rating, up to a row without a date."""
    alone = table = None
    for line in lines:
        cells = line.cells
        if table:
            dates = tf.find_dates(cells[0]) if len(cells) > 1 else []
            if dates and dates[0][2] == len(cells[0]):
                yield reading(line, line, cells, table, False, dates[0][0])
                continue
            table = None
        if alone:
            low = line.text.lower()
            table, alone = (alone if len(cells) > 1 and "date" in low and "rating" in low else None), None
            if table:
                continue
        alone = agency_of(line.text) if len(cells) == 1 else None


#: Profile name to its walk and to what a text needs to hold a table of it.
PROFILES = {
    "as_of": (as_of_rows, rf"(?i)rating[^\n]*{STATED[4:]}|{STATED[4:]}[^\n]*rating"),
    "current": (current_rows, r"(?i)long[\s-]term"),
    "dated": (dated_rows, r"(?i)\|[^\n]*(?:date|rating)|(?:date|rating)[^\n]*\|"),
}


class TableRows:
    """UDTF: the rows of a text's tables by a profile's name; names: the entity's, in lower case, for those that ask."""

    def eval(self, text: str, profile: str, names: list[str]) -> Iterator[tuple]:
        yield from PROFILES[profile][0](lines_at(text), names)


def may_hold(text: Column, profile: str) -> Column:
    return text.contains("|") & text.rlike(PROFILES[profile][1])


def rating_rows(docs: DataFrame, profile: str, names: list[str] | None = None) -> DataFrame:
    """E-11 to E-13: (doc_id, ROW, notch) of documents (doc_id, text), one row for each row of a table."""
    table = F.udtf(TableRows, returnType=ROW, useArrow=True)
    known = F.array(*(F.lit(" ".join(x.lower().split())) for x in names or [])).cast("array<string>")
    some = docs.select("doc_id", "text").where(may_hold(F.col("text"), profile))
    rows = some.lateralJoin(table(F.col("text").outer(), F.lit(profile), known)).drop("text")
    return scales.label_to_notch(rows, "agency", "label", "notch")
