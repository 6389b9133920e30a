"""Column functions and small Python helpers over document text."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from bondsight.functions import wording

# Words that mark English text, abbreviations that end no sentence, months.
COMMON = ("the", "and", "for", "with", "from", "that", "this", "are", "was", "has", "have", "been", "will", "its", "our", "not", "which", "their", "than", "also")
ABBREVIATIONS = frozenset("inc co corp ltd plc no vs u.s s.a s.p.a e.g i.e mr ms mrs dr jr sr st approx n.v a.g llc l.p".split())
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
READABLE_FROM, READABLE_RATE = 500, 6.0
HISTORY_DAYS = 365

TERMINAL, CLOSERS, SPACES = ".!?;:", "\"')]\u2019\u201d", " \t\r\f\v"
MONTH_OF = {name: i for i, m in enumerate(MONTHS, 1) for name in (m, m[:3])} | {"sept": 9}
WORD_OR_NUMBER = re.compile(r"[a-z]+|\d+", re.I)
WORD = re.compile(rf"[^{SPACES}\n]+")
ORDINALS = frozenset(("st", "nd", "rd", "th"))

# HTML that carries no text, that breaks lines, that makes cells, and what issuer pages drop besides.
NO_TEXT = frozenset("script style head noscript template ix:header".split())
BLOCKS = frozenset("p div br tr li h1 h2 h3 h4 h5 h6 table thead tbody tfoot ul ol blockquote section article header footer pre hr title dl dt dd caption address main nav".split())
CELLS = frozenset(("td", "th"))
PAGE_DROPS = frozenset("nav aside footer form button iframe svg".split())
CONTENT = frozenset("html body main article".split())
BOILERPLATE = re.compile("related|teaser|slider|carousel|recommend|cookie|breadcrumb|sidebar|share-bar|social-share|newsletter", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def readable(text: Column) -> Column:
    """N-07: short texts are; longer ones need READABLE_RATE common words in 1000 characters."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(*COMMON))
    return (F.length(text) < READABLE_FROM) | (F.size(words) * 1000 / F.length(text) >= READABLE_RATE)


#: A sign of any dash or minus, figures with commas, a decimal point.
NUMBER = r"[-‐‑‒–−]?\d[\d,]*(?:\.\d+)?"


def numbers(text: Column) -> Column:
    """X-06: signed numbers; commas part thousands, and a comma before one or two last digits is a decimal one."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    signed = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "^[‐‑‒–−]", "-"), r",(\d{1,2})$", ".$1"))
    return F.transform(signed, lambda x: F.regexp_replace(x, ",", "").try_cast("double"))


def amount(text: Column) -> Column:
    """X-07: the first amount of money, scaled by its unit, sign first or else name last; a bare figure under 1000 is none."""

    def found(pattern: str) -> Column:
        figures, units = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
        scale = F.create_map(*(x for u, s in wording.UNITS.items() for x in (F.lit(u), F.lit(s))))
        each = F.zip_with(figures, units, lambda f, u: F.struct(u.alias("u"), (F.regexp_replace(F.regexp_replace(f, r",(\d{1,2})$", ".$1"), ",", "").try_cast("double") * F.coalesce(F.try_element_at(scale, F.lower(u)), F.lit(1.0))).alias("x")))
        return F.try_element_at(F.filter(each, lambda e: (e["x"] >= 1000) | ((e["u"] != "") & e["x"].isNotNull())), F.lit(1))["x"]

    return F.coalesce(found(wording.AMOUNT), found(wording.AMOUNT_NAMED))


def find_dates(text: str) -> list[tuple[dt.date, int, int]]:
    """X-03: spelled dates with offsets, in order, none overlapping; impossible ones are left out.

    The text's words and numbers are scanned for a month's name with a day and a year beside it.
    """
    parts = [(m.group().lower(), m.start(), m.end()) for m in WORD_OR_NUMBER.finditer(text)]
    gap = lambda i: text[parts[i][2] : parts[i + 1][1]]  # noqa: E731  what stands between a part and the next
    year = lambda i: i < len(parts) and len(parts[i][0]) == 4 and parts[i][0].isdigit() and not text[parts[i][2] : parts[i][2] + 1].isalnum()
    day = lambda i: 0 <= i < len(parts) and parts[i][0].isdigit() and len(parts[i][0]) < 3
    out, free = [], 0
    for i, (word, start, end) in enumerate(parts):
        if word not in MONTH_OF or start < free:
            continue
        after = i + 1
        first = last = None
        if day(after) and gap(i).lstrip(".").isspace():  # month, day, year
            to = after + 1 + (after + 1 < len(parts) and parts[after + 1][0] in ORDINALS and not gap(after))
            if year(to) and gap(to - 1).lstrip(",").isspace() and not text[start - 1 : start].isalnum():
                first, last, number = start, to, parts[after][0]
        if last is None and i and year(after) and gap(i).lstrip(".,") and gap(i).lstrip(".,")[0] in " \n\t-":  # day, month, year
            at = i - 1 - (parts[i - 1][0] in ORDINALS and i > 1 and not gap(i - 2))
            if day(at) and len(gap(i - 1)) == 1 and gap(i - 1) in " \n\t-" and not text[parts[at][1] - 1 : parts[at][1]].isalnum() and parts[at][1] >= free:
                first, last, number = parts[at][1], after, parts[at][0]
        if last is not None:
            try:
                found = dt.date(int(parts[last][0]), MONTH_OF[word], int(number))
            except ValueError:
                continue
            free = parts[last][2]
            out.append((found, first, free))
    return out


def wraps(line: str, after: str) -> bool:
    """X-01: whether a line goes on in the one after it."""
    held, rest = line.rstrip(SPACES), after.lstrip(SPACES)
    if not held or not rest or "|" in line or "|" in after or held.rstrip(CLOSERS)[-1:] in (*TERMINAL,):
        return False
    return unicodedata.category(rest[0]) == "Ll" or (held.endswith("-") and after[0].isalpha())


def lines_of(text: str) -> list[tuple[int, str]]:
    """X-01: lines with their offsets, wrapped ones joined."""
    parts = text.split("\n")
    out, begin, at = [], 0, 0
    for i, line in enumerate(parts):
        at += len(line) + 1
        if i + 1 == len(parts) or not wraps(line, parts[i + 1]):
            out.append((begin, text[begin : at - 1]))
            begin = at
    return out


#: A word with its terminal sign before white space and a word that may begin a sentence.
END = re.compile(rf"(?<![^{SPACES}\n])([^{SPACES}\n]*[.!?])[{SPACES}\n]+(?=[A-Z0-9(\"'\u201c])")


def closes(word: str) -> bool:
    """Whether a word with a full stop, question or exclamation mark ends a sentence: abbreviations and initials don't."""
    stem = word[:-1].rstrip(".").lower()
    cut = max((i for i, c in enumerate(stem) if not (c.isascii() and c.isalpha()) and c not in ".&"), default=-1)
    stem = stem[cut + 1 :]
    return not (stem in ABBREVIATIONS or len(stem) == 1 and stem.isalpha())


def sentences_of(text: str) -> list[tuple[int, int, str]]:
    """X-02: (start, end, sentence) in code points; only words with a terminal sign are looked at."""
    out = []
    for base, line in lines_of(text):
        begin = len(line) - len(line.lstrip(SPACES + "\n"))
        for m in END.finditer(line):
            if closes(m[1]):
                out.append((base + begin, base + m.end(1), line[begin : m.end(1)]))
                begin = m.end()
        last = len(line.rstrip(SPACES + "\n"))
        if begin < last:
            out.append((base + begin, base + last, line[begin:last]))
    return out


class Lines(HTMLParser):
    """N-02, N-03: line text of a page; with `page`, navigation, related blocks and a header that holds a nav go too."""

    def __init__(self, page: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.out, self.gone = page, [], []
        self.headers: list[int] = []  # where the output stood when each open header began

    def dropped(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag in NO_TEXT or re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
            return True
        if not self.page or tag in CONTENT:
            return False
        return tag in PAGE_DROPS or bool(BOILERPLATE.search(" ".join(attrs.get(k) or "" for k in ("id", "class", "role", "data-component"))))

    def handle_starttag(self, tag, attrs):
        if self.page and tag == "nav" and self.headers:  # the outermost open header goes, with what it has given so far
            del self.out[self.headers[0] :]
            self.gone = ["header"] * len(self.headers) + self.gone
            self.headers = []
        if self.gone or (tag not in VOID and self.dropped(tag, dict(attrs))):
            if tag not in VOID:
                self.gone.append(tag)
            return
        if tag == "header":
            self.headers.append(len(self.out))
        self.out.append("\n" if tag in BLOCKS else " " if tag in CELLS else "")

    def handle_endtag(self, tag):
        if self.gone:
            if tag in self.gone:
                while self.gone.pop() != tag:
                    pass
            return
        if tag == "header" and self.headers:
            self.headers.pop()
        self.out.append("\n" if tag in BLOCKS else " | " if tag in CELLS else "")

    def handle_data(self, data):
        if not self.gone:
            self.out.append(data)


#: An ampersand, with the entity that it opens if a semicolon closes one.
ENTITY = re.compile(r"&(#\d+;|#[xX][\da-fA-F]+;|\w+;)?")


def closed_entities(html: str) -> str:
    """The markup with each ampersand that opens no entity, or one that no semicolon closes, as a plain sign."""
    return ENTITY.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html)


def html_lines(html: str, page: bool, closed: bool = False) -> str:
    """closed: entities count with their semicolon only, else old names without one too, as in browsers."""
    parser = Lines(page)
    parser.feed(closed_entities(html or "") if closed else html or "")
    parser.close()
    return canonical("".join(parser.out))


#: What an outlook is called, and what a watch's direction is told by.
OUTLOOKS = ("positive", "stable", "negative", "developing")
WATCHES = {"negative": ("creditwatch negative", "watch negative", "review for downgrade", "rwn"), "positive": ("creditwatch positive", "watch positive", "review for upgrade", "rwp"), "developing": ("creditwatch developing", "watch developing", "review direction uncertain")}


def outlook_of(cell: str) -> tuple[str | None, str]:
    """M-06 for one cell of text: outlook and watch; a watch leaves the outlook null, unknown text gives neither."""
    low = cell.strip().lower()
    watch = next((w for w, marks in WATCHES.items() if any(m in low for m in marks)), "none")
    return (low if watch == "none" and low in OUTLOOKS else None), watch


#: Spaces that aren't the plain one, and signs without width.
WIDE, NO_WIDTH = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", "\u200b\u200c\u200d\u2060\ufeff"
PLAIN = str.maketrans({**dict.fromkeys(WIDE, " "), **dict.fromkeys(NO_WIDTH)})


def canonical(text: str) -> str:
    """N-01: NFC, plain spaces, no zero-width signs, no empty lines, no trailing cell mark; twice is once."""
    plain = unicodedata.normalize("NFC", text or "").translate(PLAIN)
    lines = (" ".join(WORD.findall(line)) for line in plain.split("\n"))
    return "\n".join(x for x in (line.removesuffix("|").rstrip() for line in lines) if x)
