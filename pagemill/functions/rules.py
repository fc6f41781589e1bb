"""Rules that tell headings, formulas, notes and marks by their text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as mathematics, of candidates from parsers and of recovered text.
FORMULA_CHARS = "=+−×÷∑∫∏√∞≠≤≥±()[]{}^_\\αβγδϵθλμπσφω"
MATH_CHARS = "=+-−×∑∏∫√∞≠≤≥±^_\\()[]{}/0123456789αβγδϵθλμπσφωxyzabcnfdeXYZABCNFD"
# Limits of formulas, headings and notes.
FORMULA_MOST, FORMULA_SHARE = 200, 0.15
DISPLAY_MOST, DISPLAY_SHARE, SOLO_MOST, SOLO_SHARE = 80, 0.3, 30, 0.5
HEADING_MOST, BODY_LEAST, HEADING_FONT = 80, 40, 1.15
NOTE_ZONE, NOTE_FONT = 0.72, 0.95
AUTHOR_MOST, ROLE_SHORT, ROLE_MOST = 120, 40, 120
# Patterns. White space is that of Unicode.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NUMBERED = r"^(\p{Nd}+(?:\.\p{Nd}+)*)(?:\.|" + SPACE + ")"
BIBLIOGRAPHY = r"(?i)^(References|Bibliography|Works Cited)\s*:?\s*$"
ABSTRACT = r"(?i)^Abstract\s*:?\s*$"
DATE_LINE = r"^\p{Nd}{4}[-/]\p{Nd}{1,2}[-/]\p{Nd}{1,2}$"
AUTHOR_LINE = r"^(?:[A-Z][A-Za-z.\-]+\s+|[A-Z]\.\s+){1,4}[A-Za-z][A-Za-z.\-]+[.,]?$"
BODY_HEADING = r"(?i)^(?:Introduction|Background|Related Works?|Methods?|Methodology|Results?|Discussion|Conclusions?|Acknowledgemen?ts|References|Bibliography|Appendix|Appendices|Future Work|Limitations|Experiments?|Evaluation)\s*:?\s*$"
AFFILIATION = r"(?i)(University|Universität|Institute|Department|Dept\.|Laboratory|\bLab\b|College|School of|Faculty|Center|Centre|Inc\.|Ltd\.|GmbH|ORCID)"
NUMBER_LABEL = r"^\(\p{Nd}{1,3}\)$"
CITATION = r"\[\s*(\p{Nd}{1,3}(?:\s*[,;\x{2013}-]\s*\p{Nd}{1,3})*)\s*\]"
AUTHOR_YEAR = r"\(([A-Z][A-Za-z'\-]+)(?:\s+(?:et al\.|and\s+[A-Z][A-Za-z'\-]+|&\s*[A-Z][A-Za-z'\-]+))?,?\s+((?:19|20)\p{Nd}{2}[a-z]?)\)"
ENTRY_LABEL = r"^\s*\[(\p{Nd}{1,3})\]\s"
NOTE_MARKER = r"^(\p{Nd}{1,2}(?:\.|\s)|[*†‡§¶]\s?)"
BODY_REFERENCE = r"(\p{Nd}{1,2}|[*†‡§¶])(?=[\s.,;:!?)]|\z)"
STRUCTURAL = r"(?i)(?:Tables?|Tab\.|Figures?|Fig\.|Sections?|Sec\.|Equations?|Eq\.|Chapters?|Pages?|Columns?|Rows?|Items?)\s*$"
FIGURE_LABEL = r"(?i)^(?:Figure|Fig\.?)\s+([\w.\-]+)"
SECTION_HEAD, ABSTRACT_HEAD, REFERENCES_HEAD = r"^(\p{Nd}+(?:\.\p{Nd}+)*)\s+\S", r"(?i)^abstract\b", r"(?i)^(references|bibliography)\b"
AUTHOR_MARK = r"\([A-Z][A-Za-z'\-]+(?:\s+(?:et al\.?)?,?\s*\p{Nd}{4}[a-z]?)\)"
CAPTION = r"(?i)^(Figure|Fig\.?|Table)\s+\p{Nd}+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Lower case, and one space for each run of white space."""
    return strip(F.regexp_replace(F.lower(c), f"{SPACE}+", " "))


def count_of(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def math_density(c: Column) -> Column:
    """The share of mathematical characters among those that are not white space."""
    bare = F.regexp_replace(c, SPACE, "")
    return F.when(F.length(bare) > 0, count_of(bare, MATH_CHARS) / F.length(bare)).otherwise(0.0)


def looks_like_formula(c: Column) -> Column:
    own = strip(c)
    return (c != "") & (F.length(c) <= FORMULA_MOST) & (count_of(own, "=\\") > 0) & (count_of(own, FORMULA_CHARS) >= FORMULA_SHARE * F.length(own))


def is_display(c: Column) -> Column:
    """A short text that reads as displayed mathematics: no word of four letters, no colon or semicolon at its end."""
    own = strip(c)
    return (own != "") & (F.length(own) <= DISPLAY_MOST) & ~own.rlike("[:;]$") & ~own.rlike("[A-Za-z]{4,}") & (math_density(own) >= DISPLAY_SHARE)


def is_strong_math(c: Column) -> Column:
    own = strip(c)
    return (own != "") & (F.length(own) <= SOLO_MOST) & own.rlike("[=^_]") & (math_density(own) >= SOLO_SHARE)


def equation_number(c: Column) -> Column:
    own = strip(c)
    return F.when(own.rlike(NUMBER_LABEL), F.regexp_extract(own, r"^\((\p{Nd}{1,3})\)$", 1))


def heading(c: Column, label: Column) -> Column:
    """struct<level, numbering> of a heading, by its number or by name and label; null for others."""
    own = strip(c)
    number = F.regexp_extract(own, NUMBERED, 1)
    rest = strip(F.substring(own, F.length(F.regexp_extract(own, NUMBERED, 0)) + 1, F.length(own)))
    numbered = (number != "") & rest.rlike(r"^\p{L}")
    prose = ~own.rlike(r"[:;]$|[()=+_\\^]") & own.rlike("[A-Za-z]{4,}") & own.rlike(r"^[A-Za-z0-9][A-Za-z0-9 .,;:'\-]*$")
    named = own.rlike(BIBLIOGRAPHY) | own.rlike(ABSTRACT) | (F.coalesce(label, F.lit("")) == "HEADING_LIKE") & prose
    fits = (own != "") & (F.length(own) <= HEADING_MOST) & ~own.rlike(r"[=^_\\]")
    struct = lambda level, numbering: F.struct(level.cast("long").alias("level"), numbering.alias("numbering"))
    return F.when(fits & numbered, struct(F.size(F.split(number, r"\.")), number)).when(fits & named, struct(F.lit(1), F.lit(None).cast("string")))


def is_front_line(c: Column) -> Column:
    """An author, affiliation or date, and no heading of the body."""
    own = strip(c)
    words = F.size(F.split(own, f"{SPACE}+"))
    return ~own.rlike(BODY_HEADING) & (own.rlike(DATE_LINE) | own.rlike(AFFILIATION) | own.rlike(AUTHOR_LINE) & (words <= 6))


def is_body_sentence(c: Column) -> Column:
    return (F.length(c) >= BODY_LEAST) & c.rlike(r"[.!?:]$")


def is_author_line(c: Column, font: Column, body_font: Column) -> Column:
    own = strip(c)
    return (own != "") & (F.length(own) <= AUTHOR_MOST) & ~own.rlike(ABSTRACT_HEAD) & ~own.rlike(SECTION_HEAD) & ~((body_font > 0) & (font > body_font * HEADING_FONT)) & (own.contains(",") | own.contains(" and ") | own.rlike(AUTHOR_MARK))


def structure_role(c: Column) -> Column:
    short = F.length(c) < ROLE_SHORT
    return F.when(c.rlike(ABSTRACT_HEAD) & short, "ABSTRACT").when(c.rlike(REFERENCES_HEAD) & short, "REFERENCES").when(c.rlike(SECTION_HEAD) & (F.length(c) <= ROLE_MOST), "SECTION")


def is_heading_like(text: Column, font: Column, body_font: Column, n_lines: Column) -> Column:
    return (body_font > 0) & (font >= HEADING_FONT * body_font) & ~text.contains("=") & (F.length(text) <= 120) & (n_lines <= 2)


def is_footnote(kind: Column, label: Column, text: Column, y: Column, font: Column, page_height: Column, body_font: Column) -> Column:
    """A small text with a marker in the lower part of its page."""
    small = ~((body_font > 0) & (font > NOTE_FONT * body_font))
    return (kind == "TEXT") & ~label.isin("HEADING_LIKE", "CAPTION_LIKE") & (page_height > 0) & (y >= NOTE_ZONE * page_height) & small & strip(text).rlike(NOTE_MARKER)


def note_label(c: Column) -> Column:
    """The number or sign that a note begins with."""
    own = strip(c)
    number = F.nullif(F.regexp_extract(own, r"^(\p{Nd}{1,2})(?:\.|\s)", 1), F.lit(""))
    return F.when(own.rlike(NOTE_MARKER), F.coalesce(number, F.nullif(F.regexp_extract(own, "^([*†‡§¶])", 1), F.lit(""))))


def figure_label(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(c, FIGURE_LABEL, 1), r"\.+$", ""), F.lit(""))


def spans(c: Column, pattern: str) -> Column:
    """array<struct<start, stop, match>> of the matches of a pattern with one group around what counts, in code points from 0."""
    marked = F.regexp_replace(F.translate(c, "\x01\x02", "  "), pattern, "\x01$1\x02")
    pieces = F.split(marked, "\x01")
    # Each piece but the first begins with a match and its end mark; marks of earlier pieces do not count.
    found = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.substring_index(p, "\x02", 1))
    start = lambda i: F.length(F.array_join(F.slice(pieces, 1, i + 1), "")) - i
    return F.transform(found, lambda m, i: F.struct(start(i).cast("long").alias("start"), (start(i) + F.length(m)).cast("long").alias("stop"), m.alias("match")))


def free_spans(c: Column, pattern: str) -> Column:
    """The spans that do not follow a letter or digit without space."""
    return F.filter(spans(c, f"({pattern})"), lambda s: ~F.substring(c, s["start"].cast("int"), F.lit(1)).rlike(r"[\p{L}\p{N}]") | (s["start"] == 0))


def numbers(group: Column) -> Column:
    """The numbers of a citation in brackets, each once, in order: ranges up to 100 wide are filled, others stand for their ends."""
    inner = F.regexp_replace(group, r"[\[\]\s]", "")

    def values(token):
        ends = F.split(token, r"[\x{2013}-]")
        low, high = F.try_element_at(ends, F.lit(1)).cast("int"), F.try_element_at(ends, F.lit(2)).cast("int")
        filled = F.transform(F.sequence(low, high), lambda x: x.cast("string"))
        return F.when(F.size(ends) == 1, ends).when((F.size(ends) == 2) & (low <= high) & (high - low <= 99), filled).when(F.size(ends) == 2, ends).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(F.split(inner, "[,;]"), values)))


def author_year_key(match: Column) -> Column:
    return F.concat_ws(":", F.lower(F.regexp_extract(match, AUTHOR_YEAR, 1)), F.regexp_extract(match, AUTHOR_YEAR, 2))


def entry_key(c: Column) -> Column:
    """surname:year of a bibliography entry, its label left out."""
    body = F.regexp_replace(c, ENTRY_LABEL, "")
    surname, year = F.regexp_extract(body, r"([A-Z][A-Za-z'\-]+)", 1), F.regexp_extract(body, r"\b((?:19|20)\p{Nd}{2}[a-z]?)\b", 1)
    return F.when((surname != "") & (year != ""), F.concat_ws(":", F.lower(surname), year))


def reference_score(text: Column, start: Column, label: Column) -> Column:
    """How likely a number or sign in a text refers to a note: by what stands before it."""
    prefix = F.substring(text, F.lit(1), start.cast("int"))
    bare = F.regexp_replace(prefix, f"{SPACE}+$", "")
    return (
        F.when(label.rlike(r"^\p{Nd}+$") & bare.rlike(STRUCTURAL), 0.0)
        .when(prefix.rlike(r"\p{L}$"), 0.95)
        .when(prefix.rlike(f"{SPACE}$") & bare.rlike(r"\p{L}$"), 0.7)
        .when(prefix.rlike(r"[.,;:!?]$"), 0.4)
        .otherwise(0.35)
    )


#: The suffix of each media type, and the first bytes that tell a type.
SUFFIXES = {"image/png": ".png", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/webp": ".webp", "application/pdf": ".pdf"}
MAGIC = {"FFD8FF": "image/jpeg", "89504E470D0A1A0A": "image/png"}


def suffix(media_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(media_type)), F.lit(".bin"))


def media_type(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 16))
    known = F.lit(None).cast("string")
    for magic, kind in MAGIC.items():
        known = F.when(F.startswith(head, F.lit(magic)), kind).otherwise(known)
    webp = F.startswith(head, F.lit("52494646")) & head.rlike("^(..)*57454250")
    return F.coalesce(known, F.when(webp, "image/webp"), F.lit("application/octet-stream"))
