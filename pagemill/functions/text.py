"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules of the document model that results depend on.
CAPTION_FIGURE = r"(?i)^(Figure|Fig\.)\s*[0-9]+"
CAPTION_TABLE = r"(?i)^Table\s*[0-9]+"
ENTRY_LABEL = r"^\s*\[([0-9]{1,3})\]\s"
CLOSERS = r"""["'\)\]\}\x{201D}\x{2019}\s]+$"""
#: The ten characters that LaTeX reserves, and how each is written.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def cleanup(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("\x02"), F.lit(" ")), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores of any script, in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "), " "), lambda t: t != "")


def ascii_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 in lower case; other characters part them."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def caption_kind(c: Column) -> Column:
    return F.when(c.rlike(CAPTION_FIGURE), "FIGURE").when(c.rlike(CAPTION_TABLE), "TABLE")


def entry_label(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, ENTRY_LABEL, 1), F.lit(""))


def slug(c: Column) -> Column:
    stem = F.regexp_replace(c, r"\.[^./]*$", "")
    kept = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "-"), r"^[._-]+|[._-]+$", "")
    return F.when(kept == "", "upload").otherwise(kept)


def hyphen_join(a: Column, b: Column) -> Column:
    """Glues a word broken at the end of a; else one space between."""
    broken = a.rlike("-{1,2}$") & b.rlike(r"^\p{Ll}")
    return F.when(a == "", b).when(b == "", a).when(broken, F.concat(F.regexp_replace(a, "-{1,2}$", ""), b)).otherwise(F.concat_ws(" ", a, b))


def latex_escape(c: Column) -> Column:
    """Reserved characters by their commands, line ends and tabs by spaces; other control characters go."""
    plain = F.regexp_replace(F.translate(c, "\r\n\t", "   "), r"[\x00-\x1F\x7F-\x9F]", "")
    # The backslash stands aside as a control character, so that what others become is not escaped again.
    plain = F.replace(plain, F.lit("\\"), F.lit("\x01"))
    for char in "{}":
        plain = F.replace(plain, F.lit(char), F.lit(LATEX[char]))
    plain = F.replace(plain, F.lit("\x01"), F.lit(LATEX["\\"]))
    for char in "&%$#_~^":
        plain = F.replace(plain, F.lit(char), F.lit(LATEX[char]))
    return plain


def stable_id(*parts: Column) -> Column:
    """SHA-256 of parts joined by 0x1F; its first 32 hex digits in groups of 8-4-4-4-12."""
    digest = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
