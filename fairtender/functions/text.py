"""Cleaning, normalising and taking apart contract texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
SPACE_CLASS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
KEPT_CHARACTERS = r"[^a-zA-ZÀ-ÿ0-9 ,./:]"
OCR_BELOW_LETTERS = 1000
PROMPT_END = "---->"
COMPLETION_END = " \n\n###\n\n"


def clean_text(text: Column) -> Column:
    """Drop currency marks, line breaks, repeated stops and every character outside the kept set.

    Marks, breaks and semicolons become spaces; runs of spaces, stops or commas become one.
    """
    spaced = F.translate(text, "$\n;", "   ")
    single = F.regexp_replace(spaced, r"([ .,])\1+", "$1")
    return F.regexp_replace(single, KEPT_CHARACTERS, "")


def normalise_text(text: Column) -> Column:
    """Lower case, single spaces, single stops and commas."""
    spaced = F.trim(F.regexp_replace(F.lower(text), SPACE_CLASS + "+", " "))
    return F.trim(F.regexp_replace(spaced, r"([.,])\1+", "$1"))


def letter_count(text: Column) -> Column:
    """Number of ASCII letters."""
    return F.length(F.regexp_replace(text, "[^a-zA-Z]", ""))


def route_extraction(text: Column, threshold: int = OCR_BELOW_LETTERS) -> Column:
    """Which reader a document needs: too few letters in the text layer means a scan."""
    return F.when(letter_count(text) < threshold, "OCR").otherwise("PDF_Reader")


def name_part(name: Column, at: int) -> Column:
    """Part ``at`` (from 0) of an underscore-separated file name, missing if absent."""
    return F.get(F.split(name, "_"), F.lit(at))


def name_tail(name: Column) -> Column:
    """The last two parts of an underscore-separated file name."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) < 2, name).otherwise(F.array_join(F.slice(parts, -2, 2), "_"))


def contract_code(path: Column) -> Column:
    """``…/pdf_<code>.pdf`` to ``<code>``."""
    base = F.regexp_replace(path, r"^.*[/\\]", "")
    return F.regexp_replace(F.regexp_replace(base, "^pdf_", ""), r"\.pdf$", "")


def strip_leading_spaces(df: DataFrame) -> DataFrame:
    """On every string column."""
    strings = {c for c, t in df.dtypes if t == "string"}
    return df.select(*[F.regexp_replace(c, "^ +", "").alias(c) if c in strings else F.col(c) for c in df.columns])


def blank_to(text: Column, default: str = "No Match") -> Column:
    return F.when(text == "", default).otherwise(text)


def title_case(text: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere; a letter of two capitals keeps the first."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))

    def capital(run: Column) -> Column:
        first = F.upper(F.substring(run, 1, 1))
        return F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, 9)), F.lower(F.substring(run, 2, 2147483647)))

    return F.array_join(F.transform(runs, capital), "")


def completion_text(*parts: Column) -> Column:
    """An answer built from parts, one blank line between them, with its end mark.

    The first two parts share a line.
    """
    head = F.concat(F.lit(" "), parts[0], F.lit("; "), parts[1], F.lit("\n\n"))
    rest = [F.concat(p, F.lit("\n\n")) for p in parts[2:]]
    return F.regexp_replace(F.concat(head, *rest, F.lit("\n\n###\n\n")), "(\n\n)+", "\n\n")


def prompt_text(text: Column) -> Column:
    return F.concat(text, F.lit(PROMPT_END))


def quote_mark(text: Column) -> Column:
    return F.concat(F.lit("'"), text)


def join_nonnull(*values: Column) -> Column:
    """The non-missing values, separated by ``; ``; numbers are written without exponent."""
    return F.concat_ws("; ", *[plain_number(v) for v in values])


def plain_number(value: Column) -> Column:
    """A value as text, a number with an exponent written out (at least one decimal, 18 at most)."""
    text = value.cast("string")
    full = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    return F.when(text.rlike(r"^-?[0-9.]+E-?[0-9]+$"), F.coalesce(full, text)).otherwise(text)


def decode_entities(text: Column) -> Column:
    """Character references by number, and those by name that occur in addresses."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(0)))

    def character(ref: Column) -> Column:
        digits = F.regexp_replace(ref, "[&#;]", "")
        code = F.when(F.lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).cast("long")
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    out = F.aggregate(numbers, text, lambda t, ref: F.replace(t, ref, character(ref)))
    # the sign itself comes last
    for name, sign in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("nbsp", "\u00a0"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return out


#: stands behind the first sign of what is never closed (a character of private use)
OPEN_MARK = "\ue000"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
#: outside quotes, the first ``href`` after a space; each step takes a run of signs, none is tried twice
ANCHOR = rf"""(?i)<a(?=\s)(?:[^>"'\s]++|\s(?!href\s*+=\s*+{_VALUE})|"[^"]*+"|'[^']*+')*+\shref\s*+=\s*+({_VALUE})"""
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*+>"


def _mark_unclosed(html: Column, opening: str, closing: str) -> Column:
    """Mark each opening after the last closing, so that nobody looks for its end."""
    head = F.regexp_extract(html, rf"(?is)^.*{closing}", 0)
    tail = F.substr(html, F.length(head) + 1)
    marked = F.concat(head, F.regexp_replace(tail, rf"(?i)<({opening})", f"<{OPEN_MARK}$1"))
    return F.when(html.rlike(rf"(?i)<{opening}"), marked).otherwise(html)


def href_links(html: Column) -> Column:
    """Targets of the anchors of a page, quoted or not; closed comments, scripts and styles hold none.

    The time is in proportion to the page's length, whatever is long or unclosed in it.
    """
    for opening, closing in (("!--", "-->"), (r"script\b", r"</script\s*+>"), (r"style\b", r"</style\s*+>")):
        html = _mark_unclosed(html, opening, closing)
    shown = F.regexp_replace(html, HIDDEN, " ")
    found = F.regexp_extract_all(shown, F.lit(ANCHOR), F.lit(1))
    plain = lambda h: F.replace(F.regexp_replace(h, "^[\"']|[\"']$", ""), F.lit("<" + OPEN_MARK), F.lit("<"))
    return F.transform(found, lambda h: F.trim(decode_entities(plain(h))))


def link_file_name(href: Column) -> Column:
    """Name under which a linked sheet is kept: the last part of its path."""
    return F.concat(F.element_at(F.split(href, "/"), -1), F.lit(".xlsx"))
