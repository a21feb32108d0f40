"""Personal data in texts: patterns propose spans, checksums confirm them, context words score them.

Everything is column expressions within a row: no shuffle, no Python. Patterns are anchored
at the start of a run of their characters and quantified possessively, so a long run costs
time in proportion to its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
#: code points of context on either side, and of the blocks in which a text is looked up
REACH, BLOCK = 40, 1024


@dataclass(frozen=True)
class Kind:
    """A kind of data. ``pattern`` finds the leftmost longest runs; ``base`` spans are kept
    whatever their score, others from ``min_score`` on. Scores are in hundredths."""

    name: str
    pattern: str
    needs: str
    base: bool
    score: int
    words: tuple[str, ...]


KINDS = (
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 85, ("mail", "email", "contact", "write")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, 60, ("ip", "host", "address", "server")),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", "", True, 80, ("card", "credit", "visa", "pay")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 70, ("phone", "call", "tel", "mobile")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "", False, 80, ("iban", "account", "bank", "konto")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, 40, ("ssn", "social", "security", "insurance")),
)
MIN_SCORE = 50
CONTEXT = 15


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's checksum."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number of letters and digits leaves 1 by ISO 7064 mod 97-10."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & F.coalesce(p.try_cast("int") <= 255, F.lit(True)))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        code = F.replace(hit, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    return ~F.substring(hit, 1, 3).isin("000", "666") & ~F.startswith(hit, F.lit("9")) & (F.substring(hit, 5, 2) != "00") & (F.substring(hit, 8, 4) != "0000")


def _scan(lengths: Column, first: Column) -> Column:
    """Sums of the elements before each element, starting from ``first``."""
    zero = F.struct(F.array().cast("array<bigint>").alias("out"), first.cast("bigint").alias("at"))
    return F.aggregate(lengths, zero, lambda s, x: F.struct(F.concat(s.out, F.array(s.at)).alias("out"), (s.at + x).alias("at")), lambda s: s.out)


def sums_before(lengths: Column, block: int = 256) -> Column:
    """Sums before each element; long arrays go by blocks, as appending copies what is there."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, F.lit(block)))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v))
    by_block = F.flatten(F.zip_with(blocks, _scan(totals, F.lit(0)), _scan))
    return F.when(F.size(lengths) <= block, _scan(lengths, F.lit(0))).otherwise(by_block)


def find(docs: DataFrame, text_col: str = "text", min_score: int = MIN_SCORE) -> DataFrame:
    """Add ``found``: per span its kind, start, end (code points, exclusive), score and text.

    Spans come by kind and start. A missing or empty text has none. Other columns stay; the
    names ``found`` and those that begin with ``_pii`` are taken. Every row is judged by
    itself, so repeated rows get the same spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = [F.col(f"`{c}`") for c in docs.columns if c != "found"]
    pieces = []
    for k in KINDS:
        none, seen = F.array().cast("array<string>"), F.contains(text, F.lit(k.needs)) if k.needs else F.lit(True)
        pieces.append(F.when(seen, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"_pii_hit_{k.name}"))
    hits = docs.select(*cols, *pieces)
    some = lambda k: F.size(f"_pii_hit_{k.name}") > 0
    gaps = hits.select("*", *[F.when(some(k), F.split(text, k.pattern, -1)).alias(f"_pii_gap_{k.name}") for k in KINDS])
    found = some(KINDS[0])
    for k in KINDS[1:]:
        found = found | some(k)
    blocks = F.when(found, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}+"), F.lit(0))).alias("_pii_blocks")
    joined = gaps.select("*", blocks, *[_lengths(k) for k in KINDS])
    spans = joined.select(*cols, *[F.when(some(k), _spans(k, min_score)).alias(f"_pii_span_{k.name}") for k in KINDS])
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:int,text:string>>")
    return spans.select(*cols, F.concat(*[F.coalesce(F.col(f"_pii_span_{k.name}"), empty) for k in KINDS]).alias("found"))


def _lengths(k: Kind) -> Column:
    gap, hit = F.col(f"_pii_gap_{k.name}"), F.col(f"_pii_hit_{k.name}")
    both = F.zip_with(gap, hit, lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("bigint"))
    return F.when(F.size(hit) > 0, both).alias(f"_pii_len_{k.name}")


def _part(start: Column, size: Column) -> Column:
    """Some code points of the text, at most as many as a block has, in time that does not depend on where they stand."""
    block = F.floor(start / BLOCK).cast("int")
    both = F.concat(F.get("_pii_blocks", block), F.coalesce(F.get("_pii_blocks", block + 1), F.lit("")))
    return F.coalesce(F.substring(both, (start - block * BLOCK + 1).cast("int"), size.cast("int")), F.lit(""))


def _spans(k: Kind, min_score: int) -> Column:
    gap, hit, length = (F.col(f"_pii_{x}_{k.name}") for x in ("gap", "hit", "len"))
    known = f"(^|[^a-z])({'|'.join(k.words)})([^a-z]|$)"
    near = lambda t: F.lower(t).rlike(known)
    placed = F.zip_with(hit, sums_before(length), lambda h, at: F.struct(h.alias("h"), at.alias("at")))
    led = F.zip_with(placed, gap, lambda p, g: F.struct(p.h.alias("h"), (p.at + F.length(g)).alias("start")))
    real = F.filter(led, lambda p: p.h.isNotNull() & _confirmed(k.name, p.h))
    start = lambda p: F.greatest(p.start - REACH, F.lit(0))
    before = lambda p: _part(start(p), p.start - start(p))
    after = lambda p: _part(p.start + F.length(p.h), F.lit(REACH))
    scored = F.transform(
        real,
        lambda p: F.struct(
            F.lit(k.name).alias("kind"),
            p.start.alias("start"),
            (p.start + F.length(p.h)).alias("end"),
            (F.lit(k.score) + F.when(near(before(p)) | near(after(p)), CONTEXT).otherwise(0)).cast("int").alias("score"),
            p.h.alias("text"),
        ),
    )
    return scored if k.base else F.filter(scored, lambda s: s.score >= min_score)


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: counts of the base kinds, a digest of their spans, all spans, and scores."""
    base = [k.name for k in KINDS if k.base]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    spans = F.col("found")
    of = lambda *kinds: F.filter(spans, lambda s: s.kind.isin(*kinds))
    return found.select(
        F.col(id_col).alias("doc_id"),
        *[F.size(of(b)).cast("long").alias(f"n_{b}") for b in base],
        F.sha2(text(of(*base)), 256).alias("base_sha256"),
        text(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s.score.cast("string")), ",").alias("scores"),
    )
