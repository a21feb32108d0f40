"""Order MinHash of texts: fingerprints whose likeness follows edit distance.

A text's k-mers are runs of ``KMER`` words, numbered by occurrence. Hashes deal them into
``BINS`` bins (one permutation in place of one per entry); the two least of a bin, in the
order they have in the text, are hashed to the bin's entry. Moving a block of text changes the
order and with it entries that a plain MinHash would keep.

Only DataFrame functions are used, on arrays within a row; arrays are combined with shifted
copies of themselves, so time follows the length of a text times its logarithm (two sorts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.llm.order import positions
from fairtender.llm.staging import keep

KMER = 3
BIN_BITS = 6
#: bits of a code that hold the place of a k-mer; from 2**24 words on places repeat
PLACE_BITS = 24
_PLACE = (1 << PLACE_BITS) - 1
SPACE = " \t\n\x0b\f\r"


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _bin(code: Column) -> Column:
    return F.shiftrightunsigned(code, 64 - BIN_BITS)


def fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, an array of one number per filled bin (the bin, then 32 bits of its entry).

    A text of fewer than ``KMER`` words has one k-mer, all its words; one without words has no
    entries. Equal texts have equal fingerprints.
    """
    t = {n: f"_{out}_{n}" for n in ("hash", "code", "run", "occ", "least")}
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    rows = rows.withColumn(t["hash"], F.when(trimmed != "", F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))

    h = F.col(t["hash"])
    n = F.size(h)
    joined = h
    for j in range(1, KMER):
        joined = F.zip_with(joined, F.slice(h, F.lit(j + 1), n), lambda a, b: F.xxhash64(a, b))
    grams = F.when(n >= KMER, F.slice(joined, F.lit(1), n - (KMER - 1))).when(n > 0, F.array(F.xxhash64(h))).otherwise(h)
    place = lambda v, i: v.bitwiseAND(_long(~_PLACE)).bitwiseOR(i.cast("long").bitwiseAND(_long(_PLACE)))
    rows = rows.withColumn(t["code"], F.sort_array(F.transform(grams, place)))

    # equal k-mers stand together, by place: where their runs begin, and from that their numbers
    code = F.col(t["code"])
    gram = lambda c: F.shiftright(c, PLACE_BITS)
    before = F.concat(F.array(F.lit(None).cast("long")), code)
    begins = F.zip_with(code, before, lambda a, b: a.isNotNull() & ~gram(a).eqNullSafe(gram(b)))
    rows = rows.withColumn(t["run"], F.filter(F.transform(begins, lambda b, i: F.when(b, i)), lambda i: i.isNotNull()))
    run = F.col(t["run"])
    lengths = F.zip_with(run, F.concat(F.slice(run, F.lit(2), F.size(run)), F.array(F.size(code))), lambda a, b: b - a)
    rows = rows.withColumn(t["occ"], F.flatten(F.transform(F.filter(lengths, lambda x: x > 0), lambda x: F.sequence(F.lit(0), x - 1))))

    numbered = F.zip_with(code, F.col(t["occ"]), lambda c, o: F.xxhash64(gram(c), o).bitwiseAND(_long(~_PLACE)).bitwiseOR(c.bitwiseAND(_long(_PLACE))))
    rows = rows.withColumn(t["least"], F.sort_array(numbered))
    least = F.col(t["least"])
    two_before = F.concat(F.array_repeat(F.lit(None).cast("long"), 2), least)
    chosen = F.filter(F.zip_with(least, two_before, lambda a, b: F.when(b.isNull() | (_bin(a) != _bin(b)), a)), lambda a: a.isNotNull())
    rows = rows.withColumn(t["least"], chosen)

    # of each bin one or two are left, side by side
    first = F.zip_with(least, F.concat(F.array(F.lit(None).cast("long")), least), lambda a, b: F.when(a.isNotNull() & (b.isNull() | (_bin(a) != _bin(b))), a))
    follow = F.concat(F.slice(least, F.lit(2), F.size(least)), F.array(F.lit(None).cast("long")))
    spot = lambda c: c.bitwiseAND(_long(_PLACE))
    tuple_of = lambda a, b: F.when(b.isNull() | (_bin(a) != _bin(b)), F.xxhash64(gram(a))).when(spot(a) < spot(b), F.xxhash64(gram(a), gram(b))).otherwise(F.xxhash64(gram(b), gram(a)))
    entry = lambda a, b: F.when(a.isNotNull(), F.shiftleft(_bin(a), 32).bitwiseOR(tuple_of(a, b).bitwiseAND(_long(0xFFFFFFFF))))
    return rows.withColumn(out, F.filter(F.zip_with(first, follow, entry), lambda e: e.isNotNull())).drop(*t.values())


def text_of(entries: Column) -> Column:
    """A fingerprint as text: ten hexadecimal digits an entry."""
    return F.array_join(F.transform(entries, lambda e: F.lpad(F.lower(F.hex(e)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among the bins filled in either; 1 when both have none."""
    bins = lambda x: F.transform(x, lambda e: F.shiftright(e, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents and of their edited texts, and likenesses.

    In the edited text the last third of the code points (rounded down) is replaced by the
    first as many, or all, of the next document by descending id; after the last comes the
    first. A missing text counts as empty, and a missing id comes last. Of documents that share
    an id the hash of id and text gives the order; rows equal in both count once in the
    order and get equal results. A document alone is its own next one. Other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"))
    slim = rows.select("doc_id", "key", F.length("text").cast("long").alias("n_chars"))
    placed = keep(positions(slim.distinct(), [F.col("doc_id").desc_nulls_last(), F.col("key")]), "places")
    total = placed.count()
    # the place whose next is this one
    following = placed.select(F.col("key").alias("next_key"), F.pmod(F.col("pos") - 1, F.lit(max(total, 1))).alias("pos"))
    pairs = keep(placed.join(following, "pos").select("key", "next_key", "doc_id", "n_chars"), "pairs")
    # both joins below take the same two columns, so that the texts are shuffled once
    texts = rows.select("key", "text")
    wanted = pairs.select(F.col("key").alias("of"), F.col("next_key").alias("key"), F.floor(F.col("n_chars") / 3).cast("int").alias("third"))
    heads = texts.join(wanted, "key").select(F.col("of").alias("key"), F.left("text", F.col("third")).alias("head"))
    heads = heads.groupBy("key").agg(F.min("head").alias("head"))
    joined = texts.join(heads, "key").join(pairs, "key")
    kept = F.left("text", (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int"))
    edited = joined.select("doc_id", "key", "next_key", "n_chars", "text", F.concat(kept, "head").alias("edited"))
    printed = fingerprint(fingerprint(edited, "text", "print"), "edited", "edited_print")
    printed = keep(printed.select("doc_id", "key", "next_key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "print", "edited_print"), "prints")
    own = printed.select(F.col("key").alias("next_key"), F.col("print").alias("next_print")).dropDuplicates(["next_key"])
    return printed.join(own, "next_key").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of(F.col("print")).alias("fingerprint"),
        text_of(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
