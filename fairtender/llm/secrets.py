"""Secrets in texts, told from examples by how many owners hold the same one.

Patterns propose spans in each text. The hashes of the secrets in them are counted over the
whole corpus by distinct repositories and owners. A secret that many of them share is an
example that was copied; one that few hold and that looks random is taken to be live.

All of it is DataFrame work: spans are column expressions in the row, without shuffle of a
text; hashes are counted in three steps combined on the map side, so a secret that is
everywhere sends a row per task and owner at most; only spans, not texts, meet the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.llm.pii import sums_before
from fairtender.llm.staging import keep


@dataclass(frozen=True)
class Kind:
    """A kind of secret. ``pattern`` finds leftmost runs, ``group`` of it is the secret, which has
    ``least`` characters or more; a text without a match of ``hint`` has none. Base spans stay
    whatever their class, others only if they are live."""

    name: str
    pattern: str
    group: int
    least: int
    hint: str
    base: bool


VALUE = "[A-Za-z0-9+/_.=-]"
WORDS = "(?i:password|passwd|secret|token|api_?key)"
KINDS = (
    Kind("assign", rf"""{WORDS}["']?+\x20*+[:=]\x20*+["']?+({VALUE}++)""", 1, 8, WORDS, True),
    Kind("access", "AKIA[A-Z0-9]++", 0, 16, "AKIA", True),
    Kind("hex", "(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32, "[0-9a-f]{32}", True),
    Kind("vendor", r"(?<![A-Za-z0-9_-])(?:gh[oprsu]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|sk_live_[A-Za-z0-9]{20,}+|glpat-[A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{35,}+)", 0, 24, "gh[oprsu]_|xox[abprs]-|sk_live_|glpat-|AIza", False),
    Kind("jwt", r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{16,}+", 0, 40, r"eyJ", False),
    Kind("random", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])(?=[0-9A-Z+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}+", 0, 32, "[A-Za-z0-9+/_-]{32}", False),
)
#: a secret with more owners or repositories than these was copied
OWNERS, REPOSITORIES = 3, 30
#: what stands in for a secret in documentation
STAND_INS = "(?i)example|sample|dummy|fake|placeholder|changeme|change_me|your|redacted|xxxx|0123456789|123456789|abcdefgh"
#: different characters that a live secret has at least
VARIETY = 8


def looks_live(value: Column) -> Column:
    """Whether a secret has letters, digits and enough different characters, and is no stand-in."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= VARIETY
    return varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(STAND_INS)


def _proposed(docs: DataFrame, text: Column, others: list[Column]) -> DataFrame:
    """``found``: spans by start and kind, with the hash of their secret."""
    hits, cols = [], []
    for k in KINDS:
        none, some = F.array().cast("array<string>"), text.rlike(k.hint)
        hits.append(F.when(some, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"_hit_{k.name}"))
    seen = docs.select(*others, text.alias("_text"), *hits)
    named = [F.col(f"`{c}`") for c in seen.columns[: len(others)]]
    for k in KINDS:
        some = F.size(f"_hit_{k.name}") > 0
        cols.append(F.when(some, F.split("_text", k.pattern, -1)).alias(f"_gap_{k.name}"))
        cols.append(F.when(some, F.regexp_extract_all("_text", F.lit(k.pattern), F.lit(k.group))).alias(f"_value_{k.name}"))
    gaps = seen.select(*named, *[f"_hit_{k.name}" for k in KINDS], *cols)
    lengths = [
        F.zip_with(f"_gap_{k.name}", f"_hit_{k.name}", lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("bigint")).alias(f"_len_{k.name}")
        for k in KINDS
    ]
    spans = gaps.select("*", *lengths).select(*named, *[_spans(no, k).alias(f"_span_{k.name}") for no, k in enumerate(KINDS)])
    empty = F.array().cast("array<struct<start:bigint,no:int,end:bigint,hash:binary,live:boolean>>")
    return spans.select(*named, F.sort_array(F.concat(*[F.coalesce(F.col(f"_span_{k.name}"), empty) for k in KINDS])).alias("found"))


def _spans(no: int, k: Kind) -> Column:
    hit, gap, value, length = (F.col(f"_{x}_{k.name}") for x in ("hit", "gap", "value", "len"))
    placed = F.zip_with(F.zip_with(gap, sums_before(length), lambda g, at: at + F.length(g)), F.arrays_zip(hit.alias("h"), value.alias("v")), lambda at, x: F.struct(at.alias("at"), x["h"].alias("h"), x["v"].alias("v")))
    real = F.filter(placed, lambda p: F.coalesce(F.length(p.v) >= k.least, F.lit(False)))
    span = lambda p: F.struct(
        p.at.alias("start"), F.lit(no).alias("no"), (p.at + F.length(p.h)).alias("end"), F.unhex(F.md5(p.v.cast("binary"))).alias("hash"), looks_live(p.v).alias("live")
    )
    return F.when(F.size(hit) > 0, F.transform(real, span))


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct owners and repositories (of an owner) per ``hash`` of rows (hash, owner, repo)."""
    once = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", "owner").agg(F.count("one").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """Per row its id and ``found``: spans by start and kind, with class, owners and repositories.

    A span has kind, start, end (code points, exclusive) and class: ``copied`` (its secret has
    more than ``owners`` owners or ``repositories`` repositories in the corpus), else ``live``
    (it looks random) or ``weak``. Spans of kinds beyond the base are left out unless live. A
    missing or empty text has no spans. Rows without owner count as those of one owner, rows
    without repository as one of their owner's; repeated rows are found alike and count once.
    Every row comes back, whatever its id; other columns do not. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    others = [F.col(f"`{id_col}`").alias("_id"), F.col(f"`{owner_col}`").cast("string").alias("owner"), F.col(f"`{repo_col}`").cast("string").alias("repo")]
    rows = keep(_proposed(docs, text, others).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    spans = rows.filter(F.size("found") > 0).select("_row", "owner", "repo", F.posexplode("found").alias("at", "s")).select("_row", "owner", "repo", "at", "s.*")
    counts = ownership(spans.select("hash", "owner", "repo"))
    kind = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("no") + 1)
    base = F.col("no").isin([no for no, k in enumerate(KINDS) if k.base])
    copied = (F.col("owners") > owners) | (F.col("repos") > repositories)
    told = spans.select("_row", "at", "no", "start", "end", "live", "hash").join(counts, "hash").withColumn("class", F.when(copied, "copied").when(F.col("live"), "live").otherwise("weak"))
    told = told.filter(base | (F.col("class") == "live"))
    span = F.struct("at", kind.alias("kind"), "start", "end", "class", "owners", F.col("repos").alias("repositories"))
    # the spans of one text, as many as it has room for
    by_row = told.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    shown = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["class"].alias("class"), s["owners"].alias("owners"), s["repositories"].alias("repositories")))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,class:string,owners:bigint,repositories:bigint>>")
    return rows.select("_row", "_id").join(by_row, "_row", "left").select(F.col("_id").alias(id_col), F.coalesce(shown, empty).alias("found"))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: counts of the base kinds, a digest of their spans, all spans, and their classes."""
    base = [k.name for k in KINDS if k.base]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    classed = lambda c: F.size(F.filter("found", lambda s: s["class"] == c)).cast("bigint")
    return found.select(
        F.col(f"`{id_col}`"),
        *[F.size(of(b)).cast("bigint").alias(f"n_{b}") for b in base],
        F.sha2(text(of(*base)), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: s["class"]), ",").alias("classes"),
        classed("live").alias("n_live"),
        classed("copied").alias("n_copied"),
    )
