"""Exact Jaccard join of texts as sets of word n-grams, in the metric space of Jaccard distances.

Nearly all pairs of documents are at distance 1, where pivots tell nothing apart. So documents
first meet by shared n-grams, in a way that loses no pair, and pivots are chosen among
those that meet:

1. In hash order, a document's first n-grams (``n - ceil(s n) + 1`` and ``EXTRA`` more of each
   n) must hold as many of a partner's n-grams, plus one, as were added. The most frequent of
   them can be left out again, one less than the added ones: a pair still shares one of the rest.
2. Of the documents that share an n-gram one is its head: the most central, whose n-grams are
   shared most. Each document is measured against the most central head it can link to; near
   ones are links, and linked documents are one group. In the next rounds only heads of other
   groups count.
3. N-grams whose documents are in several groups are still open. The group of an n-gram's head
   is its region, with the group's most central head as pivot. Documents of several regions, on
   their boundaries, are replicated into each. Distances to the pivot are exact.
4. What is not linked yet is joined within the region (see ``regions``): near the pivot by the
   differences from it, far from it by the sets themselves, with triangle-inequality windows
   for the documents between.

``links`` does not look for links between documents that are connected already, as components
need none. ``join_pairs`` gives all linked pairs: each n-gram's documents are the region of its
head, without rounds and labels, and blocks of it are compared whole; ``count_links`` counts
them per document. Sets are named by 64 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.llm.components import merged
from fairtender.llm.regions import NEAR, far_reach, is_near, meeting_pairs, near_reach, placed_members
from fairtender.llm.staging import keep, release
from fairtender.llm.substring import _buckets, _by_bucket, _joined, _Outbox, _sent
from fairtender.llm.words import PORTION, lean, scan, text_portions

SHINGLE, LEAST, OUT_OF = 3, 90, 100
EXTRA = 0.15
BLOCK = 512
#: rounds of links to heads; more of them leave less to the cells and change no result
ROUNDS = 3
#: pairs that are measured against one pivot in one task; a pivot of more pairs is copied
SALT = 1000
_LAST = (1 << 63) - 1


def _sets(texts: list, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word k-grams of each text; fewer words make one."""
    words = scan(texts, lower=True)
    grams, _ = words.windows(k)
    out = []
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        n = hi - lo
        if n >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        elif n:
            part = type(words)(words.raw, words.start, words.end, words.hash[lo:hi], np.array([0, n]))
            # of another kind than k-grams, as a short text equals no part of a long one
            out.append(part.windows(int(n))[0] ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _name(grams: np.ndarray) -> int:
    """A set's 64-bit name."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _overlap(n: int, least: int, out_of: int) -> int:
    return -(-least * n // out_of)


_DOCUMENTS = pa.schema([(c, pa.int64()) for c in ("doc_id", "id", "text_key", "n", "name")] + [("firsts", pa.list_(pa.int64()))])
_SETS = pa.schema([("name", pa.int64()), ("grams", pa.binary()), ("sketch", pa.binary())])


def documents(docs: DataFrame, k: int, least: int, out_of: int) -> DataFrame:
    """Per row: doc_id, id (missing: greatest), key of the text, n (set size), name of the set, first n-grams."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_portions(batches, "text", PORTION):
            sets = _sets(b.column("text").to_pylist(), k)
            firsts = []
            for s in sets:
                n = len(s)
                # a set this small has no partner but its equals
                alone = least * (n + 1) > out_of * n
                firsts.append(s[: 0 if alone else n - _overlap(n, least, out_of) + 1 + int(EXTRA * n)].view(np.int64))
            bounds = np.cumsum([0, *map(len, firsts)])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(firsts), pa.int64()))
            own = [b.column(c) for c in ("doc_id", "id", "text_key")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) for s in sets], pa.int64()), lists], schema=_DOCUMENTS)

    source = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("text_key"), "text")
    return source.mapInArrow(lean(rows), "doc_id long, id long, text_key long, n long, name long, firsts array<long>")


_DEALT = pa.schema([("bucket", pa.int32()), ("gram", pa.binary()), ("name", pa.binary())])
_SHARED = pa.schema([("name", pa.int64()), ("gram", pa.int64()), ("c", pa.int64())])


def _pairs_once(grams: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of n-gram and set, by n-gram."""
    order = np.lexsort((names, grams))
    grams, names = grams[order], names[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (names[1:] != names[:-1])
    return grams[fresh], names[fresh]


def shared_grams(rows: DataFrame, buckets: int) -> DataFrame:
    """First n-grams that several sets have: name, gram, c (how many).

    Sent in packed rows to the n-grams' buckets; of equal sets a task sends one.
    """

    def send(grams: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        grams, names = _pairs_once(grams, names)
        yield _sent(_DEALT, (grams % np.uint64(buckets)).astype(np.int64), [grams, names])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(send)
        for batch in batches:
            lists = batch.column("firsts")
            sizes = np.diff(lists.offsets.to_numpy())
            grams = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield from box.add(grams, np.repeat(batch.column("name").to_numpy(), sizes))
        yield from box.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            grams, names = _pairs_once(_joined(held, "gram", np.uint64), _joined(held, "name", np.int64))
            starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
            sizes = np.diff(starts, append=len(grams))
            count = np.repeat(sizes, sizes)
            some = count > 1
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(grams[some].view(np.int64)), pa.array(count[some])], schema=_SHARED)

    dealt = rows.select("name", "firsts").mapInArrow(lean(deal), "bucket int, gram binary, name binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), "name long, gram long, c long")


def rare_grams(rows: DataFrame, least: int, out_of: int) -> DataFrame:
    """The n-grams by which a pair must meet: name, n, central, gram. ``rows`` has name, n and first n-grams of sets."""
    buckets = _buckets(rows, F.col("n") * ((out_of - least) / out_of + EXTRA))
    held = shared_grams(rows, buckets).groupBy("name").agg(F.sum(F.log("c")).alias("logs"), F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("grams"))
    sizes = rows.select("name", "n", F.size("firsts").alias("k")).groupBy("name").agg(F.first("n").alias("n"), F.first("k").alias("k"))
    named = held.join(sizes, "name")
    # of the smallest possible partner, rounded down
    need = 1 + F.floor(F.lit(EXTRA) * F.ceil(F.col("n") * least / out_of) - 1e-9)
    rare = named.select("name", "n", (F.col("logs") / F.col("k")).alias("central"), F.slice("grams", F.lit(1), F.greatest(F.lit(0), F.size("grams") - need + 1).cast("int")).alias("grams"))
    return rare.select("name", "n", "central", F.explode("grams.gram").alias("gram"))


def head_pairs(kept: DataFrame, labels: DataFrame, tested: DataFrame | None, least: int, out_of: int) -> DataFrame:
    """Each node with the most central head of another group that it may link to and has not met: pivot, name, n."""
    labelled = kept.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))
    heads = labelled.groupBy("gram").agg(F.max(F.struct("central", "name", "n", "label")).alias("head"), F.min("label").alias("low"), F.max("label").alias("high"))
    heads = heads.filter("low <> high").select("gram", "head")
    fits = (F.col("head.label") != F.col("label")) & (F.least("n", "head.n") * out_of >= F.greatest("n", "head.n") * least)
    met = labelled.join(heads, "gram").filter(fits).select("name", "n", "head.central", F.col("head.name").alias("pivot"))
    if tested is not None:
        met = met.join(tested.select("name", "pivot"), ["name", "pivot"], "left_anti")
    best = met.groupBy("name").agg(F.first("n").alias("n"), F.max(F.struct("central", "pivot")).alias("best"))
    return best.select("best.pivot", "name", "n")


def cells(kept: DataFrame, labels: DataFrame) -> DataFrame:
    """Pivots and the members of their cells: pivot, name, n."""
    labelled = kept.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))
    heads = labelled.groupBy("gram").agg(F.max(F.struct("central", "name", "label")).alias("head"), F.min("label").alias("low"), F.max("label").alias("high"))
    heads = keep(heads.filter("low <> high").select("gram", F.col("head.label").alias("cell"), "head.central", F.col("head.name").alias("pivot")), "heads")
    pivots = heads.groupBy("cell").agg(F.max(F.struct("central", "pivot")).alias("best")).select("cell", "best.pivot")
    members = kept.join(heads.select("gram", "cell"), "gram").select("cell", "name", "n").distinct()
    return members.join(pivots, "cell").select("pivot", "name", "n")


def _distance(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum()) if len(large) else 0
    return both, len(a) + len(b) - both


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the sets of both sides; the set of a pivot of many pairs is copied to many tasks."""
    sizes = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("c"))
    # at most pairs / SALT pivots
    hot = keep(sizes.filter(F.col("c") > SALT).select("pivot", F.ceil(F.col("c") / SALT).cast("int").alias("salts")), "hot")
    salted = pairs.join(F.broadcast(hot), "pivot", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("name"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    own = sets.select("name", "grams")
    centre = sets.select(F.col("name").alias("pivot"), F.col("grams").alias("pivot_grams")).join(F.broadcast(hot), "pivot", "left")
    spread = centre.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return salted.join(spread, ["pivot", "salt"]).drop("salt").join(own, "name")


def _to_pivots(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add the intersection and the union with the pivot."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            # in the order in which they were sorted
            found = [_distance(_grams(a), _grams(b)) for a, b in zip(pdf["grams"], pdf["pivot_grams"], strict=True)]
            yield pd.DataFrame({"pivot": pdf["pivot"], "name": pdf["name"], "n": pdf["n"], "both": [f[0] for f in found], "either": [f[1] for f in found]})

    return _beside(pairs, sets).mapInPandas(lean(measure), "pivot long, name long, n long, both long, either long")


def _differences(pairs: DataFrame, sets: DataFrame, least: int, out_of: int) -> DataFrame:
    """Per pair: pivot, name, n, pivot_n, apart (size of the difference) and, where it is needed near the pivot, the packed difference."""
    far = lambda apart, n, pivot_n: apart > NEAR * (n * out_of / least + pivot_n) + 2 * n * (out_of - least) / least + 1

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = [np.setxor1d(_grams(a), _grams(b), assume_unique=True) for a, b in zip(pdf["grams"], pdf["pivot_grams"], strict=True)]
            sizes = [len(b) // 8 for b in pdf["pivot_grams"]]
            packed = [b"" if far(len(d), n, p) else d.tobytes() for d, n, p in zip(own, pdf["n"], sizes, strict=True)]
            yield pd.DataFrame({"pivot": pdf["pivot"], "name": pdf["name"], "n": pdf["n"], "pivot_n": sizes, "apart": [len(d) for d in own], "difference": packed})

    return _beside(pairs, sets).mapInPandas(lean(measure), "pivot long, name long, n long, pivot_n long, apart long, difference binary")


def _grams(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def _sketch(grams: np.ndarray) -> bytes:
    """How many n-grams fall into each of as many buckets as the set is large, to a power of two.

    The sum of differences between two sketches is never more than the number of n-grams that
    only one of the sets has, and mostly near it, at an eighth of the bytes or less.
    """
    buckets = 1 << (max(len(grams), 16).bit_length() - 1)
    return np.minimum(np.bincount((grams & (buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def _folded(sketch: bytes, buckets: int) -> np.ndarray:
    counts = np.frombuffer(sketch, np.uint8).astype(np.int32)
    return counts.reshape(-1, buckets).sum(0) if len(counts) > buckets else counts


def _split(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _within(members: DataFrame, sketches: DataFrame, nearest: bool, least: int, out_of: int) -> DataFrame:
    """Pairs of differently labelled members of a cell that may link: pivot, name, n.

    Members that no links connect with the pivot are compared with all others in the cell
    whose distance from the pivot and whose size leave it open. ``nearest`` gives of each two
    groups in a block the nearest pair only.
    """
    reach = 1 - least / out_of + 1e-9
    pivots = members.filter("name = pivot").select("pivot", F.col("label").alias("main"))
    marked = members.join(pivots, "pivot").withColumn("apart", F.col("label") != F.col("main"))
    spans = marked.groupBy("pivot").agg(
        F.min(F.when(F.col("apart"), F.col("far"))).alias("low"), F.max(F.when(F.col("apart"), F.col("far"))).alias("high"),
        F.min(F.when(F.col("apart"), F.col("n"))).alias("fewest"), F.max(F.when(F.col("apart"), F.col("n"))).alias("most"),
    ).filter("low is not null")
    window = F.col("far").between(F.col("low") - reach, F.col("high") + reach) & F.col("n").between(F.floor(F.col("fewest") * least / out_of), F.ceil(F.col("most") * out_of / least))
    close = keep(marked.join(spans, "pivot").filter(F.col("apart") | window).select("pivot", "name", "n", "far", "label", "apart"), "windows")
    sizes = close.groupBy("pivot").agg(F.count(F.when(F.col("apart"), 1)).alias("apart_n"), F.count(F.lit(1)).alias("all_n"))
    # a block holds some of the members apart (side 0) and some of all members (side 1)
    dealt = close.join(sizes, "pivot").join(sketches, "name").withColumn("rows", _split(F.col("apart_n"))).withColumn("cols", _split(F.col("all_n")))
    number = lambda n: F.pmod(F.xxhash64("name"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cols = ["pivot", "name", "n", "far", "label", "sketch"]
    left = dealt.filter("apart").select(*cols, F.lit(0).alias("side"), number(F.col("rows")).alias("r"), upto(F.col("cols")).alias("c"))
    right = dealt.select(*cols, F.lit(1).alias("side"), number(F.col("cols")).alias("c"), upto(F.col("rows")).alias("r"))
    share = (out_of - least) / (out_of + least)

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        some, others = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        found: dict = {}
        if len(some) and len(others):
            n, far, label, name = (others[c].to_numpy() for c in ("n", "far", "label", "name"))
            widths = others["sketch"].map(len).to_numpy()
            tables: dict[tuple[int, int], np.ndarray] = {}
            for row in some.itertuples():
                for width in np.unique(widths):
                    at = np.flatnonzero((widths == width) & (label != row.label) & (np.abs(far - row.far) <= reach))
                    buckets = min(int(width), len(row.sketch))
                    # sizes this far apart cannot link
                    if not len(at) or max(int(width), len(row.sketch)) * least > 2 * buckets * out_of:
                        continue
                    if (width, buckets) not in tables:
                        tables[width, buckets] = np.zeros((len(others), buckets), np.int32)
                        for k in np.flatnonzero(widths == width):
                            tables[width, buckets][k] = _folded(others["sketch"].iloc[k], buckets)
                    apart = np.abs(tables[width, buckets][at] - _folded(row.sketch, buckets)).sum(1)
                    for k, d in zip(at[apart <= share * (n[at] + row.n) + 1e-9], apart[apart <= share * (n[at] + row.n) + 1e-9], strict=True):
                        pair = tuple(sorted((row.label, int(label[k])))) if nearest else tuple(sorted((row.name, int(name[k]))))
                        found[pair] = min(found.get(pair, (1 << 60,)), (int(d), row.name, int(name[k]), int(n[k])))
        rows = [x[1:] for x in found.values()]
        return pd.DataFrame(rows, columns=["pivot", "name", "n"], dtype="int64")

    return left.unionByName(right).groupBy("pivot", "r", "c").applyInPandas(compare, "pivot long, name long, n long").distinct()


def _named_sets(docs: DataFrame, k: int, least: int, out_of: int, sketches: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their sets' names, the n-grams by which pairs meet, and the sets that may meet others."""
    full = keep(documents(docs, k, least, out_of), "rows")
    kept = keep(rare_grams(full.filter(F.size("firsts") > 0), least, out_of), "grams")
    rows = keep(full.drop("firsts"), "rows")
    release(full)
    # rows of these sets, and the sets that have n-grams to meet by
    either = rows.select("name", "id").unionByName(kept.select("name", F.lit(None).cast("long").alias("id")))
    named = either.groupBy("name").agg(F.min("id").alias("id"), F.count_if(F.col("id").isNull()).alias("meets")).filter("meets > 0")
    wanted = named.groupBy("id").agg(F.collect_list("name").alias("names"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_portions(batches, "text", PORTION):
            sets = _sets(b.column("text").to_pylist(), k)
            names = [_name(s) for s in sets]
            chosen = [(n, s.tobytes(), _sketch(s) if sketches else None) for n, s, known in zip(names, sets, b.column("names").to_pylist(), strict=True) if n in set(known)]
            columns = zip(*chosen, strict=True) if chosen else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _SETS.types, strict=True)], schema=_SETS)

    source = docs.withColumn("id", F.coalesce("doc_id", F.lit(_LAST))).select("id", "text")
    sets = keep(source.join(wanted, "id").mapInArrow(lean(fetch), "name long, grams binary, sketch binary").dropDuplicates(["name"]), "sets")
    return rows, kept, sets


def _near(measured: DataFrame, least: int, out_of: int) -> DataFrame:
    return measured.filter((F.col("both") * out_of >= F.col("either") * least) & (F.col("pivot") != F.col("name")))


def _linked_to_pivot(members: DataFrame, least: int, out_of: int) -> DataFrame:
    """Links (a, b) of members with their pivot: the difference is a small part of both sizes."""
    near = F.col("apart") * (out_of + least) <= (F.col("n") + F.col("pivot_n")) * (out_of - least)
    return members.filter(near & (F.col("pivot") != F.col("name"))).select(F.col("pivot").alias("a"), F.col("name").alias("b"))


def _joined_regions(members: DataFrame, sets: DataFrame, labels: DataFrame, least: int, out_of: int) -> tuple[list[DataFrame], DataFrame]:
    """Links (a, b) between members of a region that ``labels`` leave apart, and the labels with them; ``members``
    has their differences from the pivot."""
    own = members.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))
    main = labels.select(F.col("name").alias("pivot"), F.col("label").alias("main"))
    near, with_near, with_far = is_near(least, out_of)
    marked = own.join(main, "pivot", "left").withColumn("main", F.coalesce("main", "pivot"))
    marked = keep(marked.select("pivot", "name", "n", "pivot_n", "apart", "difference", (F.col("label") != F.col("main")).alias("asks"), near.alias("near"), with_near.alias("with_near"), with_far.alias("with_far")), "marked")
    # near the pivot: the differences from it
    close = marked.filter("with_near").select("pivot", "name", "n", "pivot_n", "apart", F.col("apart").alias("size"), "difference", "asks", "near")
    near_rows = placed_members(close, "difference", F.when(F.col("asks") & F.col("near"), near_reach(least, out_of)).otherwise(0))
    some, other = (marked.select("pivot", F.col("name").alias(c), F.col("n").alias(f"{c}_n"), F.col("difference").alias(f"{c}_difference")) for c in ("a", "b"))
    # far from it: the sets themselves, wherever they stand
    wide = marked.filter("with_far").groupBy("name").agg(F.first("n").alias("n"))
    whole = wide.join(sets.select("name", "grams"), "name").select(F.lit(0).cast("long").alias("pivot"), "name", "n", F.col("n").alias("size"), "grams")
    far_rows = placed_members(whole, "grams", far_reach(least, out_of), all_ask=True)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            apart = np.array([len(np.setxor1d(_grams(x), _grams(y), assume_unique=True)) for x, y in zip(pdf["a_difference"], pdf["b_difference"], strict=True)], np.int64)
            linked = apart * (out_of + least) <= (pdf["a_n"] + pdf["b_n"]).to_numpy() * (out_of - least)
            yield pdf.loc[linked, ["a", "b"]]

    links_ = []
    for heads in (True, False):
        ways = meeting_pairs(near_rows, labels, least, out_of, heads)
        first = ways.join(some, ["pivot", "a"]).join(other, ["pivot", "b"]).mapInPandas(lean(compare), "a long, b long")
        met = meeting_pairs(far_rows, labels, least, out_of, heads)
        pairs = met.select(F.col("a").alias("pivot"), F.col("b").alias("name"), F.lit(0).cast("long").alias("n"))
        second = _near(_to_pivots(pairs, sets), least, out_of).select(F.col("pivot").alias("a"), F.col("name").alias("b"))
        links_.append(keep(first.unionByName(second), "links"))
        release(ways, met)
        labels = _grouped(labels, links_[-1])
    release(marked, near_rows, far_rows)
    return links_, labels


def _grouped(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels (name, label: the least name of its group; names that are their own label are left out) with more links."""
    return merged(labels.withColumnRenamed("name", "node"), found).withColumnRenamed("node", "name")


def links(docs: DataFrame, k: int = SHINGLE, least: int = LEAST, out_of: int = OUT_OF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their sets' names, links between different sets (a, b: names), and the labels of linked sets (name, label:
    the least name of its group; names that are their own label are left out).

    The links are all real, and enough: sets within the threshold are connected by them.
    """
    rows, kept, sets = _named_sets(docs, k, least, out_of)
    near = lambda m: _near(m, least, out_of).select(F.col("pivot").alias("a"), F.col("name").alias("b"))
    found, tested, labels = [], None, docs.sparkSession.createDataFrame([], "name long, label long")
    for _ in range(ROUNDS):
        pairs = keep(head_pairs(kept, labels, tested, least, out_of), "pairs")
        found.append(keep(near(_to_pivots(pairs, sets)), "links"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = _grouped(labels, found[-1])
    members = keep(_differences(cells(kept, labels), sets, least, out_of), "differences")
    release(kept)
    found.append(keep(_linked_to_pivot(members, least, out_of), "links"))
    more, labels = _joined_regions(members, sets, _grouped(labels, found[-1]), least, out_of)
    release(members, sets)
    return rows, reduce(DataFrame.unionByName, found + more), labels


def join_pairs(docs: DataFrame, k: int = SHINGLE, least: int = LEAST, out_of: int = OUT_OF, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All pairs of different sets that link, and which rows have them.

    Returns the rows (doc_id, text_key, name of the set, n) and the pairs (a < b: names of sets,
    both, either: sizes of intersection and union), each once. Rows with one name have equal
    sets; those of an empty set link with nothing. There are as many pairs as there are links,
    so a group of near copies may have as many as the square of its different sets.
    """
    rows, kept, sets = _named_sets(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), k, least, out_of, sketches=True)
    apart = docs.sparkSession.createDataFrame([], "name long, label long")
    measured = keep(_to_pivots(cells(kept, apart), sets), "distances")
    members = measured.select("pivot", "name", "n", (1 - F.col("both") / F.col("either")).alias("far"), F.col("name").alias("label"))
    open_pairs = _within(members, sets.select("name", "sketch"), False, least, out_of)
    pairs = keep(open_pairs.select(F.least("pivot", "name").alias("pivot"), F.greatest("pivot", "name").alias("name"), F.lit(0).cast("long").alias("n")).distinct(), "pairs")
    found = _near(_to_pivots(pairs, sets), least, out_of).select(F.col("pivot").alias("a"), F.col("name").alias("b"), "both", "either")
    return rows.select("doc_id", "text_key", "name", "n"), keep(found, "links")


def count_links(docs: DataFrame, k: int = SHINGLE, least: int = LEAST, out_of: int = OUT_OF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, n_links (other rows whose sets link with its own, or equal it)."""
    rows, pairs = join_pairs(docs, k, least, out_of, id_col, text_col)
    copies = keep(rows.filter("n > 0").groupBy("name").agg(F.count(F.lit(1)).alias("copies")), "copies")
    ways = pairs.select(F.col("a").alias("own"), F.col("b").alias("name")).unionByName(pairs.select(F.col("b").alias("own"), "a").toDF("own", "name"))
    others = ways.join(copies, "name").groupBy("own").agg(F.sum("copies").alias("others")).withColumnRenamed("own", "name")
    counts = copies.join(others, "name", "left").select("name", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.join(counts, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _linked(docs: DataFrame, k: int, least: int, out_of: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, text_key, name, n, component_id."""
    rows, _, labels = links(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), k, least, out_of)
    nodes = rows.filter("n > 0").groupBy("name").agg(F.min("id").alias("id"))
    labelled = keep(nodes.join(labels, "name", "left").select("name", "id", F.coalesce("label", "name").alias("label")), "labels")
    least_id = labelled.groupBy("label").agg(F.min("id").alias("least_id"))
    reached = labelled.join(least_id, "label").select("name", "least_id")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif("least_id", F.lit(_LAST)))
    return rows.join(reached, "name", "left").select("doc_id", "text_key", "name", "n", component.alias("component_id"))


def link_documents(docs: DataFrame, k: int = SHINGLE, least: int = LEAST, out_of: int = OUT_OF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    A set holds the distinct ``k``-grams of the words in small letters (A-Z); two documents
    link when ``out_of`` times the intersection is at least ``least`` times the union. A
    missing or empty text has an empty set, which links with nothing. A missing id counts as greater
    than all others. Repeated rows are linked, their sets being equal. Other columns are left out.
    """
    return _linked(docs, k, least, out_of, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, k: int = SHINGLE, least: int = LEAST, out_of: int = OUT_OF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that link to a smaller document.

    Of each component the smallest id stays, once for each of its sets. Rows with an empty set stay.
    """
    decided = keep(_linked(docs, k, least, out_of, id_col, text_col), "decided")
    own = decided.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    full = own.filter("n > 0").groupBy("doc_id", "name").agg(F.min("text_key").alias("stay_key")).select("doc_id", "stay_key", F.lit(True).alias("once"))
    empty = own.filter("n = 0").select("doc_id", F.col("text_key").alias("stay_key"), F.lit(False).alias("once")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("own"), F.xxhash64(F.col(text_col)).alias("own_key"))
    stays = full.unionByName(empty)
    kept = packed.join(stays, packed["own"].eqNullSafe(stays["doc_id"]) & (packed["own_key"] == stays["stay_key"]))
    return kept.filter("once").dropDuplicates(["own", "own_key"]).unionByName(kept.filter("not once")).select("doc.*")
