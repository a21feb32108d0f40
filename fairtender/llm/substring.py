"""Passages of words that occur in several documents, found by level-wise doubling.

Level 0 looks at seeds, runs of half the least length: of the seeds inside a window the one
with the least hash stands for it, so about a fifth of all places is looked up and still every
window has its seed. Only windows around repeated seeds are candidates at the least length.
All windows that are repeated at one length are extended to twice that length, until no
candidates survive. Of documents with the same words only that of the smallest id takes part, as
the others' windows are all repeated whatever else there is.

Which windows are repeated is asked and answered in packed rows: a task collects its hashes,
finds those it has under two ids itself, and sends the others, each with its least id, to the
bucket of the hash; the bucket answers to the ids. So a passage that is everywhere sends one entry
per task. Windows are told apart by 96 bits of hash.

A document id counts as one document. A missing id counts as greater than all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.llm.staging import keep, release
from fairtender.llm.words import Words, mix, portions, scan, text_or_none

WINDOW = 13
#: entries that a task collects before it sends them, entries per bucket, and buckets per
#: shuffle partition at most
ENTRIES, BUCKET, BUCKETS = 1_000_000, 200_000, 4
_LAST = (1 << 63) - 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CHECK = np.uint64(0x2545F4914F6CDD1D)


def _id(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(_LAST))


def _texts(pdf: pd.DataFrame) -> list:
    return [text_or_none(t) for t in pdf["text"]]


def seeds(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``window`` words: its hash, the least hash of its seeds, and whether
    it lies in one text."""
    whole, inside = words.windows(window)
    half, _ = words.windows(max(1, window // 2))
    least = half[: len(whole)].copy()
    for j in range(1, window - max(1, window // 2) + 1):
        np.minimum(least, half[j : j + len(whole)], out=least)
    return whole, least, inside


def check_values(words: Words, window: int) -> np.ndarray:
    """32 more bits of each window, from other factors than its hash."""
    n = max(0, len(words.hash) - window + 1)
    out = np.zeros(n, np.uint64)
    for j in range(window):
        out = out * _CHECK + (words.hash[j : j + n] >> np.uint64(7))
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


# ---- asking which hashes have several ids ------------------------------------------------

_ASKED = pa.schema([("bucket", pa.int32()), ("known", pa.bool_())] + [(c, pa.binary()) for c in ("h", "c", "id", "flag")])
_ANSWERED = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("id", "h", "flag")])
_AGAIN = pa.schema([("id", pa.int64()), ("again", pa.binary()), ("earlier", pa.binary())])


def _sent(schema: pa.Schema, bucket: np.ndarray, columns: list[np.ndarray], *flags: bool) -> pa.RecordBatch:
    """Entries packed into a row per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True)) if len(bucket) else []
    packed = [pa.array([c[a:b].tobytes() for a, b in cuts], pa.binary()) for c in columns]
    heads = [pa.array(bucket[starts].astype(np.int32)), *[pa.array([f] * len(cuts), pa.bool_()) for f in flags]]
    return pa.RecordBatch.from_arrays([*heads, *packed], schema=schema)


def entries(h: np.ndarray, c: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of hash and id of a task, as rows to the hashes' buckets.

    Of each hash the least id asks, with a flag that says whether there are others; the others
    have their answer already: a smaller id has the hash, too.
    """
    order = np.lexsort((ids, h))
    if (np.diff(h[order]) == 0)[np.diff(c[order]) != 0].any():  # two windows of one hash
        order = np.lexsort((ids, c, h))
    h, c, ids = h[order], c[order], ids[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]) | (c[1:] != c[:-1])
    h, c, ids = h[fresh], c[fresh], ids[fresh]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    last = np.ones(len(h), bool)
    last[:-1] = first[1:]
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    for known, some in ((False, first), (True, ~first)):
        yield _sent(_ASKED, bucket[some], [h[some], c[some], ids[some], last[some] == 0], known)


class _Outbox:
    """Entries of a task, sent when there are many."""

    def __init__(self, send):
        self.send, self.held, self.size = send, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size >= ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield from self.send(*[np.concatenate(x) for x in zip(*self.held, strict=True)])
        self.held, self.size = [], 0


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one bucket together; they follow one another."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _joined(rows: list[dict], column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join([r[column] for r in rows]), kind)


def _answer(buckets: int):
    """To the ids: which of their hashes have several ids, and whether a smaller one is among these."""

    def send(ids: np.ndarray, h: np.ndarray, earlier: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = (mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        yield _sent(_ANSWERED, bucket, [ids, h, earlier])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(send)
        for rows in _by_bucket(batches):
            asked, known = [r for r in rows if not r["known"]], [r for r in rows if r["known"]]
            h, c, ids, more = (_joined(asked, x, t) for x, t in (("h", np.uint64), ("c", np.uint32), ("id", np.int64), ("flag", bool)))
            order = np.lexsort((ids, c, h))
            h, c, ids, more = h[order], c[order], ids[order], more[order]
            starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, np.int64)
            sizes = np.diff(starts, append=len(h))
            least = np.repeat(ids[starts], sizes)
            several = np.repeat(np.logical_or.reduceat(more, starts) | (ids[starts] != ids[starts + sizes - 1]), sizes) if len(h) else more
            told_ids = np.concatenate([ids[several], _joined(known, "id", np.int64)])
            told_h = np.concatenate([h[several], _joined(known, "h", np.uint64)])
            earlier = np.concatenate([(ids != least)[several], np.ones(len(told_ids) - int(several.sum()), bool)])
            yield from box.add(told_ids, told_h, earlier)
        yield from box.flush()

    return run


def _by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per id with its repeated hashes, each once."""
    for rows in _by_bucket(batches):
        ids, h, earlier = (_joined(rows, x, t) for x, t in (("id", np.int64), ("h", np.uint64), ("flag", bool)))
        order = np.lexsort((~earlier, h, ids))
        ids, h, earlier = ids[order], h[order], earlier[order]
        fresh = np.r_[True, (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])] if len(ids) else np.zeros(0, bool)
        ids, h, earlier = ids[fresh], h[fresh], earlier[fresh]
        starts = np.flatnonzero(np.diff(ids, prepend=-1)) if len(ids) else np.zeros(0, np.int64)
        cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True)) if len(ids) else []
        columns = [pa.array(ids[starts]), *[pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (h, earlier)]]
        yield pa.RecordBatch.from_arrays(columns, schema=_AGAIN)


def repeated(asked: DataFrame, buckets: int) -> DataFrame:
    """Per id with repeated hashes: ``again`` (these hashes) and ``earlier`` (whether a smaller id has each)."""
    at_hash = asked.repartition("bucket").sortWithinPartitions("bucket")
    told = at_hash.mapInArrow(_answer(buckets), "bucket int, id binary, h binary, flag binary")
    at_id = told.repartition("bucket").sortWithinPartitions("bucket")
    return at_id.mapInArrow(_by_id, "id long, again binary, earlier binary")


ASKED_SQL = "bucket int, known boolean, h binary, c binary, id binary, flag binary"


def _buckets(df: DataFrame, entries_: Column) -> int:
    """Buckets for as many entries as the rows have together."""
    most = BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, -(-int(df.agg(F.sum(entries_)).first()[0] or 0) // BUCKET)))


# ---- windows -----------------------------------------------------------------------------

_WINDOWS = pa.schema([("id", pa.int64())] + [(c, pa.binary()) for c in ("at", "h", "c")] + [("n", pa.int64())])
WINDOWS_SQL = "id long, at binary, h binary, c binary, n long"


def _window_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Per document: id, and places, hashes, check values and number of windows."""
    ids, *columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    sizes = pa.array([len(x) for x in columns[0]], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([x.tobytes() for x in c], pa.binary()) for c in columns], sizes], schema=_WINDOWS)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["at"], np.int32), np.frombuffer(row["h"], np.uint64), np.frombuffer(row["c"], np.uint32)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield from portions(iter([batch.to_pandas(integer_object_nulls=True)]), "text")


def candidates(docs: DataFrame, taking_part: DataFrame, window: int, buckets: int) -> DataFrame:
    """Windows around repeated seeds, of the ids that take part."""

    def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(lambda *e: entries(*e, buckets))
        for pdf in _frames(batches):
            words = scan(_texts(pdf))
            _, least, inside = seeds(words, window)
            ids = np.repeat(pdf["id"].to_numpy(np.int64), words.counts())[: len(least)]
            inside[1:] &= (least[1:] != least[:-1]) | (ids[1:] != ids[:-1]) | ~inside[:-1]
            yield from box.add(least[inside], np.zeros(int(inside.sum()), np.uint32), ids[inside])
        yield from box.flush()

    found = repeated(docs.mapInArrow(seed_rows, ASKED_SQL), buckets).select("id", F.col("again").alias("seeds"))
    wanted = found.join(taking_part, "id", "left_semi")

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _frames(batches):
            words = scan(_texts(pdf))
            whole, least, inside = seeds(words, window)
            check = check_values(words, window)
            out = []
            for k, (doc, known) in enumerate(zip(pdf["id"], pdf["seeds"], strict=True)):
                lo, hi = words.first[k], min(words.first[k + 1], len(whole))
                hit = np.flatnonzero(np.isin(least[lo:hi], np.frombuffer(known, np.uint64)) & inside[lo:hi])
                out.append((doc, hit.astype(np.int32), whole[lo:hi][hit], check[lo:hi][hit]))
            yield _window_rows(out)

    return docs.join(wanted, "id").mapInArrow(window_rows, WINDOWS_SQL)


def _repeated_windows(windows: DataFrame) -> DataFrame:
    buckets = _buckets(windows, F.col("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(lambda *e: entries(*e, buckets))
        for batch in batches:
            for row in batch.to_pylist():
                _, h, c = _unpacked(row)
                yield from box.add(h, c, np.full(len(h), row["id"], np.int64))
        yield from box.flush()

    return repeated(windows.mapInArrow(run, ASKED_SQL), buckets)


def _doubled(windows: DataFrame, again: DataFrame, reach: int) -> DataFrame:
    """Windows of twice the length ``reach``, both halves of which are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at, h, c = _unpacked(row)
                live = np.isin(h, np.frombuffer(row["again"], np.uint64))
                at, h, c = at[live], h[live], c[live]
                other = np.searchsorted(at, at + reach)
                both = np.flatnonzero(other < len(at))
                both = both[at[other[both]] == at[both] + reach]
                if len(both):
                    right = other[both]
                    out.append((row["id"], at[both], mix(h[both] * _STEP + h[right]), (c[both] * np.uint32(0x85EBCA6B) + c[right]) ^ (c[right] >> np.uint32(13))))
            yield _window_rows(out)

    return windows.join(again.select("id", "again"), "id").mapInArrow(run, WINDOWS_SQL)


def _longest(windows: DataFrame, again: DataFrame, window: int) -> DataFrame:
    """Per id the greatest length, doubled from ``window``, at which a window of it is repeated.

    All windows that survive at one length are doubled to the next; the tables of a level go
    when the next one is written. ``windows`` goes, too; ``again`` stays.
    """
    reach, levels, found = window, [keep(again.select("id", F.lit(window).cast("long").alias("length")), "reached")], again
    while True:
        doubled = keep(_doubled(windows, found, reach), "doubled")
        release(windows, None if found is again else found)
        windows, found = doubled, keep(_repeated_windows(doubled), "again")
        if found.isEmpty():
            release(doubled, found)
            break
        reach *= 2
        levels.append(keep(found.select("id", F.lit(reach).cast("long").alias("length")), "reached"))
    reached = levels[0]
    for level in levels[1:]:
        reached = reached.unionByName(level)
    longest = keep(reached.groupBy("id").agg(F.max("length").alias("longest")), "longest")
    release(*levels)
    return longest


def _same_words(rows: DataFrame) -> DataFrame:
    """Per row with words: id, a key of all its words, their number, ``rep`` (the least id of the key), ``several``."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _frames(batches):
            words = scan(_texts(pdf))
            bounds = list(zip(words.first[:-1], words.first[1:], strict=True))
            out = [(d, hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=16).digest(), int(b - a)) for d, (a, b) in zip(pdf["id"], bounds, strict=True) if b > a]
            ids, key, n = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(key, pa.binary()), pa.array(n, pa.int64())], names=["id", "key", "n"])

    own = keep(rows.mapInArrow(keys, "id long, key binary, n long"), "keys")
    groups = keep(own.groupBy("key").agg(F.min("id").alias("rep"), (F.min("id") < F.max("id")).alias("several")), "groups")
    # a key may have a third of all rows; a plain join can be split
    facts = keep(own.distinct().join(groups, "key"), "classes")
    release(own, groups)
    return facts


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Take out of each document the words covered by windows that start in a smaller document.

    Returns per row: doc_id, n_words, n_removed, kept (the words left, joined by one space),
    kept_sha256, and longest_repeat (the greatest length ``window`` * 2**k at which a window of
    the document is repeated; 0: none). Windows are
    judged on the input. A missing or empty text has no words. Rows that share an id do not
    count as repeats of each other. Other columns are left out.
    """
    rows = docs.select(_id(id_col).alias("id"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    classes = _same_words(rows.select("id", "text"))
    # all rows of an id that is the least of some words; those of an id with other words, too, do no harm
    taking_part = classes.filter("id = rep").select("id").distinct()
    buckets = _buckets(classes, F.col("n") / 4)  # about a seed for each four or five words
    windows = keep(candidates(rows.select("id", "text"), taking_part, window, buckets), "windows")
    again = keep(_repeated_windows(windows), "again")
    longest = _longest(windows, again, window)
    fact = F.struct("key", (F.col("id") > F.col("rep")).alias("copy"), "several")
    known = classes.groupBy("id").agg(F.collect_list(fact).alias("facts"))  # one per different text of an id
    notes = keep(known.join(again, "id", "left").join(longest, "id", "left"), "notes")
    release(again, longest, classes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _frames(batches):
            texts = _texts(pdf)
            words = scan(texts)
            whole, inside = words.windows(window)
            out = []
            for k, (text, facts, again, earlier, longest) in enumerate(zip(texts, pdf["facts"], pdf["again"], pdf["earlier"], pdf["longest"], strict=True)):
                lo, hi = words.first[k], words.first[k + 1]
                n = int(hi - lo)
                own = (text or "").encode("utf-8", "surrogatepass").split()
                gone, most = np.zeros(n, bool), 0 if pd.isna(longest) else int(longest)
                copy, several = _fact(facts, words.hash[lo:hi])
                if several and n >= window:
                    most = max(most, window << int(n // window).bit_length() - 1)
                if copy and n >= window:
                    gone[:] = True
                elif again is not None:
                    removed = np.frombuffer(again, np.uint64)[np.frombuffer(earlier, bool)]
                    end = min(hi, len(whole))
                    hit = np.isin(whole[lo:end], removed) & inside[lo:end]
                    edge = np.zeros(n + window, np.int32)
                    starts = np.flatnonzero(hit)
                    edge[starts] += 1
                    edge[starts + window] -= 1
                    gone = np.cumsum(edge)[:n] > 0
                if gone.any():
                    own = list(compress(own, ~gone))
                kept = b" ".join(own)
                out.append((most, n, int(gone.sum()), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            frame = pd.DataFrame(out, columns=["longest_repeat", "n_words", "n_removed", "kept", "kept_sha256"])
            frame.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield pa.RecordBatch.from_pandas(frame, _RESULT, preserve_index=False)

    joined = rows.join(notes, "id", "left").select("doc_id", "text", "facts", "again", "earlier", "longest")
    return joined.mapInArrow(cut, "doc_id long, longest_repeat long, n_words long, n_removed long, kept string, kept_sha256 string")


_RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("longest_repeat", "n_words", "n_removed")], ("kept", pa.string()), ("kept_sha256", pa.string())])


def _fact(facts, hashes: np.ndarray) -> tuple[bool, bool]:
    """Whether a smaller id has the same words, and whether another one has."""
    if facts is None or not len(hashes):
        return False, False
    if len(facts) > 1:
        key = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
        facts = [f for f in facts if f["key"] == key]
    return facts[0]["copy"], facts[0]["several"]
