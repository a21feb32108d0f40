"""Token ids of documents in ORC files.

Documents are dealt out by ranges of their id and encoded where they land, so that the files
in order of their names hold the ids in ascending order of the document id. ORC stores the
token ids of a stripe as run-length encoded integers; row indexes and a Bloom filter on the
document id let a reader skip stripes, and stripes are read in parallel.

Columns of a file: ``part`` (number of the range), ``at`` (token ids before this document in
its range), the document id, ``ids``.
"""

from __future__ import annotations

import codecs
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairtender.llm.staging import keep
from fairtender.llm.words import lean, run_hashes, text_portions, word_bounds

#: words that a worker remembers per generation, at some 40 bytes each
CACHED_WORDS = 500_000
#: bytes of text encoded at once; a worker needs some 30 times as many
PORTION = 1 << 20
#: what a tokenizer must encode alike in one piece and word by word, or it gets whole texts
PROBE = """It's 12.5, isn't it?  We'll SEE\tthe\u00a0d\u00e9j\u00e0-vu... of x,y 3rd. a.b,c! (42) \u4e2d\u6587 \U0001f388 e\u0301 \u0130 'S I'm
\x0bend. , . ,. A1,B2. <b> \u017f"""
#: signs of which a run at a word's end is a unit of its own; no apostrophe, and none that names of special tokens end with
_SIGNS_CUT = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: the longest such run
RUN = 16
PROBE_SIGNS = " ".join([*(f"ab{chr(c)} 7{chr(c)} qu\u00e9{chr(c)}" for c in _SIGNS_CUT), "Well?!... x,%%% l\u00e0*** (a)] it's), \u00d7?? it'. a|>. -- ...b"])
_ALNUM, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP[list(_SIGNS_CUT)] = True
#: second bytes of the letters from U+00C0 to U+00FF
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(128, 192) if b not in (0x97, 0xB7)]] = True
#: new words encoded at once
AT_ONCE = 1000


def _lengths_to_bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``start``, ``start + 1``, … of each run, one after the other."""
    bounds = _lengths_to_bounds(lengths)
    return np.repeat(starts - bounds[:-1], lengths) + np.arange(bounds[-1])


def _ends_of_words(joined: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first four and the last four bytes of each word, and so all of a short word."""
    at_byte = np.ndarray((len(joined),), "<u4", joined + b"\0\0\0\0", strides=(1,))
    size = end - start
    first = at_byte[start].astype(np.uint64)
    last = at_byte[np.maximum(end - 4, start)].astype(np.uint64)
    few = np.minimum(size, 4).astype(np.uint64) * np.uint64(8)
    mask = (np.uint64(1) << few) - np.uint64(1)
    return (first & mask) << np.uint64(32) | (last & mask)


def _grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different hash, and of each hash the number of its group.

    Hashes are sorted with their places in the lowest bits, so that one plain sort does; hashes
    that differ in these bits only get into one group.
    """
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    order = np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64))
    at = (order & low).astype(np.int64)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (order[1:] & ~low) != (order[:-1] & ~low)
    which = np.empty(len(order), np.int64)
    which[at] = np.cumsum(fresh) - 1
    return at[fresh], which


def _signs_at_end(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many signs each word ends with, 0 if they do not follow a letter or digit."""
    count = np.zeros(len(start), np.int64)
    open_ = np.flatnonzero((end - start > 1) & _STOP[data[end - 1]])
    for k in range(1, RUN + 1):
        before = end[open_] - 1 - k
        some = before >= start[open_]
        open_, before = open_[some], before[some]
        byte = data[before]
        latin = _LATIN[byte] & (before > start[open_]) & (data[np.maximum(before - 1, 0)] == 0xC3)
        count[open_[_ALNUM[byte] | latin]] = k
        open_ = open_[_STOP[byte]]
    return count


class Units:
    """Words of texts, the signs at a word's end apart, and which of them are equal.

    Words are told apart by 64 bits of hash with their length and both their ends.
    """

    def __init__(self, raw: list[bytes]):
        self.joined = b" ".join(raw) + b" "
        data = np.frombuffer(self.joined, np.uint8)
        start, end = word_bounds(data)
        signs = _signs_at_end(data, start, end)
        cut = signs > 0
        at = np.arange(len(start)) + np.cumsum(cut) - cut
        self.start, self.end = (np.empty(len(start) + int(cut.sum()), np.int64) for _ in range(2))
        self.start[at], self.end[at] = start, end - signs
        self.start[at[cut] + 1], self.end[at[cut] + 1] = end[cut] - signs[cut], end[cut]
        self.first = np.searchsorted(self.start, np.cumsum([0, *[len(r) + 1 for r in raw]]))
        hashes = run_hashes(data, self.start, self.end)
        size, ends = self.end - self.start, _ends_of_words(self.joined, self.start, self.end)
        self.some, self.which = _grouped(hashes)
        standing = self.some[self.which]
        if (hashes != hashes[standing]).any() or (size != size[standing]).any() or (ends != ends[standing]).any():  # two words of one hash
            self.some = self.which = np.arange(len(self.start))
        self.hash = hashes[self.some]
        self.check = ends[self.some] ^ (size[self.some].astype(np.uint64) << np.uint64(56))

    def words(self, some: np.ndarray) -> list[bytes]:
        """Some of the different units."""
        joined, at = self.joined, self.some[some]
        return [joined[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


class Table:
    """Words by hash with their ids."""

    def __init__(self, h: np.ndarray, check: np.ndarray, size: np.ndarray, ids: np.ndarray):
        order = np.argsort(h, kind="stable")
        at = _lengths_to_bounds(size)[:-1]
        self.h, self.check, self.size, self.at, self.ids = h[order], check[order], size[order], at[order], ids

    @classmethod
    def empty(cls) -> Table:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))

    def joined(self, h: np.ndarray, check: np.ndarray, size: np.ndarray, ids: np.ndarray) -> Table:
        own = self.ids[_spread(self.at, self.size)]
        parts = zip((self.h, self.check, self.size, own), (h, check, size, ids), strict=True)
        return Table(*[np.concatenate(p) for p in parts])

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each word, -1 if it is not there."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where((self.h[at] == h) & (self.check[at] == check), at, -1)


class Encoder:
    """Encodes texts word by word and remembers words.

    For tokenizers that take capital letters as small ones, split at white space and before
    signs that end a word, and never carry a token or a rule across a split, as the
    given one does; the ids are then those of the whole text. A tokenizer that encodes ``PROBE``
    or ``PROBE_SIGNS`` otherwise in whole than word by word gets whole texts. Texts that may hold the name of
    a special token keep their capitals.

    Words are remembered in three tables: new ones, those of the present generation, and those
    of the generation before, from which words that occur again are taken over.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.new, self.young, self.old = Table.empty(), Table.empty(), Table.empty()
        self.pieces, self.ends = _marked_ends(self.tokenizer)
        probes = [PROBE, PROBE.upper(), " ".join(reversed(PROBE.split(" "))), PROBE_SIGNS, PROBE_SIGNS.upper()]
        self.whole = any(self._by_words([p.encode()])[0].tolist() != self._ids(p) for p in probes)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words; those that are one piece to the splitter go to the model at once."""
        joined = b" ".join(words).decode()
        # holds for a word if it holds for all
        small, usual = joined == joined.lower(), unicodedata.is_normalized("NFC", joined)
        texts = joined.split(" ") if words else []
        one = [t.isalpha() and (small or t == t.lower()) and (usual or unicodedata.is_normalized("NFC", t)) for t in texts]
        single = np.array(one, bool)
        sizes, parts = np.zeros(len(words), np.int64), []
        for some, coded in ((single, self._pieces(list(compress(words, one)))), (~single, self._texts(list(compress(texts, (~single).tolist()))))):
            sizes[some] = coded[0]
            parts.append((some, coded[1]))
        bounds = _lengths_to_bounds(sizes)
        ids = np.empty(bounds[-1], np.int32)
        for some, own in parts:
            ids[_spread(bounds[:-1][some], sizes[some])] = own
        return sizes.astype(np.int32), ids

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of texts, each by itself."""
        coded = [c.ids for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return sizes, np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum()))

    def _pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words that are one piece each.

        Where the last token of a piece is marked as such, many words go to the model as one
        text, written as byte-level tokenizers write them.
        """
        if self.pieces is None:
            tokenize = self.tokenizer.model.tokenize
            coded = [[t.id for t in tokenize(codecs.charmap_decode(w, "strict", _SIGNS)[0])] for w in words]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            return sizes, np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum()))
        texts = [codecs.charmap_decode(b" ".join(words[k : k + AT_ONCE]), "strict", _SIGNS)[0] for k in range(0, len(words), AT_ONCE)]
        ids = [np.array(c.ids, np.int32) for c in self.pieces.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.int32), *ids])
        return np.diff(np.flatnonzero(self.ends[ids]), prepend=-1), ids

    def _known(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the different units, those not known so far learnt."""
        size, missing, found = np.zeros(len(units.hash), np.int64), np.arange(len(units.hash)), []
        for table in (self.new, self.young, self.old):
            at = table.find(units.hash[missing], units.check[missing])
            hit = at >= 0
            found.append((table, missing[hit], at[hit]))
            size[missing[hit]] = table.size[at[hit]]
            missing = missing[~hit]
        new_sizes, new_ids = self._coded(units.words(missing))
        size[missing] = new_sizes
        bounds = _lengths_to_bounds(size)
        flat = np.empty(bounds[-1], np.int32)
        flat[_spread(bounds[missing], new_sizes)] = new_ids
        for table, some, at in found:
            flat[_spread(bounds[some], size[some])] = table.ids[_spread(table.at[at], table.size[at])]
        learnt = np.concatenate([missing, found[2][1]])
        if len(learnt):
            own = size[learnt]
            self.new = self.new.joined(units.hash[learnt], units.check[learnt], own.astype(np.int32), flat[_spread(bounds[learnt], own)])
        if len(self.new.h) > CACHED_WORDS // 8:
            self.young = self.young.joined(self.new.h, self.new.check, self.new.size, self.new.ids[_spread(self.new.at, self.new.size)])
            self.new = Table.empty()
        if len(self.young.h) > CACHED_WORDS:
            self.old, self.young = self.young, Table.empty()
        return bounds, flat

    def _by_words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8), one after the other, and how many each text has."""
        units = Units([r if b"<|" in r else r.lower() for r in raw])
        bounds, flat = self._known(units)
        own = np.diff(bounds)[units.which]
        return flat[_spread(bounds[:-1][units.which], own)], np.diff(_lengths_to_bounds(own)[units.first])

    def encode(self, texts: list[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        raw = [t if isinstance(t, bytes) else t.encode("utf-8", "replace") for t in texts]
        if not self.whole:
            return self._by_words(raw)
        coded = [c.ids for c in self.tokenizer.encode_batch_fast([t.decode() for t in raw], add_special_tokens=False)]
        return np.array([i for ids in coded for i in ids], np.int32), np.array([len(ids) for ids in coded], np.int64)


def _byte_signs() -> str:
    """The signs by which byte-level tokenizers write bytes: itself if it is printed, else the next one from 256 on; a space stays."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printed]
    signs = {b: chr(256 + k) for k, b in enumerate(others)} | {32: " "}
    return "".join(signs.get(b, chr(b)) for b in range(256))


_SIGNS = _byte_signs()


def _marked_ends(tokenizer) -> tuple[object | None, np.ndarray]:
    """A tokenizer of the same model that splits at spaces only, and which ids end a piece; None
    if the model does not mark ends or does not know all signs."""
    from tokenizers import Tokenizer, pre_tokenizers

    vocab, suffix = tokenizer.get_vocab(with_added_tokens=False), getattr(tokenizer.model, "end_of_word_suffix", None)
    ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
    if not suffix or any(c not in vocab or c + suffix not in vocab for c in _SIGNS if c != " "):
        return None, ends
    ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
    pieces = Tokenizer(tokenizer.model)
    pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    return pieces, ends


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which keeps its words from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` behind those of each text, and where texts begin and end."""
    bounds = _lengths_to_bounds(sizes + 1)
    out = np.full(bounds[-1], end_id, np.int32)
    out[_spread(bounds[:-1], sizes)] = ids
    return out, bounds


_ROWS = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in ranges of ascending id with their token ids.

    A missing text counts as empty: only ``end_id``. A missing document id comes first.
    Documents that share an id stay in an order given by their texts. Other columns are left out.
    """
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, at = TaskContext.get().partitionId(), 0
        own = encoder(tokenizer)
        for batch in text_portions(batches, "text", PORTION):
            ids, bounds = _with_end(*own.encode(batch.column("text").cast(pa.binary()).to_pylist()), end_id)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
            parts = pa.array(np.full(len(batch), part, np.int32))
            yield pa.RecordBatch.from_arrays([parts, pa.array(at + bounds[:-1]), batch.column("doc_id"), lists], schema=_ROWS)
            at += int(bounds[-1])

    return ordered.mapInArrow(lean(encode), "part int, at long, doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, **names: str) -> None:
    """Write the token ids of ``docs`` to ORC files under ``path``."""
    (
        encode_documents(docs, tokenizer, end_id, **names)
        .write.option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .option("orc.stripe.size", str(64 << 20))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; bounds on the document id and listed ids reach the ORC reader."""
    rows = spark.read.schema("part int, at long, doc_id long, ids array<int>").orc(path)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return rows.filter(F.col("doc_id").isin(ids)) if ids is not None else rows


_DIGESTS = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, bounds = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B"), lists.offsets.to_numpy().astype(np.int64)
        sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        columns = [batch.column(c) for c in ("part", "at", "doc_id")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], schema=_DIGESTS)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    digests = read_tokens(spark, path).mapInArrow(lean(_digested), "part int, at long, doc_id long, n_tokens long, ids_crc32 long")
    digests = keep(digests, "digests")
    # one row per range
    sizes = digests.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return digests.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
