"""Cutting texts into pieces of about n tokens that end with a sentence."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: white space of any script
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"


#: runs of words that are folded before their pieces are passed on
BLOCK = 512
#: what a sentence ends with
STOPS = (".", "\n")


def sentence_ends(tokens: list, decode: Callable[[list], str], known: dict | None = None) -> list[int]:
    """Places after tokens whose own text ends a sentence, in order; ``known`` remembers tokens.

    A token without text of its own ends what the token before it ends.
    """
    known = {} if known is None else known
    ends, ended = [], False
    for at, token in enumerate(tokens, 1):
        if token not in known:
            text = decode([token])
            known[token] = text.endswith(STOPS) if text else None
        ended = ended if known[token] is None else known[token]
        if ended:
            ends.append(at)
    return ends


def cut_points(size: int, ends: list[int], n: int) -> list[tuple[int, int]]:
    """Bounds of the pieces: the last sentence end in (0.9 n, 1.1 n], else exactly n tokens.

    ``ends`` is searched from both sides of a piece's reach, so the time is that of its length.
    """
    low, high = int(0.9 * n), int(1.1 * n)
    bounds, start = [], 0
    while start < size:
        last = bisect_right(ends, start + high)
        if last and ends[last - 1] > start + low:
            stop = ends[last - 1]
        else:
            # too short to look for an end: the rest is one piece
            stop = min(start + n, size) if size > start + low else size
        bounds.append((start, stop))
        start = stop
    return bounds


def chunk_text(df: DataFrame, text: str, n: int, mode: str = "all", tokenizer=None) -> DataFrame:
    """Cut column ``text``.

    ``all`` gives a row per piece (``chunk`` from 1, the piece in ``text``);
    ``first_last`` keeps one row with the first and last piece, or the whole if there is
    one. Tokens are the words between spaces unless a ``tokenizer`` is given, which has
    ``encode`` and ``decode`` and is sent to the tasks; a token's text must end alike alone
    and behind others. Either way a text takes time in proportion to its length.
    """
    if mode not in ("all", "first_last"):
        raise ValueError(mode)
    if tokenizer is None:
        return _by_words(df, text, n, mode)
    fields = list(df.schema.fields)
    schema = T.StructType([*fields, T.StructField("chunk", T.IntegerType())] if mode == "all" else fields)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}

        def pieces(value: str | None) -> list[str]:
            tokens = list(tokenizer.encode(value or ""))
            ends = sentence_ends(tokens, tokenizer.decode, known)
            return [tokenizer.decode(tokens[a:b]) for a, b in cut_points(len(tokens), ends, n)]

        for batch in batches:
            parts = batch[text].map(pieces)
            if mode == "all":
                rows = batch.assign(**{text: parts, "chunk": parts.map(lambda p: list(range(1, len(p) + 1)))})
                yield rows[parts.map(len) > 0].explode([text, "chunk"]).astype({"chunk": "int32"})
            else:
                yield batch.assign(**{text: parts.map(lambda p: " ".join(p[:1] + p[-1:] if len(p) > 1 else p))})

    return df.mapInPandas(cut, schema)


def _by_words(df: DataFrame, text: str, n: int, mode: str) -> DataFrame:
    """The same for words, as expressions in the row: a piece of words ends as its last word does.

    One pattern cuts the text into runs of a few words at most, each up to a sentence's end. A
    fold over the runs holds the open piece in two parts: up to its last sentence end, and what
    follows. So no step looks at more than a piece. A fold copies what it holds at each step, so
    finished pieces are passed on block by block.
    """
    low, high = int(0.9 * n), int(1.1 * n)
    most = max(1, min(64, n // 2))
    others = [F.col(c) for c in df.columns if c != text]
    spaced = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " "))
    run = rf"(?:[^ ]++(?<!\.) ){{0,{most - 1}}}+[^ ]++"
    blocks = df.select(*others, F.regexp_extract_all(spaced, F.lit(rf"(?:{run}(?: |$)){{1,{BLOCK}}}+"), F.lit(0)).alias("_blocks"))
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")
    joined = lambda *parts: F.concat_ws(" ", *parts)
    leading = lambda t, k: F.call_function("substring_index", t, F.lit(" "), k)

    def state(pieces: Column, head: Column, words: Column, tail: Column, more: Column) -> Column:
        names = ("pieces", "head", "words", "tail", "more")
        return F.struct(*[c.alias(x) for c, x in zip((pieces, head, words, tail, more), names, strict=True)])

    def opened(pieces: Column, text_: Column, words: Column, ends: Column) -> Column:
        """An open piece of one part, which ends a sentence or not."""
        zero = F.lit(0)
        return state(pieces, F.when(ends, text_), F.when(ends, words).otherwise(zero), F.when(~ends, text_), F.when(ends, zero).otherwise(words))

    def add(s: Column, r: Column) -> Column:
        words, ends = F.length(r) - F.length(F.replace(r, F.lit(" "), F.lit(""))) + 1, F.endswith(r, F.lit("."))
        total, all_words = s.words + s.more + words, joined(s.head, s.tail, r)
        longer = F.when(ends, opened(s.pieces, all_words, total, F.lit(True))).otherwise(state(s.pieces, s.head, s.words, joined(s.tail, r), s.more + words))
        at_end = opened(F.concat(s.pieces, F.array(s.head)), joined(s.tail, r), s.more + words, ends)
        cut = opened(F.concat(s.pieces, F.array(leading(all_words, F.lit(n)))), leading(all_words, n - total), total - n, ends)
        return F.when(total <= high, longer).when(s.words > low, at_end).otherwise(cut)

    def close(s: Column) -> Column:
        total, whole = s.words + s.more, joined(s.head, s.tail)
        rest = (
            F.when(total == 0, nothing)
            .when(s.words > low, F.array_compact(F.array(s.head, s.tail)))
            # too short to look for an end, or no end: n words and the rest
            .when((total <= low) | (total <= n), F.array(whole))
            .otherwise(F.array(leading(whole, F.lit(n)), leading(whole, n - total)))
        )
        return F.concat(s.pieces, rest)

    def add_block(s: Column, block: Column) -> Column:
        runs = F.regexp_extract_all(F.trim(block), F.lit(run), F.lit(0))
        own = F.aggregate(runs, state(nothing, s.head, s.words, s.tail, s.more), add)
        both = F.transform(F.array(own), lambda o: state(F.concat(s.pieces, o.pieces), o.head, o.words, o.tail, o.more))
        return F.get(both, 0)

    start = state(nothing, none, F.lit(0), none, F.lit(0))
    made = blocks.select(*others, F.aggregate("_blocks", start, add_block, close).alias("_pieces"))
    if mode == "all":
        # the outer form, as the optimizer would fold the text twice more to leave out rows without pieces
        rows = made.select(*others, F.posexplode_outer("_pieces").alias("_at", text)).filter(F.col("_at").isNotNull())
        return rows.select(*df.columns, (F.col("_at") + 1).alias("chunk"))
    both = F.concat_ws(" ", F.element_at("_pieces", 1), F.when(F.size("_pieces") > 1, F.element_at("_pieces", -1)))
    return made.select(*others, F.when(F.size("_pieces") > 0, both).otherwise("").alias(text)).select(*df.columns)
