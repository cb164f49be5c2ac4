"""A dictionary packed for look-up inside batches of texts, so that no row is made for a word and nothing is shuffled.

The text words of a dictionary (with their variants) and the words that a text scan treats specially become one list of strings with numbers beside it;
it is sent to each executor once. A batch's words are found in it by hash, all at once, and the context of a word (a level, a negation or a formal marker
before it in its sentence) follows from running maxima over the places of such words. Only a dictionary whose bytes are counted to be few is packed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, text
from ..functions.constants import CONTEXT_WORD, FORMAL, INTENSITY, NEGATIONS, STOP_WORDS

MARKS = ".!?"
#: A word's shades by context: none or a level of 0 to 3, negated or not, formal or not.
_CONTEXTS = [(level, negated, formal) for level in (None, 0, 1, 2, 3) for negated in (False, True) for formal in (False, True)]


class Packed(NamedTuple):
    """words: what a text's words are looked up in; of each of them, and last of an unknown word: its entry (or -1), level (or -1) and whether it is a stop word,
    a negation, formal, a mark. code and code_entry: the same for words of code. base to related: by entry.
    """

    words: pa.Array
    entry: np.ndarray
    level: np.ndarray
    stop: np.ndarray
    negation: np.ndarray
    formal: np.ndarray
    mark: np.ndarray
    code: pa.Array
    code_entry: np.ndarray
    base: pa.Array
    addr: np.ndarray
    role: np.ndarray
    shades: np.ndarray
    related: pa.Array


def pack(table: DataFrame) -> Packed:
    """table: rows (kind, key, word, addr, ...) of lexicon.with_variants(), few enough for the driver."""
    shade = codec.word_shade(F.col("word"), F.col("polarity"), F.col("formality"), F.col("intensity"))
    shades = F.array(*[codec.in_context(shade, F.lit(level).cast("int"), F.lit(negated), F.lit(formal)) for level, negated, formal in _CONTEXTS])
    rows = table.select(F.col("kind") == "text", "key", "word", F.col("addr").cast("int").alias("addr"), codec.role_of(F.col("addr")).cast("int").alias("role"), shades.alias("shades"), "related").toArrow().rename_columns(["is_text", "key", "word", "addr", "role", "shades", "related"]).combine_chunks()
    column = lambda c: x.combine_chunks() if isinstance(x := rows.column(c), pa.ChunkedArray) else x
    every, is_text = column("key").cast(pa.string()).to_pylist(), column("is_text").to_pylist()
    keys, code = ([w for w, t in zip(every, is_text) if t == kind] for kind in (True, False))
    levels = {w: k for k, own in INTENSITY.items() for w in own}
    words = list(dict.fromkeys([*keys, *STOP_WORDS, *levels, *NEGATIONS, *FORMAL, *MARKS]))
    entry, code_entry = ({w: k for k, (w, t) in enumerate(zip(every, is_text)) if t == kind} for kind in (True, False))
    has = lambda own: np.array([*(w in own for w in words), False])
    number = lambda own: np.array([*(own.get(w, -1) for w in words), -1])
    flat = np.asarray(column("shades").flatten()).astype(np.int32).reshape(-1, len(_CONTEXTS))
    return Packed(
        pa.array(words, pa.string()), number(entry), number(levels), has(set(STOP_WORDS)), has(set(NEGATIONS)), has(set(FORMAL)), has(set(MARKS)), pa.array(code, pa.string()), np.array([*(code_entry[w] for w in code), -1]),
        column("word").cast(pa.string()), np.asarray(column("addr")), np.asarray(column("role")), flat, column("related"),
    )


def lexemes(column: Column, context: bool) -> Column:
    """What encoded() reads of a text: its words in order, with the marks that end sentences where context counts."""
    if not context:
        return text.tokenize(column, drop_stop_words=False)
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(f"{CONTEXT_WORD}|[{MARKS}]"), F.lit(0))


def _last(here: np.ndarray) -> np.ndarray:
    """At each place, the last place up to it where `here` holds, or -1."""
    return np.maximum.accumulate(np.where(here, np.arange(len(here)), -1))


def encoded(words: pa.Array, begins: np.ndarray, own: Packed, context: bool) -> tuple[pa.Array, pa.Array]:
    """Lists of tokens and of unknown words of rows of lexemes; words: all of them, begins: where each row's begin, and their number."""
    n = len(words)
    known = pc.index_in(words, value_set=own.words).fill_null(-1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    plain, level, negated, formal = np.ones(n, bool), np.full(n, -1), np.zeros(n, bool), np.zeros(n, bool)
    if context and n:
        raised, flips, mark = own.level[known] >= 0, own.negation[known], own.mark[known]
        flips &= ~raised
        plain = ~(raised | flips | mark)
        first = begins[row]
        done = np.concatenate([[-1], _last(plain | mark)[:-1]])  # the word or mark before
        at = _last(raised)
        level = np.where((at > done) & (at >= first), own.level[known[at]], -1)
        at = _last(flips)
        negated = (at > done) & (at >= first)
        at = _last(own.formal[known] & plain)
        formal = (at >= first) & (at > _last(mark))
    counted = np.concatenate([[0], np.cumsum(plain)])
    pos = counted[:-1] - counted[begins[row]]
    told = plain & ~own.stop[known]
    entry = own.entry[known]
    found, missed = told & (entry >= 0), told & (entry < 0)

    def lists(here: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(here)])[begins].astype(np.int32)), values)

    tokens = token_structs(own, entry[found], pos[found], (level[found] + 1) * 4 + negated[found] * 2 + formal[found])
    return lists(found, tokens), lists(missed, words.filter(pa.array(missed)))


def token_structs(own: Packed, entry: np.ndarray, pos: np.ndarray, context: np.ndarray, role: np.ndarray | None = None) -> pa.Array:
    """Tokens of entries in contexts; null where the entry is -1."""
    known, numbers = entry >= 0, lambda x: pa.array(x.astype(np.int32))
    at = np.where(known, entry, 0)
    take = pa.array(entry, mask=~known)
    by = lambda values: values[at] if len(values) else np.zeros(len(at), np.int32)
    shade = own.shades[at, context] if len(own.shades) else np.zeros(len(at), np.int32)
    columns = [numbers(pos), own.base.take(take), numbers(by(own.addr)), numbers(shade), numbers(by(own.role) if role is None else role), numbers(np.zeros(len(at))), own.related.take(take)]
    return pa.StructArray.from_arrays(columns, ["pos", "word", "addr", "shade", "role", "features", "related"], mask=pa.array(~known))


def flat_lists(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, end to end, and where each list begins."""
    begins = col.offsets.to_numpy().astype(np.int64)
    return col.flatten(), begins - begins[0]


def lookup(sent, context: bool):
    """For mapInArrow: rows (id, lexemes) to (id, tokens, unknowns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), *encoded(*flat_lists(part.column(1)), sent.value, context)], ["id", "tokens", "unknowns"])

    return run


NAMES = f"array<struct<pos:int,sub:int,keyword:boolean,token:{codec.TOKEN},unknown:string>>"
STRINGS = f"array<struct<pos:int,tokens:array<{codec.TOKEN}>,unknowns:array<string>>>"


def _names(names: pa.Array, own: Packed) -> pa.Array:
    """Parts of identifiers (pos, sub, keyword, part, low) with their tokens: words of code, else of text."""
    low = names.field("low")
    code = own.code_entry[pc.index_in(low, value_set=own.code).fill_null(-1).to_numpy(zero_copy_only=False)]
    plain = own.entry[pc.index_in(low, value_set=own.words).fill_null(-1).to_numpy(zero_copy_only=False)]
    entry = np.where(code >= 0, code, plain)
    keyword = np.asarray(names.field("keyword").fill_null(False))
    tokens = token_structs(own, entry, np.asarray(names.field("pos")), np.zeros(len(entry), np.int64), np.where(keyword, 2, 1))
    unknown = pc.if_else(pa.array(entry >= 0), pa.scalar(None, pa.string()), names.field("part"))
    return pa.StructArray.from_arrays([names.field("pos"), names.field("sub"), pa.array(keyword), tokens, unknown], ["pos", "sub", "keyword", "token", "unknown"])


def lookup_code(sent):
    """For mapInArrow: rows (id, patterns, names, strings) with names and strings looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                (names, of_names), (strings, of_strings) = (flat_lists(part.column(k)) for k in (2, 3))
                tokens, unknowns = encoded(*flat_lists(strings.field("lexemes")), sent.value, True)
                found = [_names(names, sent.value), pa.StructArray.from_arrays([strings.field("pos"), tokens, unknowns], ["pos", "tokens", "unknowns"])]
                columns = [pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), values) for begins, values in zip((of_names, of_strings), found)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["id", "patterns", "names", "strings"])

    return run
