"""Spelling variants: words that one inserted, deleted or replaced letter tells apart, and the commonest form of each.

Full neighbourhood generation: every word of the vocabulary gives all distinct strings that one deletion, or one replacement or insertion of
a letter of the observed alphabet, makes of it; those are joined by hash with the vocabulary. What the join finds is near by construction, so no
distance is worked out; the string that a row stands for is put together and compared, so that equal hashes of different strings don't count.

A neighbour's hash follows from sums over the word's beginning and end (a polynomial hash), so a word of L letters and an alphabet of A
take about 2 L A steps, however long they are, and a neighbour is a row of fixed size (two hashes, place, letter). A bitmap of the vocabulary's
hashes, of bounded size, leaves out most neighbours that are no words before anything is shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import bitmap, drop, materialize, prepare_workers, text_parts

#: One occurrence in DROP (by a checksum) has a letter deleted before counting; code points and occurrences that a word needs;
#: how many times as common a word's form is.
DROP, LEAST_LETTERS, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Letters in Latin-1, A-Z lower-cased; all else is a blank.
LETTER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Words that a task holds before it sends their counts on.
HELD = 300_000
#: Bits of the bitmap for each word, and in all at most (32 MB).
BITS_EACH, BITS_MOST = 128, 1 << 28
#: Neighbours worked out at once, and letters of words for each task.
AT_ONCE, LETTERS = 1 << 20, 100_000
DELETED, REPLACED, INSERTED = 0, 1, 2


def document_words(doc_id: object, text: str) -> Counter:
    """Latin-1 words of a text of at least LEAST_LETTERS letters, some with a letter deleted, and how often they occur."""
    runs: Counter = Counter()
    for part in text_parts(text.encode("latin-1", "replace").translate(LETTER_BYTES)):
        runs.update(w for w in part.split() if len(w) >= LEAST_LETTERS)
    began = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out = runs
    for run, n in list(runs.items()):
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), began)
        if h % DROP == 0:
            at = h % len(run)
            out[run] -= n
            if len(run) > LEAST_LETTERS:
                out[run[:at] + run[at + 1 :]] += n
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        words = [w for w, n in held.items() if n]
        for lo in range(0, len(words), 1 << 15):
            part = words[lo : lo + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])
        held.clear()

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            held.update(document_words(doc_id, text.as_py() or ""))
            if len(held) > HELD:
                yield from rows()
    yield from rows()


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])


def _sums(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the letters before each place, from the word's first letter on (running over all words), each letter's place, and powers."""
    place = np.arange(len(buf)) - np.repeat(off[:-1], np.diff(off))
    up, _ = kernel._power_tables(int(np.diff(off).max(initial=0)) + 2)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(kernel._BYTE_CODE[buf] * up[place], out=sums[1:])
    return sums, place, up


def _final(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    return kernel.mix(sums + length.astype(np.uint64))


def hashes(words: list[bytes]) -> np.ndarray:
    buf, off = _letters(words)
    sums, _, _ = _sums(buf, off)
    return _final(sums[off[1:]] - sums[off[:-1]], np.diff(off))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [w.encode("latin-1") for w in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes(words).view(np.int64))], [*b.schema.names, "h"])


def neighbours(words: list[bytes], alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(word, hash, place, kind, letter) of all distinct strings one edit away from each word; some at a time.

    Of equal letters in a row only the first one is deleted, and a letter isn't inserted behind itself, so no string comes twice.
    """
    buf, off = _letters(words)
    sums, place, up = _sums(buf, off)
    word = np.repeat(np.arange(len(words)), np.diff(off))
    code, base, inverse = kernel._BYTE_CODE, np.uint64(kernel._BASE), np.uint64(kernel._BASE_INVERSE)
    before = sums[:-1] - sums[off[word]]
    behind = sums[off[word + 1]] - sums[1:]
    whole, length = before + behind + code[buf] * up[place], np.diff(off)[word]
    first = (place == 0) | (buf != np.concatenate([buf[:1], buf[:-1]]))
    yield word[first], _final(before + behind * inverse, length - 1)[first], place[first], np.full(first.sum(), DELETED, np.int8), np.zeros(first.sum(), np.uint8)
    # insertion before each letter and behind the last one: the latter are places of their own
    end_word = np.arange(len(words))
    end_place = np.diff(off)
    end_sum = sums[off[1:]] - sums[off[:-1]]
    last = buf[off[1:] - 1] if len(words) else buf
    step = max(1, AT_ONCE // max(1, len(alphabet)))
    for lo in range(0, len(buf), step):
        s = slice(lo, lo + step)
        keep = buf[s, None] != alphabet
        x, a = np.nonzero(keep)
        x += lo
        yield word[x], _final(whole[x] + (code[alphabet[a]] - code[buf[x]]) * up[place[x]], length[x]), place[x], np.full(len(x), REPLACED, np.int8), alphabet[a]
        left = np.where(place[s] > 0, buf[np.arange(lo, min(lo + step, len(buf))) - 1], 0)
        x, a = np.nonzero(left[:, None] != alphabet)
        x += lo
        yield word[x], _final(before[x] + code[alphabet[a]] * up[place[x]] + (whole[x] - before[x]) * base, length[x] + 1), place[x], np.full(len(x), INSERTED, np.int8), alphabet[a]
    for lo in range(0, len(words), step):
        s = slice(lo, lo + step)
        x, a = np.nonzero(last[s, None] != alphabet)
        x += lo
        yield end_word[x], _final(end_sum[x] + code[alphabet[a]] * up[end_place[x]], end_place[x] + 1), end_place[x], np.full(len(x), INSERTED, np.int8), alphabet[a]


def _known(alphabet: np.ndarray, table, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shift = table.value, np.uint64(64 - (bits.bit_length() - 1))
        for b in batches:
            own = b.column(1).to_numpy()
            for word, h, place, kind, letter in neighbours([w.encode("latin-1") for w in b.column(0).to_pylist()], alphabet):
                at = (h >> shift).astype(np.int64)
                some = np.flatnonzero(known[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                letters = pa.array([chr(c) if c else "" for c in letter[some].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(own[word[some]]), pa.array(h[some].view(np.int64)), pa.array(place[some].astype(np.int64)), pa.array(kind[some]), letters], ["h", "near_h", "at", "kind", "letter"])

    return run


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n, h) of the words of docs (doc_id, text) with at least `least` occurrences, and their hashes."""
    prepare_workers(docs.sparkSession)
    counts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least).mapInArrow(_hashed, "word string, n long, h long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all pairs of words (word, n, h) that are one edit apart, in both directions; words is read several times."""
    spark = words.sparkSession
    letters = sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())  # 90 at most
    alphabet = np.array([ord(c) for c in letters], np.uint8)
    n, total = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    bits = min(1 << max(15, (BITS_EACH * n).bit_length()), BITS_MOST)
    slot = F.shiftrightunsigned("h", 64 - (bits.bit_length() - 1)).cast("int")
    sent = spark.sparkContext.broadcast(bitmap(words.select(slot.alias("slot")), bits))
    dealt = words.select("word", "h").repartition(max(spark.sparkContext.defaultParallelism, total // LETTERS))
    found = dealt.mapInArrow(_known(alphabet, sent, bits), "h long, near_h long, at long, kind byte, letter string")
    near = found.join(words.select(F.col("h").alias("near_h"), F.col("word").alias("near"), F.col("n").alias("near_n")), "near_h").join(words, "h")
    meant = F.expr(f"concat(substring(word, 1, cast(at as int)), letter, substring(word, cast(at as int) + if(kind = {INSERTED}, 1, 2)))")
    return near.where(meant == F.col("near")).select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): where the forms end. A form is `TIMES` times as common as its word, so they have no circles and few steps, which are doubled."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = materialize(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("more")), "roots")
        drop(now)
        if new.where("more").isEmpty():
            return new.select("word", "root")
        now = new


def variants(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n, one row for each word.

    Runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where DROP divides the crc32 of `<doc_id>:<run>`, the run has the letter at that number modulo its length
    deleted. Words are the results with at least LEAST_LETTERS letters and `least` occurrences. form: of the words one edit away the commonest (the first in the
    order of code points among equals), if it is TIMES times as common as the word, else null. root: where the forms lead, the word itself without one.

    A null text has no words; a null doc_id is empty in the checksum. Repeated rows count each. Whole texts and words of any length are taken. An empty
    table gives an empty table; other columns are ignored.
    """
    words = materialize(vocabulary(docs, least), "words")
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    form_n = -F.col("best.n")
    near = materialize(near.select("word", "n_near", F.when(form_n >= TIMES * F.col("n"), F.struct(F.col("best.near").alias("form"), form_n.alias("n"))).alias("own")), "near")
    roots = _roots(near.where("own is not null").select("word", "own.form"))
    out = words.select("word", "n").join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", F.col("own.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("own.n").alias("form_n"))
