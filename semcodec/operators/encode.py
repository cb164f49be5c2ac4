"""Text to sequences: context scan, stop words, look-up, shades, frames.

A dictionary that is counted to be small is packed and sent to the executors, which look up a batch's words in place (packed): no row for a word, no
shuffle. For a larger one the words that may be in it, by a map of hashed keys, are exploded, joined with it, and put together again by a group-by; the
others stay with their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, text
from ..functions.constants import DOMAINS, FRAME_FEATURE, FRAME_ROLE, FRAME_SHADE, FRAMES
from ..plans import shared
from . import lexicon, packed


def frame_entries(words: Column, frames=FRAMES) -> Column:
    """Tokens of the frames of which every group has one of the words; of frames with one address the first."""
    rows, seen = [], set()
    for name, code, groups in frames:
        addr = DOMAINS[code[:2]][0] << 16 | int(code[2:-2], 16) << 8 | int(code[-2:], 16)
        if addr in seen:
            continue
        seen.add(addr)
        fits = [F.arrays_overlap(words, F.array(*map(F.lit, g.split()))) for g in groups]
        hit = fits[0]
        for f in fits[1:]:
            hit = hit & f
        rows.append(F.when(hit, F.struct(F.lit(-1).alias("pos"), F.lit(name).alias("word"), F.lit(addr).alias("addr"), F.lit(FRAME_SHADE).alias("shade"), F.lit(FRAME_ROLE).alias("role"), F.lit(FRAME_FEATURE).alias("features"), F.expr(f"cast(array() as {lexicon.RELATED})").alias("related"))))
    return F.array_compact(F.array(*rows))


def _told_apart(rows: DataFrame, dictionary: DataFrame, context: bool) -> DataFrame:
    """(_row, id, some, others) of rows (id, text): of each row's words but stop words, those that may be in the dictionary, and those that aren't for certain.

    A map of hashed keys, sent to the executors, tells them apart in place. pos counts stop words, at doesn't. others is a line of all words, with nothing
    between the blanks in the places of `some`.
    """
    if context:
        words = text.scan_context(F.col("text"))
    else:
        words = F.transform(text.tokenize(F.col("text"), drop_stop_words=False), lambda w: F.struct(w.alias("word"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("negated"), F.lit(False).alias("formal")))
    placed = F.transform(words, lambda t, i: F.struct(i.cast("int").alias("pos"), *[t[c].alias(c) for c in ("word", "level", "negated", "formal")]))
    slot, passes = lexicon.key_filter(dictionary)
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), "id", F.filter(placed, lambda t: ~text.is_stop_word(t["word"])).alias("w"))
    rows = rows.withColumn("w", F.transform("w", lambda t, i: t.withField("at", i.cast("int"))))
    rows = rows.withColumn("may", passes(F.transform("w", lambda t: slot(t["word"])))).withColumn("w", F.zip_with("w", "may", lambda t, may: F.struct(t.alias("t"), may.alias("may"))))
    some = F.transform(F.filter("w", lambda x: x["may"]), lambda x: x["t"])
    others = F.array_join(F.transform("w", lambda x: F.when(x["may"], "").otherwise(x["t"]["word"])), " ")
    return rows.select("_row", "id", some.alias("some"), others.alias("others"))


def _token_rows(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """words with the token of each (null for unknown words); dictionary as from with_variants()."""
    side = lexicon.joinable(dictionary, dictionary.where("kind = 'text'").select("key", F.struct("word", "addr", "polarity", "formality", "intensity", "related").alias("e")))
    rows = words.join(side, words["word"] == side["key"], "left")
    e = F.col("e")
    shade = codec.in_context(codec.word_shade(e["word"], e["polarity"], e["formality"], e["intensity"]), F.col("level"), F.col("negated"), F.col("formal"))
    token = F.struct(F.col("pos").cast("int").alias("pos"), e["word"].alias("word"), e["addr"].alias("addr"), shade.alias("shade"), codec.role_of(e["addr"]).alias("role"), F.lit(0).alias("features"), e["related"].alias("related"))
    return rows.select(*words.columns, F.when(e.isNotNull(), token).alias("token"))


def _by_join(rows: DataFrame, dictionary: DataFrame, context: bool) -> DataFrame:
    """(id, tokens, unknowns) of rows (id, text), each told apart by a number of its own; only words that may be in the dictionary become rows and are shuffled."""
    own = lexicon.prepared(dictionary)
    split = shared.written(_told_apart(rows, own, context))
    words = split.select("_row", F.explode("some").alias("t")).select("_row", "t.*")
    found = _token_rows(words, own).groupBy("_row").agg(
        F.sort_array(F.collect_list("token")).alias("tokens"),
        F.map_from_entries(F.collect_list(F.when(F.col("token").isNull(), F.struct("at", "word")))).alias("missed"),
    )
    line = F.split("others", " ")
    whole = F.transform(line, lambda w, i: F.when(w == "", F.col("missed")[i]).otherwise(w))
    unknowns = F.filter(F.when(F.size("missed") > 0, whole).otherwise(line), lambda w: w.isNotNull() & (w != ""))
    tokens = F.coalesce("tokens", F.expr(f"cast(array() as array<{codec.TOKEN}>)"))
    return split.select("_row", "id", "others").join(found, "_row", "left").select("id", tokens.alias("tokens"), unknowns.alias("unknowns"))


def encode(docs: DataFrame, dictionary: DataFrame, id_column: str = "doc_id", column: str = "text", *, context: bool = True) -> DataFrame:
    """(id, tokens, unknowns) for every row of docs; texts without words, and null ones, give empty arrays. Ids may be null or repeated: rows don't meet."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(column).cast("string").alias("text"))
    sent = lexicon.sent(dictionary)
    if sent is None:
        out = _by_join(rows, dictionary, context)
    else:
        kind = rows.schema["id"].dataType.simpleString()
        out = rows.select("id", packed.lexemes(F.col("text"), context).alias("lexemes")).mapInArrow(packed.lookup(sent, context), f"id {kind}, tokens array<{codec.TOKEN}>, unknowns array<string>")
    framed = F.concat(F.col("tokens"), frame_entries(F.transform("tokens", lambda t: F.lower(t["word"]))).cast(f"array<{codec.TOKEN}>"))
    return out.select(F.col("id").alias(id_column), framed.alias("tokens"), "unknowns")


def described(encoded: DataFrame) -> DataFrame:
    """encoded with byte_size, sequence_text and domains."""
    t = F.col("tokens")
    return encoded.withColumns({"byte_size": codec.byte_size(t), "sequence_text": codec.to_text(t), "domains": codec.domains(t)})
