"""What the command line prints, as columns of whole tables: payloads of encoded rows, entries of asked words, found rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from . import lexicon

SYNONYMS = 10


def payload(encoded: DataFrame) -> Column:
    """JSON of an encoded row: sequence, bytes, tokens, unknown words; of code also counts and their share, rounded to three places, and its language if there."""
    t = F.col("tokens")
    shown = F.transform(t, lambda x: F.struct(x["word"].alias("word"), codec.address_text(x["addr"]).alias("address"), codec.shade_hex(x["shade"]).alias("shade")))
    parts = [codec.to_text(t).alias("sequence"), codec.byte_size(t).alias("byte_size"), shown.alias("tokens"), "unknowns"]
    if "structural_count" in encoded.columns:
        parts += [*(["language"] if "language" in encoded.columns else []), "structural_count", "semantic_count", F.round("structural_density", 3).alias("structural_density")]
    return F.to_json(F.struct(*parts))


def form(encoded: DataFrame, name: str, *, code_mode: bool = False) -> Column:
    """An encoded row in a form by name: text, hex or json."""
    t = F.col("tokens")
    return {"text": lambda: codec.to_text(t), "hex": lambda: F.hex(codec.to_binary(t, code_mode=code_mode)), "json": lambda: payload(encoded)}[name]()


def entries(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, found, entry) of the distinct words (word) that aren't null: entry is JSON of the text entry that a word or a form of it has.

    It has the address and its parts, the shade of the word as such, and the first SYNONYMS other words of the address by name. Distinct words meet the
    dictionary, and only the addresses that they have meet it again.
    """
    asked = words.select("word").where("word is not null").distinct()
    own = dictionary.where("kind = 'text'")
    side = lexicon.with_variants(own).select("key", F.struct(F.col("word").alias("entry_word"), "addr", "polarity", "formality", "intensity").alias("e"))
    rows = asked.join(lexicon.joinable(dictionary, side), F.lower("word") == F.col("key"), "left").drop("key")
    reached = rows.where("e is not null").select(F.col("e.addr").alias("addr")).distinct()
    ranked = own.join(reached, "addr", "left_semi").select("addr", "word", F.row_number().over(Window.partitionBy("addr").orderBy("word")).alias("rank"))
    alike = ranked.where(F.col("rank") <= SYNONYMS + 1).groupBy("addr").agg(F.array_sort(F.collect_list("word")).alias("alike"))  # one more, as the word is one of them
    a = F.col("e.addr")
    found = rows.join(alike, F.col("e.addr") == F.col("addr"), "left")
    shade = codec.word_shade(F.col("e.entry_word"), F.col("e.polarity"), F.col("e.formality"), F.col("e.intensity"))
    others = F.slice(F.filter("alike", lambda w: w != F.col("e.entry_word")), 1, SYNONYMS)
    entry = F.struct(F.lit(True).alias("found"), F.col("word").alias("token"), codec.address_text(a).alias("address"), codec.domain_code(a).alias("domain"), codec.category_of(a).alias("category"), codec.concept_of(a).alias("concept"), codec.shade_hex(shade).alias("shade"), others.alias("synonyms"))
    missing = F.struct(F.lit(False).alias("found"), F.col("word").alias("token"))
    is_found = F.col("e").isNotNull()
    return found.select("word", is_found.alias("found"), F.when(is_found, F.to_json(entry)).otherwise(F.to_json(missing)).alias("entry"))


def found_line() -> Column:
    """JSON of a row that a search found (id, score, content), the score rounded to four places."""
    return F.to_json(F.struct("id", F.round("score", 4).alias("score"), "content"))
