"""Source code to sequences: lexemes, keywords, identifiers, strings, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, text
from ..functions.constants import KEYWORDS
from . import lexicon
from . import packed
from .encode import encode, frame_entries


def _kind(t: Column) -> Column:
    """comment, string, number, identifier or mark, by the first of these that fits."""
    kind = F.when(t.rlike(r"^(#|//|/\*)") & (F.length(t) > F.when(t.startswith("#"), 0).otherwise(1)), "comment").when(t.rlike("""^["'](?s:.*)["']$""") & (F.length(t) > 1), "string")
    return kind.when(t.rlike("^[0-9]"), "number").when(t.rlike("^[A-Za-z_]"), "identifier").otherwise("mark")


def _tokens_of(source: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(text.LEXEME), F.lit(0))


def lexemes(sources: DataFrame, column: str = "source") -> DataFrame:
    """(…, pos, token, kind) of every row's lexemes."""
    return sources.select("*", F.posexplode(_tokens_of(F.col(column))).alias("pos", "token")).withColumn("kind", _kind(F.col("token")))


def _looked_up(rows: DataFrame, sent) -> DataFrame:
    """rows (id, source, language) -> (id, patterns, tokens, unknowns, structural, semantic), a row at a time in the packed dictionary."""
    kind = rows.schema["id"].dataType.simpleString()
    items = F.transform(_tokens_of(F.col("source")), lambda t, i: F.struct(i.alias("pos"), t.alias("token"), _kind(t).alias("kind")))
    split = rows.select("id", text.detect_patterns(F.col("source")).alias("patterns"), "language", items.alias("items"))

    def parts(x: Column) -> Column:
        keyword = text.is_keyword(x["token"], F.col("language"))
        own = F.when(keyword, F.array(x["token"])).otherwise(text.split_identifier(x["token"]))
        return F.transform(own, lambda w, i: F.struct(x["pos"].alias("pos"), i.alias("sub"), keyword.alias("keyword"), w.alias("part"), F.lower(w).alias("low")))

    def inner(x: Column) -> Column:
        return F.struct(x["pos"].alias("pos"), packed.lexemes(F.substring(x["token"], F.lit(2), F.length(x["token"]) - 2), True).alias("lexemes"))

    names = F.flatten(F.transform(F.filter("items", lambda x: x["kind"] == "identifier"), parts))
    strings = F.transform(F.filter("items", lambda x: x["kind"] == "string"), inner)
    found = split.select("id", "patterns", names.alias("names"), strings.alias("strings")).mapInArrow(packed.lookup_code(sent), f"id {kind}, patterns array<string>, names {packed.NAMES}, strings {packed.STRINGS}")

    def framed(s: Column) -> Column:
        own = F.concat(s["tokens"], frame_entries(F.transform(s["tokens"], lambda t: F.lower(t["word"]))).cast(f"array<{codec.TOKEN}>"))
        return F.transform(own, lambda t, i: F.struct(s["pos"].alias("pos"), i.alias("sub"), t.withField("pos", s["pos"]).alias("x")))

    missed = lambda s: F.transform(s["unknowns"], lambda u, i: F.struct(s["pos"].alias("pos"), i.alias("sub"), u.alias("x")))
    placed = lambda field: F.transform(F.filter("names", lambda n: n[field].isNotNull()), lambda n: F.struct(n["pos"].alias("pos"), n["sub"].alias("sub"), n[field].alias("x")))
    structural = F.size(F.filter("names", lambda n: n["token"].isNotNull() & n["keyword"]))
    ordered = lambda c: F.transform(F.array_sort(c, lambda a, b: F.coalesce(F.nullif(a["pos"] - b["pos"], F.lit(0)), a["sub"] - b["sub"])), lambda t: t["x"])
    tokens = ordered(F.concat(placed("token"), F.flatten(F.transform("strings", framed))))
    unknowns = ordered(F.concat(placed("unknown"), F.flatten(F.transform("strings", missed))))
    out = found.select("id", "patterns", tokens.alias("tokens"), unknowns.alias("unknowns"), structural.cast("long").alias("structural"))
    return out.withColumn("semantic", F.size("tokens").cast("long") - F.col("structural"))


def _by_join(sources: DataFrame, dictionary: DataFrame, id_column: str, column: str, language: str) -> DataFrame:
    """The same for a dictionary that isn't small, by joins; ids must be distinct."""
    lex = lexemes(sources.select(id_column, F.col(column).alias("_source"), F.col(language).alias("_language")), "_source").where(F.col("kind").isin("string", "identifier"))
    lex = lex.withColumn("keyword", (F.col("kind") == "identifier") & text.is_keyword(F.col("token"), F.col("_language")))
    table = lexicon.prepared(dictionary)
    code = lexicon.joinable(table, table.where("kind = 'code'").select(F.col("key").alias("_ck"), F.struct("word", "addr", "polarity", "formality", "intensity", "related").alias("_c")))
    plain = lexicon.joinable(table, table.where("kind = 'text'").select(F.col("key").alias("_tk"), F.struct("word", "addr", "polarity", "formality", "intensity", "related").alias("_t")))

    names = lex.where("kind = 'identifier'")
    parts = F.when(F.col("keyword"), F.array("token")).otherwise(text.split_identifier(F.col("token")))
    names = names.select(id_column, "pos", "keyword", F.posexplode(parts).alias("sub", "part"))
    names = names.join(code, F.lower("part") == F.col("_ck"), "left").join(plain, F.lower("part") == F.col("_tk"), "left").withColumn("e", F.coalesce("_c", "_t"))
    e = F.col("e")
    token = F.struct(
        F.col("pos").cast("int").alias("pos"), e["word"].alias("word"), e["addr"].alias("addr"), codec.word_shade(e["word"], e["polarity"], e["formality"], e["intensity"]).alias("shade"),
        F.when(F.col("keyword"), 2).otherwise(1).alias("role"), F.lit(0).alias("features"), e["related"].alias("related"),
    )
    names = names.select(id_column, "pos", "sub", "keyword", F.when(e.isNotNull(), token).alias("token"), F.when(e.isNull(), F.col("part")).alias("unknown"))

    strings = lex.where("kind = 'string'").select(F.struct(F.col(id_column).alias("id"), "pos").alias("_key"), F.expr("substring(token, 2, length(token) - 2)").alias("text"))
    inner = encode(strings, dictionary, "_key")
    known = inner.select(F.col("_key.id").alias(id_column), F.col("_key.pos").alias("pos"), F.posexplode("tokens").alias("sub", "token"))
    known = known.select(id_column, "pos", "sub", F.lit(False).alias("keyword"), F.col("token").withField("pos", F.col("pos").cast("int")).alias("token"), F.lit(None).cast("string").alias("unknown"))
    missed = inner.select(F.col("_key.id").alias(id_column), F.col("_key.pos").alias("pos"), F.posexplode("unknowns").alias("sub", "unknown"))
    missed = missed.select(id_column, "pos", "sub", F.lit(False).alias("keyword"), F.lit(None).cast(codec.TOKEN).alias("token"), "unknown")

    rows = names.unionByName(known).unionByName(missed)
    placed = lambda c: F.struct("pos", "sub", F.col(c).alias("x"))
    agg = rows.groupBy(id_column).agg(
        F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), placed("token")))).alias("tokens"),
        F.sort_array(F.collect_list(F.when(F.col("unknown").isNotNull(), placed("unknown")))).alias("unknowns"),
        F.count_if(F.col("token").isNotNull() & F.col("keyword")).alias("structural_count"),
        F.count_if(F.col("token").isNotNull() & ~F.col("keyword")).alias("semantic_count"),
    )
    out = sources.select(id_column, text.detect_patterns(F.col(column)).alias("patterns")).join(agg, id_column, "left")
    tokens = F.coalesce(F.transform("tokens", lambda t: t["x"]), F.expr(f"cast(array() as array<{codec.TOKEN}>)"))
    unknowns = F.coalesce(F.transform("unknowns", lambda u: u["x"]), F.expr("cast(array() as array<string>)"))
    counts = [F.coalesce(f"{c}_count", F.lit(0)).alias(c) for c in ("structural", "semantic")]
    return out.select(F.col(id_column).alias("id"), "patterns", tokens.alias("tokens"), unknowns.alias("unknowns"), *counts)


def encode_code(sources: DataFrame, dictionary: DataFrame, id_column: str = "doc_id", column: str = "source", language: str = "language") -> DataFrame:
    """(id, tokens, unknowns, structural_count, semantic_count, structural_density, patterns) for every row.

    Keywords are looked up as code and then as text words, parts of other identifiers likewise; what a string holds is encoded as
    text. Comments, numbers and marks are skipped; an unknown language has no keywords. Ids may be null or repeated, unless the dictionary is
    so large that it is joined.
    """
    sent = lexicon.sent(dictionary)
    if sent is None:
        out = _by_join(sources, dictionary, id_column, column, language)
    else:
        out = _looked_up(sources.select(F.col(id_column).alias("id"), F.col(column).alias("source"), F.col(language).alias("language")), sent)
    s, m = F.col("structural"), F.col("semantic")
    framed = F.concat("tokens", frame_entries(F.transform("tokens", lambda t: F.lower(t["word"]))).cast(f"array<{codec.TOKEN}>"))
    return out.select(
        F.col("id").alias(id_column), framed.alias("tokens"), "unknowns", s.alias("structural_count"), m.alias("semantic_count"), F.when(s + m > 0, s / (s + m)).otherwise(F.lit(0.0)).alias("structural_density"), "patterns",
    )


LANGUAGES = sorted(KEYWORDS)
