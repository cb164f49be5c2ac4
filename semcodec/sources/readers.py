"""Readers for dictionaries, corpora, evaluation sets, graphs and vectors; all schemas are given, nothing is inferred."""

from __future__ import annotations

import ast
import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.constants import DOMAINS
from ..operators.align import Profile
from ..operators.lexicon import COLUMNS, RELATED, from_seeds, overlay
from ..plans import shared

_ENTRY = "struct<d:string,c:int,n:int,s:struct<p:int,f:int,i:int>,syn:string,rel:string,trel:string>"
_FILE = f"struct<entries:map<string,{_ENTRY}>,code_entries:map<string,{_ENTRY}>>"


def _related(raw: Column) -> Column:
    """Edges of [[TYPE, address, weight, direction?], ...] or [[address, weight, type?, direction?], ...]; others are skipped."""
    rows = F.from_json(raw, "array<array<string>>")
    aliases = [*codec.RELATIONS, *codec.RELATION_ALIASES]

    def edge(r: Column) -> Column:
        typed = F.upper(F.get(r, F.lit(0))).isin(*aliases)
        at = lambda k: F.when(typed, F.get(r, F.lit(k[0]))).otherwise(F.get(r, F.lit(k[1])))
        place = at((1, 0))
        listed = F.from_json(place, "array<string>")
        head = F.coalesce(codec.lookup_map({c: n for c, (n, _) in DOMAINS.items()})[F.upper(F.get(listed, F.lit(0)))], F.get(listed, F.lit(0)).try_cast("int"))
        addr = F.coalesce(F.when(place.startswith("["), codec.pack(head, F.get(listed, F.lit(1)).try_cast("int"), F.get(listed, F.lit(2)).try_cast("int"))), codec.address_from_text(place))
        weight = at((2, 1)).try_cast("int")
        return F.struct(addr.alias("addr"), codec.clamped_weight(weight).alias("weight"), codec.relation_type(at((0, 2))).alias("type"), codec.relation_direction(F.get(r, F.lit(3))).alias("direction"))

    good = F.filter(F.transform(F.coalesce(rows, F.expr("cast(array() as array<array<string>>)")), edge), lambda e: e["addr"].isNotNull() & e["weight"].isNotNull() & ~codec.is_null_address(e["addr"]))
    return good.cast(RELATED)


def dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file, or a folder of such, of entries and code_entries {word: {d, c, n, s, syn, rel or trel}}; unknown domains are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _FILE).alias("f"))
    parts = [raw.select(F.lit(kind).alias("kind"), F.explode(f"f.{name}").alias("word", "e")) for kind, name in (("text", "entries"), ("code", "code_entries"))]
    rows = parts[0].unionByName(parts[1])
    number = codec.lookup_map({c: n for c, (n, _) in DOMAINS.items()})[F.col("e.d")]
    out = rows.select(
        "kind", "word", codec.pack(number, F.col("e.c"), F.col("e.n")).alias("addr"), F.coalesce("e.s.p", F.lit(1)).alias("polarity"), F.coalesce("e.s.f", F.lit(1)).alias("formality"),
        F.coalesce("e.s.i", F.lit(1)).alias("intensity"), F.coalesce("e.syn", F.lit("")).alias("synset"), _related(F.coalesce("e.trel", "e.rel")).alias("related"),
    )
    return out.where("addr is not null").select(*COLUMNS)


def dictionaries(spark: SparkSession, base: str, extensions: list[str]) -> DataFrame:
    """A base dictionary with extension files over it, later ones first."""
    return overlay(dictionary_json(spark, base), *[dictionary_json(spark, e) for e in extensions])


#: Files of a dictionary folder: the base, what is patched over it, and extensions that are taken in the order of their names.
BASE_FILE, PATCH_FILE, EXTENSION_FILES = "codebook.json", "codebook.patches.json", "extensions/auto/*.json"


def default_dictionary(spark: SparkSession, folder: str, *, patches: bool = True) -> DataFrame:
    """The base of a dictionary folder, then its patches, then its extensions; what isn't there or isn't valid JSON adds nothing, but a base must be there."""
    folder = folder.rstrip("/")
    if not shared.exists(spark, f"{folder}/{BASE_FILE}"):
        raise FileNotFoundError(f"{folder}/{BASE_FILE}")
    more = [f"{folder}/{PATCH_FILE}"] if patches and shared.exists(spark, f"{folder}/{PATCH_FILE}") else []
    return overlay(dictionary_json(spark, f"{folder}/{BASE_FILE}"), *[dictionary_json(spark, f) for f in [*more, *shared.listed(spark, f"{folder}/{EXTENSION_FILES}")]])


def seed_files(spark: SparkSession, text_files: list[tuple[str, str]], code_files: list[tuple[str, str]]) -> DataFrame:
    """A dictionary of seed files, as (domain, path) in order of precedence: each has a list named SEEDS of (category, concept, [words]).

    The files are read as text through Spark and only literals in them are evaluated.
    """
    rows: list[tuple[str, str, int, int]] = []
    for kind, files in (("text", text_files), ("code", code_files)):
        for domain, path in files:
            body = spark.read.text(path, wholetext=True).first()[0]
            seeds = next(ast.literal_eval(n.value) for n in ast.parse(body).body if isinstance(n, (ast.Assign, ast.AnnAssign)) and n.value is not None and "SEEDS" in ast.dump(n))
            seen = set()
            for category, concept, words in seeds:
                if (category, concept) in seen:
                    raise ValueError(f"{domain} {category} {concept} stands twice")
                seen.add((category, concept))
                rows += [(kind, w, DOMAINS[domain][0] << 16 | category << 8 | concept, len(rows) + k) for k, w in enumerate(words)]
    return from_seeds(spark, rows)


def adapter_files(spark: SparkSession, path: str) -> tuple[dict[str, Profile], list[tuple[str, str, list[str]]]]:
    """Profiles by name, and frames, of a folder of adapter files in the order of their names; settings, not data."""
    profiles, frames = {}, []
    files = sorted(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), "value").collect(), key=lambda r: PurePosixPath(r["f"]).name)
    for row in files:
        raw = json.loads(row["value"])
        if p := raw.get("profile"):
            name = raw.get("name", PurePosixPath(row["f"]).stem)
            scale = {codec.RELATION_ALIASES.get(k, k): float(v) for k, v in p.get("relation_scale", {}).items()}
            profiles[name] = Profile(p.get("antonym_penalty", 0.15), p.get("query_coverage", False), p.get("symmetric_coverage", False), p.get("lexical_weight", 0.0), p.get("relation_multiplier", 1.0), p.get("relation_hierarchy_weight", 0.0), scale)
        frames += [(f["name"], f["codon"], [" ".join(w.lower() for w in g) for g in f["groups"]]) for f in raw.get("frames", [])]
    return profiles, frames


def corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, content) of a file of JSON lines; blank lines are skipped."""
    return spark.read.schema("id string, content string").json(path).where("id is not null or content is not null")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def word_pairs(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(a, b, gold) of separated lines; comments (#), short lines and lines without a number are skipped."""
    raw = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", separator).alias("c"))
    gold = F.trim(F.get("c", F.lit(2))).try_cast("double")
    return raw.select(F.trim(F.get("c", F.lit(0))).alias("a"), F.trim(F.get("c", F.lit(1))).alias("b"), gold.alias("gold")).where("gold is not null")


def sentence_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, gold) of lines gold, a, b."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    return raw.select(F.get("c", F.lit(1)).alias("a"), F.get("c", F.lit(2)).alias("b"), F.trim(F.get("c", F.lit(0))).try_cast("double").alias("gold")).where("gold is not null and b is not null")


def relatedness_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, gold) of lines pair_id, a, b, relatedness, ... below a header."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    return raw.select(F.get("c", F.lit(1)).alias("a"), F.get("c", F.lit(2)).alias("b"), F.trim(F.get("c", F.lit(3))).try_cast("double").alias("gold")).where("gold is not null")


def clone_corpus(spark: SparkSession, functions: str, pairs: str, *, least: int = 200, most: int = 1500, first: int | None = None) -> DataFrame:
    """(id_a, id_b, label, source_a, source_b) of labelled pairs whose functions both have `least` to `most` characters.

    first: so many pairs of each label at most, in the order of the file.
    """
    f = spark.read.schema("idx string, func string").json(functions).where(F.length("func").between(least, most))
    p = spark.read.schema("id_a string, id_b string, label int").csv(pairs, sep="\t").withColumn("_line", F.monotonically_increasing_id())
    out = p.join(f.select(F.col("idx").alias("id_a"), F.col("func").alias("source_a")), "id_a").join(f.select(F.col("idx").alias("id_b"), F.col("func").alias("source_b")), "id_b")
    if first is not None:
        out = out.where("label = 1").orderBy("_line").limit(first).union(out.where("label = 0").orderBy("_line").limit(first))
    return out.select("id_a", "id_b", "label", "source_a", "source_b")


def balanced_pairs(pairs: DataFrame, n: int = 1500, seed: int = 0) -> DataFrame:
    """n pairs (id_a, id_b, label) at most, half of them of each label, in an order shuffled by seed: a hash, so the choice doesn't depend on partitions."""
    shuffled = F.xxhash64(F.lit(seed), "id_a", "id_b")
    half = lambda label: pairs.where(F.col("label") == label).orderBy(shuffled, "id_a", "id_b").limit(n // 2)
    return half(1).union(half(0)).orderBy(F.xxhash64(F.lit(seed + 1), "id_a", "id_b"), "id_a", "id_b")


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows (file, start, at, ...) with name: the sum of value over the rows before it in its file; within a split by its order, and over splits by a row for each."""
    own = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("file", "start").agg(F.sum(value).alias("_n")).select("file", "start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    return rows.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0))).join(starts, ["file", "start"]).withColumn(name, F.col(name) + F.col("_first")).drop("_first")


def _pieces(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, start, at, value): the lines, or other pieces, of files with their split and their order in it, written so that the order stays."""
    rows = spark.read.options(**options).text(path)
    return shared.written(rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")))


def json_array(spark: SparkSession, path: str, schema: str, n: int | None = None) -> DataFrame:
    """(file, j, r) of files that are each one JSON array of objects, the first n of each: the object's place from 0 and the object; a file is read in splits.

    Pieces end at a closing brace. Whether one is in a string follows from the quotes before it, which objects it closes from the braces outside of strings; both
    are sums over the pieces before. So only an object's own pieces meet in a row. Objects within objects are part of them; what isn't valid is null.
    """
    body = F.regexp_replace("value", r"(?s)\\.", "")  # no escape goes over a piece's end
    odd = F.pmod(F.length(body) - F.length(F.replace(body, F.lit('"'), F.lit(""))), F.lit(2))
    rows = _before(_pieces(spark, path, lineSep="}").withColumn("odd", odd), F.col("odd"), "quotes")
    within = F.pmod("quotes", F.lit(2)) == 1
    outside = F.regexp_replace(F.concat(F.when(within, '"').otherwise(""), body), r'(?s)"[^"]*("|$)', "")
    opened = F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))
    closes = (F.pmod(F.col("quotes") + F.col("odd"), F.lit(2)) == 0).cast("int")
    rows = _before(rows.withColumn("opened", opened).withColumn("closes", closes), F.col("opened") - F.col("closes"), "depth")
    ends = (F.col("closes") == 1) & (F.col("depth") + F.col("opened") == 1)
    rows = _before(rows.withColumn("ends", ends.cast("int")), F.col("ends"), "j").select("file", "j", "start", "at", "value", "ends")
    rows = rows if n is None else rows.where(F.col("j") < n)
    whole = rows.groupBy("file", "j").agg(F.array_sort(F.collect_list(F.struct("start", "at", "value"))).alias("p"), F.max("ends").alias("whole")).where("whole = 1")
    text = F.concat(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["value"]), "}"), r"^[\s,\[\x{FEFF}]+", ""), F.lit("}"))
    return whole.select("file", "j", F.from_json(text, schema).alias("r"))


def code_search_records(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(j, doc, code) of a JSON array of objects, the first n of it."""
    return json_array(spark, path, "doc string, code string", n).select("j", "r.doc", "r.code")


def assertions(spark: SparkSession, path: str) -> DataFrame:
    """(rel, src, tgt, weight) of lines uri, rel, src, tgt, JSON; weight is 1 where the JSON has none. Compressed files are read as they are."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 5)
    weight = F.get_json_object(F.get("c", F.lit(4)), "$.weight").try_cast("double")
    return raw.select(F.get("c", F.lit(1)).alias("rel"), F.get("c", F.lit(2)).alias("src"), F.get("c", F.lit(3)).alias("tgt"), F.coalesce(weight, F.lit(1.0)).alias("weight"))


def vector_text(spark: SparkSession, path: str, words: DataFrame | None = None) -> DataFrame:
    """(word, embedding) of lines word x1 x2 ...; the header, bad lines and zero vectors are dropped; of words (word) only, if given."""
    raw = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("c")).where(F.size("c") > 2)
    word = F.replace(F.regexp_replace(F.get("c", F.lit(0)), "^/c/en/", ""), F.lit("_"), F.lit(" "))
    out = raw.select(word.alias("word"), F.transform(F.slice("c", F.lit(2), F.size("c")), lambda x: x.try_cast("double")).alias("embedding"))
    out = out.where(~F.exists("embedding", lambda x: x.isNull()) & F.exists("embedding", lambda x: x != 0))
    return out if words is None else out.join(words.select("word").distinct(), "word", "left_semi")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) of a file's lines, numbered from 0, however many splits it is read in: a line's place within its split, and the lines of the splits before."""
    rows = _before(_pieces(spark, path), F.lit(1), "id")
    return rows.select(F.col("id").cast("int").alias("id"), "value")


def association_graph(spark: SparkSession, names: str, adjacency: str) -> tuple[DataFrame, DataFrame]:
    """names (id, word), where id is the line's number from 0, and adjacency (src, dst, weight)."""
    return numbered_lines(spark, names).select("id", F.col("value").alias("word")), spark.read.schema("src int, dst int, weight double").csv(adjacency, sep="\t")
