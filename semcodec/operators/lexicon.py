"""The dictionary: rows (kind, word, addr, polarity, formality, intensity, synset, related) and what is looked up in it.

kind is text or code. Dictionaries are DataFrames, so one of hundreds of thousands of words is joined as it fits: broadcast
where its row count is checked to be small, else by Catalyst's choice.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, text
from ..functions.constants import DOMAINS
from ..plans import shared
from ..plans.shared import workers_see_package
from . import packed

#: Bytes up to which a dictionary is broadcast: of its strings, and 40 for each row and each relation.
BROADCAST_BYTES = 64 << 20
RELATED = "array<struct<addr:int,weight:int,type:string,direction:int>>"
COLUMNS = ["kind", "word", "addr", "polarity", "formality", "intensity", "synset", "related"]

# --- fixed values: a small vocabulary for trials and tests, as kind, domain, category, concept, words; a full one is a parameter -----------
SAMPLE = """
text EM 0 0 happy joyful cheerful glad
text EM 0 1 sad unhappy sorrowful mournful
text EM 1 0 love adore cherish
text AC 0 0 walk stroll stride
text AC 0 1 run sprint dash jog
text AC 0 9 return
text AC 4 4 write compose
text AC 5 9 open unlock
text AC 6 0 see view observe
text AC 7 0 search seek hunt
text AC 7 4 fetch retrieve
text AC 8 4 combine merge blend
text OB 0 0 house home dwelling
text OB 0 1 building structure edifice
text OB 1 0 car automobile auto
text OB 8 4 hat cap
text OB 9 0 box crate
text OB 9 5 plate dish
text QU 0 0 big large huge enormous
text QU 0 1 small little tiny minute
text QU 0 2 tall high
text QU 0 3 short low
text QU 0 7 medium average
text QU 1 0 fast quick rapid swift
text QU 1 1 slow sluggish
text QU 2 0 good fine nice
text QU 2 1 bad poor awful terrible
text QU 4 0 old aged elderly
text QU 4 2 new fresh novel
text QU 5 0 hot scorching
text QU 5 1 cold chilly freezing
text NA 0 0 dog canine puppy hound
text NA 0 1 cat feline kitten
text NA 5 0 tree
text NA 7 0 water
text PE 3 0 doctor physician
text PE 3 4 patient
text TC 0 6 function
text TC 3 0 data information
text TC 3 1 file
text CM 0 8 name
text SN 0 0 red crimson scarlet
text SN 1 0 blue azure navy
text SN 6 10 click tap
text EC 0 0 economy economic economics
text EC 1 1 buy purchase acquire
text EC 1 2 sell vend
text EC 2 1 value worth
code CF 1 0 if when
code CF 2 0 for foreach
code CF 2 1 while until
code CF 2 3 loop iterate iteration
code CF 4 2 return
code DS 0 0 int integer long short
code DS 0 2 string str text char
code DS 1 1 list linkedlist
code DS 2 0 map dict dictionary
code DS 2 1 set
code DS 3 0 tree
code DS 4 3 node vertex
code DS 5 6 class
code TS 2 2 parse
code OP 5 3 sort
code OP 5 4 find search
code OP 5 12 merge
code IO 0 0 read readfile
code IO 0 1 write writefile
code IO 0 8 open
code IO 1 5 fetch
code IO 1 6 request
code IO 1 7 response
code IO 3 3 error
code MD 0 0 function fn func def
code MD 1 0 import
code TE 0 0 test
code AP 1 6 login
"""


def seed_rows(table: str) -> list[tuple[str, str, int, int]]:
    """(kind, word, addr, order) of a table of lines; a (kind, domain, category, concept) may stand once."""
    seen, out = set(), []
    for line in filter(None, map(str.strip, table.splitlines())):
        kind, domain, category, concept, *words = line.split()
        place = (kind, DOMAINS[domain][0] << 16 | int(category) << 8 | int(concept))
        if place in seen:
            raise ValueError(f"twice: {line}")
        seen.add(place)
        out += [(kind, w, place[1], len(out) + k) for k, w in enumerate(words)]
    return out


def from_seeds(spark: SparkSession, rows: list[tuple[str, str, int, int]]) -> DataFrame:
    """A dictionary of seeds; of a word that stands several times in one kind the first place stays."""
    seeds = spark.createDataFrame(rows, "kind string, word string, addr int, seq int")
    first = seeds.groupBy("kind", "word").agg(F.min_by("addr", "seq").alias("addr"))
    hint = F.when(F.col("kind") == "code", F.lit(2)).otherwise(F.lit(1))
    return first.select("kind", "word", "addr", F.lit(1).alias("polarity"), hint.alias("formality"), F.lit(1).alias("intensity"), F.lit("").alias("synset"), F.expr(f"cast(array() as {RELATED})").alias("related"))


_SAMPLES: WeakKeyDictionary = WeakKeyDictionary()
_PREPARED: WeakKeyDictionary = WeakKeyDictionary()


def sample(spark: SparkSession) -> DataFrame:
    """The sample dictionary, one DataFrame for each session."""
    if spark not in _SAMPLES:
        _SAMPLES[spark] = from_seeds(spark, seed_rows(SAMPLE))
    return _SAMPLES[spark]


def prepared(dictionary: DataFrame) -> DataFrame:
    """with_variants() of a dictionary, persisted and worked out once for each DataFrame."""
    if dictionary not in _PREPARED:
        _PREPARED[dictionary] = with_variants(dictionary).persist()
    return _PREPARED[dictionary]


def overlay(base: DataFrame, *extensions: DataFrame) -> DataFrame:
    """base with extensions over it: for one (kind, word) the last dictionary's entry stays; extensions' words are lower-cased."""
    layers = [base.withColumn("_layer", F.lit(0))] + [e.withColumn("word", F.lower("word")).withColumn("_layer", F.lit(k + 1)) for k, e in enumerate(extensions)]
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    rest = [c for c in base.columns if c not in ("kind", "word")]
    best = out.groupBy("kind", "word").agg(F.max_by(F.struct(*rest), "_layer").alias("e"))
    return best.select("kind", "word", *[f"e.{c}" for c in rest]).select(*base.columns)


def part_of_speech(addr: Column) -> Column:
    """A guess from the domain: v for actions and movement, a for qualities, emotions and senses, n else."""
    code = codec.domain_code(addr)
    return F.when(code.isin("AC", "MV"), "v").when(code.isin("QU", "EM", "SN"), "a").otherwise("n")


def with_variants(dictionary: DataFrame) -> DataFrame:
    """Rows (kind, key, ...): the words, and the regular inflections of text words that aren't words themselves.

    `word` is the base. Of several bases of one inflection the alphabetically first stays.
    """
    own = dictionary.withColumn("key", F.col("word")).withColumn("_rank", F.lit(0))
    forms = text.variants(F.col("word"), part_of_speech(F.col("addr")))
    nouns = F.filter(F.array(text.plural(F.col("word"))), lambda w: w.isNotNull() & ~text.looks_inflected(F.col("word")))
    more = dictionary.where("kind = 'text'").withColumn("key", F.explode(F.array_distinct(F.concat(forms, nouns)))).withColumn("_rank", F.lit(1))
    every = own.unionByName(more)
    rest = [c for c in dictionary.columns if c != "kind"]
    best = every.groupBy("kind", "key").agg(F.min_by(F.struct(*rest), F.struct("_rank", "word")).alias("e"))
    return best.select("kind", "key", *[f"e.{c}" for c in rest])


_BYTES: WeakKeyDictionary = WeakKeyDictionary()
_SENT: WeakKeyDictionary = WeakKeyDictionary()


def size_of(dictionary: DataFrame) -> int:
    """Bytes of a dictionary's strings, and 40 for each row and each relation; counted once for each DataFrame."""
    if dictionary not in _BYTES:
        size = F.lit(40) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in dictionary.columns if c in ("word", "key", "synset")), F.lit(0))
        if "related" in dictionary.columns:
            size = size + 40 * F.greatest(F.size("related"), F.lit(0))
        _BYTES[dictionary] = dictionary.agg(F.sum(size)).first()[0] or 0
    return _BYTES[dictionary]


def joinable(dictionary: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """part, or all, of a dictionary, with a broadcast hint where the dictionary's bytes are few."""
    part = dictionary if part is None else part
    return F.broadcast(part) if size_of(dictionary) <= BROADCAST_BYTES else part


def sent(dictionary: DataFrame):
    """The dictionary and its variants as a packed table on the executors, sent once for each DataFrame; None if its bytes aren't few."""
    if dictionary not in _SENT:
        table = shared.written(with_variants(dictionary))
        workers_see_package(dictionary.sparkSession)
        few = size_of(table) <= BROADCAST_BYTES
        _SENT[dictionary] = dictionary.sparkSession.sparkContext.broadcast(packed.pack(table)) if few else None
    return _SENT[dictionary]


#: Bits of the map of a dictionary's hashed keys: for each key, and at most (32 MB).
KEY_BITS, KEY_BITS_MOST = 32, 1 << 28


def key_filter(table: DataFrame):
    """Of the text keys of with_variants(): (slot, passes), where passes(array of slot(word)) tells of each word whether it may be a key; a key always passes."""
    keys = table.where("kind = 'text'")
    bits = min(1 << max(15, (KEY_BITS * keys.count()).bit_length()), KEY_BITS_MOST)
    slot = lambda word: F.pmod(F.xxhash64(word), F.lit(bits)).cast("int")
    at = keys.select((slot("key") + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    flags = np.zeros(bits // 8, np.uint8)
    for bucket, own in zip(parts.column("bucket").to_pylist(), parts.column("bits").to_pylist()):
        flags[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(own, np.uint8)
    held = table.sparkSession.sparkContext.broadcast(flags)

    def passes(slots: pa.Array) -> pa.Array:
        flat, begins = packed.flat_lists(slots)
        here = flat.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(held.value[here >> 3] >> (here & 7).astype(np.uint8) & 1 == 1))

    workers_see_package(table.sparkSession)
    return slot, F.arrow_udf(passes, "array<boolean>")


def looked_up(rows: DataFrame, column: str, dictionary: DataFrame, mode: str = "text") -> DataFrame:
    """rows with addr (null where the word isn't found): mode text, code, or auto (code first, then text)."""
    kinds = {"text": ["text"], "code": ["code"], "auto": ["code", "text"]}[mode]
    for k, kind in enumerate(kinds):
        side = joinable(dictionary, dictionary.where(F.col("kind") == kind).select(F.col("word").alias(f"_w{k}"), F.col("addr").alias(f"_a{k}")))
        rows = rows.join(side, F.lower(column) == F.col(f"_w{k}"), "left").drop(f"_w{k}")
    found = F.coalesce(*[F.col(f"_a{k}") for k in range(len(kinds))])
    return rows.withColumn("addr", found).drop(*[f"_a{k}" for k in range(len(kinds))])


def contains(rows: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """rows whose word is a text word of the dictionary."""
    own = dictionary.where("kind = 'text'")
    return rows.join(joinable(dictionary, own.select(F.col("word").alias("_w"))), F.lower(column) == F.col("_w"), "left_semi")


def lemma_lookup(rows: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """rows with word and addr of the text word that theirs is, or else is an inflection of (text.lemma_candidates, the first that is a word); nulls for unknown words.

    Only distinct words are looked up.
    """
    asked = rows.select(F.lower(column).alias("_asked")).where("_asked is not null").distinct()
    tried = asked.select("_asked", F.posexplode(text.lemma_candidates(F.col("_asked"))).alias("_n", "_try"))
    own = dictionary.where("kind = 'text'")
    hits = tried.join(joinable(dictionary, own.select("word", "addr")), F.col("_try") == F.col("word")).groupBy("_asked").agg(F.min_by(F.struct("word", "addr"), "_n").alias("_e"))
    out = rows.join(hits, F.lower(column) == F.col("_asked"), "left")
    return out.select(*rows.columns, F.col("_e.word").alias("lemma"), F.col("_e.addr").alias("addr"))


def synonyms(dictionary: DataFrame, words: DataFrame) -> DataFrame:
    """(word, synonym): other text words at the address of each of words (word)."""
    own = dictionary.where("kind = 'text'").select("word", "addr")
    asked = words.select(F.lower("word").alias("word")).distinct().join(own, "word")
    return asked.join(own.withColumnRenamed("word", "synonym"), "addr").where("word <> synonym").select("word", "synonym")


def statistics(dictionary: DataFrame) -> DataFrame:
    """Entries, categories and concepts of each kind and domain, and the domain's share of its kind."""
    a = F.col("addr")
    out = dictionary.groupBy("kind", codec.domain_code(a).alias("domain")).agg(
        F.count("*").alias("entries"), F.countDistinct(codec.category_of(a)).alias("categories"), F.countDistinct(F.shiftright(a, 0)).alias("concepts")
    )
    return out.withColumn("share", F.col("entries") / F.sum("entries").over(Window.partitionBy("kind")))
