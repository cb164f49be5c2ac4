"""Command line: encode, compare, inspect, search, build."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import codec, text
from .operators import align, code, encode, lexicon, reports, search
from .plans import layers, shared
from .sources import readers, writers


def _dictionary(spark: SparkSession, args: argparse.Namespace):
    return readers.dictionaries(spark, args.dictionary, args.extension) if args.dictionary else lexicon.sample(spark)


def _encoded(spark: SparkSession, args: argparse.Namespace, *texts: str):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if args.language:
        return code.encode_code(rows.withColumn("language", F.lit(args.language)), _dictionary(spark, args), column="text").withColumn("language", F.lit(args.language))
    return encode.encode(rows, _dictionary(spark, args))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="semcodec")
    parser.add_argument("--dictionary")
    parser.add_argument("--extension", action="append", default=[])
    parser.add_argument("--language")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("encode")
    p.add_argument("text", nargs="?")
    p.add_argument("--file")
    p.add_argument("--format", choices=["text", "hex", "json"], default="text")
    p.add_argument("--mode", choices=["text", "code", "auto"], default="text", help="auto: code where the file's name tells a language")
    p = sub.add_parser("compare")
    p.add_argument("a")
    p.add_argument("b")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--profile", default="auto")
    p = sub.add_parser("inspect")
    p.add_argument("word")
    p.add_argument("--json", action="store_true", help="the text entry with its synonyms")
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("--corpus", required=True)
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--threshold", type=float, default=0.0)
    p = sub.add_parser("build", help="a dictionary of seed files and layers; the layers are kept in a cache")
    p.add_argument("output")
    p.add_argument("--seeds", action="append", default=[], metavar="DOMAIN=FILE")
    p.add_argument("--code-seeds", action="append", default=[], metavar="DOMAIN=FILE")
    p.add_argument("--sentiment", help="lines of word, sense, positive, negative")
    p.add_argument("--frequencies", help="lines of word, frequency")
    p.add_argument("--irregular", help="lines of form, lemma")
    p.add_argument("--cache", help="the layers' folder; the shared folder if not given")
    p.add_argument("--invalidate", action="append", default=[], help="a layer to build anew, or all")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--keep-relations", help="a dictionary whose relations are kept")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("semcodec").getOrCreate()
    if args.command == "encode":
        body = readers.text_files(spark, args.file).first()["content"] if args.file else args.text
        if args.mode == "auto" and args.file:
            args.language = args.language or spark.range(1).select(text.language_of(F.lit(args.file))).first()[0]
        elif args.mode == "code":
            args.language = args.language or "python"
        rows = _encoded(spark, args, body or "")
        print(rows.select(reports.form(rows, args.format, code_mode=bool(args.language))).first()[0])
    elif args.command == "compare":
        rows = _encoded(spark, args, args.a, args.b)
        pair = rows.where("doc_id = 0").select(F.col("tokens").alias("tokens_a")).join(rows.where("doc_id = 1").select(F.col("tokens").alias("tokens_b")), how="cross")
        out = align.compare(pair, profile_name_=args.profile)
        print(out.select(align.explain(F.col("tokens_a"), F.col("tokens_b"), F.col("result")) if args.explain else F.format_string("%.4f", "result.score")).first()[0])
    elif args.command == "inspect" and args.json:
        row = reports.entries(spark.createDataFrame([(args.word,)], "word string"), _dictionary(spark, args)).first()
        print(row["entry"])
        return 0 if row["found"] else 1
    elif args.command == "inspect":
        rows = lexicon.with_variants(_dictionary(spark, args)).where(F.col("key") == args.word.lower()).select("kind", "word", codec.address_text(F.col("addr")).alias("address"), "polarity", "formality", "intensity").collect()
        for row in rows:
            print(*row, sep="\t")
        return 0 if rows else 1
    elif args.command == "search":
        corpus = readers.corpus_jsonl(spark, args.corpus).withColumn("doc_id", F.monotonically_increasing_id())
        index = search.build(encode.encode(corpus.select("doc_id", F.col("content").alias("text")), _dictionary(spark, args)), "doc_id").join(corpus, "doc_id")
        found = search.search(index, _encoded(spark, args, args.query), top_k=args.top, threshold=args.threshold)
        for row in found.select(reports.found_line()).collect():
            print(row[0])
    else:
        _build(spark, args)
    return 0


def _build(spark: SparkSession, args: argparse.Namespace) -> None:
    """Says of each layer whether it was built or found."""
    pairs = lambda given: [tuple(x.split("=", 1)) for x in given]
    seeds = readers.seed_files(spark, pairs(args.seeds), pairs(args.code_seeds)) if args.seeds or args.code_seeds else lexicon.sample(spark)
    table = lambda path, schema: spark.read.schema(schema).csv(path, sep="\t")
    sources = {}
    if args.sentiment:
        sources["sentiment"] = (table(args.sentiment, "word string, sense int, positive double, negative double"), layers.sentiment_layer)
    if args.frequencies:
        sources["formality"] = (table(args.frequencies, "word string, zipf double"), layers.formality_layer)
    cache = None if args.no_cache else layers.LayerCache(spark, args.cache or f"{shared.root(spark)}/semcodec-layers")
    build = layers.Build(cache, seeds, sources, tuple(args.invalidate))
    out = build.run(table(args.irregular, "word string, lemma string") if args.irregular else None)
    writers.dictionary_json(out, args.output, readers.dictionary_json(spark, args.keep_relations) if args.keep_relations else None)
    for name, hit in build.hits.items():
        print(f"{name}: {'cached' if hit else 'built'}")


if __name__ == "__main__":
    raise SystemExit(main())
