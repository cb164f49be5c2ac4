"""Scalar text and source-code functions, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import lookup_map
from .constants import ABBREVIATIONS, CODE_PATTERNS, CONTEXT_WORD, DETACHED, EXTENSIONS, FORMAL, INTENSITY, KEYWORDS, LEXEME, NEGATIONS, PLAIN_WORD, STOP_WORDS

_VOWELS = "aeiou"


def _words(words) -> Column:
    return F.array(*map(F.lit, words))


def is_stop_word(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def tokenize(text: Column, drop_stop_words: bool = True) -> Column:
    """Lower-cased words of a text, with inner apostrophes and hyphens."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLAIN_WORD), F.lit(0)), lambda w: F.lower(w))
    return F.filter(words, lambda w: ~is_stop_word(w)) if drop_stop_words else words


def scan_context(text: Column) -> Column:
    """Words in order with what modifies them: array<struct<word, level, negated, formal>>.

    Intensifiers and negations are dropped and attach to the next word of the sentence; a formal marker raises itself and the
    rest of its sentence. Sentences end at . ! or ?, so each is folded on its own.
    """
    level = lookup_map({w: k for k, words in INTENSITY.items() for w in words})
    none = F.expr("cast(array() as array<struct<word:string,level:int,negated:boolean,formal:boolean>>)")
    start = F.struct(F.lit(None).cast("int").alias("level"), F.lit(False).alias("negated"), F.lit(False).alias("formal"), none.alias("out"))

    def step(s: Column, w: Column) -> Column:
        formal = s["formal"] | w.isin(*FORMAL)
        plain = F.struct(
            F.lit(None).cast("int").alias("level"), F.lit(False).alias("negated"), formal.alias("formal"),
            F.concat(s["out"], F.array(F.struct(w.alias("word"), s["level"].alias("level"), s["negated"].alias("negated"), formal.alias("formal")))).alias("out"),
        )
        raised = F.struct(level[w].alias("level"), s["negated"].alias("negated"), s["formal"].alias("formal"), s["out"].alias("out"))
        flipped = F.struct(s["level"].alias("level"), F.lit(True).alias("negated"), s["formal"].alias("formal"), s["out"].alias("out"))
        return F.when(w.isin(*[x for words in INTENSITY.values() for x in words]), raised).when(w.isin(*NEGATIONS), flipped).otherwise(plain)

    plain_words = lambda words: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("negated"), F.lit(False).alias("formal")))
    modifiers = _words([*[x for words in INTENSITY.values() for x in words], *NEGATIONS, *FORMAL])
    sentences = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "[.!?]"), lambda x: F.regexp_extract_all(x, F.lit(CONTEXT_WORD), F.lit(0)))
    # only sentences with a modifier need the fold
    folded = lambda words: F.when(F.arrays_overlap(words, modifiers), F.aggregate(words, start, step, lambda s: s["out"])).otherwise(plain_words(words))
    return F.flatten(F.transform(sentences, folded))


def language_of(filename: Column) -> Column:
    """The language of a file name's extension, or null."""
    return lookup_map({ext: lang for lang, exts in EXTENSIONS.items() for ext in exts.split()})[F.lower(F.substring_index(filename, ".", -1))]


def language_of_source(source: Column) -> Column:
    """A guess from telling words of the source."""
    has = lambda *words: reduce(lambda a, b: a | b, [source.contains(w) for w in words])
    return F.when(has("def ", "import "), "python").when(has("function ", "const ", "=>"), "javascript").otherwise("python")


def is_keyword(word: Column, language: Column) -> Column:
    """A reserved word of the language, as it stands or lower-cased; unknown languages have none."""
    own = F.create_map(*[x for lang, words in KEYWORDS.items() for x in (F.lit(lang), _words(words.split()))])
    found = own[language]
    return F.coalesce(F.array_contains(found, word) | F.array_contains(found, F.lower(word)), F.lit(False))


def split_identifier(name: Column) -> Column:
    """Lower-cased parts of an identifier in camel, snake, kebab or capital style, abbreviations expanded."""
    flat = F.when(name.rlike("^[A-Z0-9_]+$"), F.lower(name)).otherwise(F.coalesce(name, F.lit("")))
    spaced = F.regexp_replace(flat, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    parts = F.transform(F.regexp_extract_all(spaced, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)), lambda p: F.lower(p))
    full = lookup_map(ABBREVIATIONS)
    return F.transform(parts, lambda p: F.coalesce(full[p], p))


def detect_patterns(source: Column) -> Column:
    """Sorted names of the patterns that a source shows; recursion: a defined name that is called somewhere else."""
    low = F.lower(F.coalesce(source, F.lit("")))
    names = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(r"(?i)\b(?:def|function|fn|func)\s+(\w+)\s*\("), F.lit(1))
    called = F.exists(F.array_distinct(names), lambda n: F.regexp_count(source, F.concat(F.lit(r"\b"), n, F.lit(r"\s*\("))) >= 2)
    found = [F.when(low.rlike(p), F.lit(n)) for n, p in CODE_PATTERNS.items()] + [F.when(called, F.lit("recursion"))]
    return F.array_sort(F.array_compact(F.array(*found)))


def pattern_bonus(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared > 0, F.least(F.lit(0.20), F.lit(0.10) + F.lit(0.02) * (shared - 1))).otherwise(F.lit(0.0))


def _vowel(c: Column) -> Column:
    return c.isin(*_VOWELS)


def _doubles(word: Column) -> Column:
    """Consonant, vowel, consonant (not w, x or y) at the end."""
    last, mid, first = (F.substring(word, -k, 1) for k in (1, 2, 3))
    return (F.length(word) >= 3) & ~_vowel(last) & ~last.isin("w", "x", "y") & _vowel(mid) & ~_vowel(first)


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def _y_after_consonant(word: Column) -> Column:
    return word.endswith("y") & ~_vowel(F.substring(word, -2, 1))


def plural(word: Column) -> Column:
    rule = F.when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).when(_y_after_consonant(word), F.concat(_cut(word, 1), F.lit("ies")))
    rule = rule.when(word.endswith("f") & (F.length(word) >= 3), F.concat(_cut(word, 1), F.lit("ves"))).when(word.endswith("fe"), F.concat(_cut(word, 2), F.lit("ves")))
    return F.when(~word.contains(" ") & (F.length(word) >= 2), rule.otherwise(F.concat(word, F.lit("s"))))


def past(word: Column) -> Column:
    rule = F.when(word.endswith("e"), F.concat(word, F.lit("d"))).when(_y_after_consonant(word), F.concat(_cut(word, 1), F.lit("ied")))
    rule = rule.when(_doubles(word), F.concat(word, F.substring(word, -1, 1), F.lit("ed")))
    return F.when(~word.contains(" ") & (F.length(word) >= 2), rule.otherwise(F.concat(word, F.lit("ed"))))


def gerund(word: Column) -> Column:
    rule = F.when(word.endswith("ie"), F.concat(_cut(word, 2), F.lit("ying"))).when(word.endswith("e") & ~word.endswith("ee"), F.concat(_cut(word, 1), F.lit("ing")))
    rule = rule.when(_doubles(word), F.concat(word, F.substring(word, -1, 1), F.lit("ing")))
    return F.when(~word.contains(" ") & (F.length(word) >= 2), rule.otherwise(F.concat(word, F.lit("ing"))))


def _graded(word: Column, ending: str) -> Column:
    rule = F.when(_y_after_consonant(word), F.concat(_cut(word, 1), F.lit("i" + ending))).when(word.endswith("e"), F.concat(word, F.lit(ending[1:])))
    rule = rule.when(_doubles(word), F.concat(word, F.substring(word, -1, 1), F.lit(ending)))
    return F.when(~word.contains(" ") & F.length(word).between(3, 8), rule.otherwise(F.concat(word, F.lit(ending))))


def comparative(word: Column) -> Column:
    return _graded(word, "er")


def superlative(word: Column) -> Column:
    return _graded(word, "est")


def adverb(word: Column) -> Column:
    rule = F.when(_y_after_consonant(word), F.concat(_cut(word, 1), F.lit("ily"))).when(word.endswith("ic"), F.concat(word, F.lit("ally")))
    rule = rule.when(word.endswith("le") & (F.length(word) >= 4) & ~_vowel(F.substring(word, -3, 1)), F.concat(_cut(word, 1), F.lit("y")))
    return F.when(~word.contains(" ") & (F.length(word) >= 3) & ~word.endswith("ly"), rule.otherwise(F.concat(word, F.lit("ly"))))


def looks_inflected(word: Column) -> Column:
    return ~word.contains(" ") & word.rlike("(ing|ed|est|ly|ies)$")


def variants(word: Column, pos: Column) -> Column:
    """Regular inflections of a word that isn't inflected itself, for n, v, a or s."""
    none = F.array().cast("array<string>")
    forms = F.when(pos == "n", F.array(plural(word))).when(pos == "v", F.array(plural(word), past(word), gerund(word))).when(pos.isin("a", "s"), F.array(comparative(word), superlative(word), adverb(word)))
    return F.when(looks_inflected(word), none).otherwise(F.filter(F.array_compact(F.coalesce(forms, none)), lambda v: v != word))


def lemma_candidates(word: Column) -> Column:
    """A word, and what it may be an inflection of by its ending: of nouns, then verbs, then adjectives."""
    ends = [F.when(word.endswith(end) & (F.length(word) > len(end) + 1), F.concat(_cut(word, len(end)), F.lit(new))) for end, new in DETACHED]
    return F.array_distinct(F.array_compact(F.array(word, *ends)))


def formality_from_frequency(zipf: Column) -> Column:
    return F.when(zipf >= 5, 0).when(zipf >= 4, 1).when(zipf >= 3, 2).otherwise(3)


def is_common(zipf: Column, least: float = 2.0) -> Column:
    return zipf >= least


def polarity_from_scores(positive: Column, negative: Column) -> Column:
    """Two bits from the mean sentiment of a word's first senses; unknown: 1."""
    s = positive - negative
    return F.when(s.isNull(), 1).when(s <= -0.25, 0).when(s < 0, 1).when(s < 0.25, 2).otherwise(3)


def concept_word(uri: Column, language: str = "en") -> Column:
    """The words of /c/en/x_y/..., or null for another language."""
    found = F.regexp_extract(uri, rf"^/c/{language}/([^/]+)", 1)
    return F.when(found != "", F.lower(F.replace(found, F.lit("_"), F.lit(" "))))


def plain_word(word: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(word, "[_ ]+", " ")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))
