"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from semcodec.functions import codec, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_shades(spark):
    assert one(spark, codec.word_shade(F.lit("happy"), F.lit(3), F.lit(1), F.lit(2))) == 0x97
    assert one(spark, codec.word_shade(F.lit("dog"))) == 0x45
    assert one(spark, codec.in_context(F.lit(0x55), F.lit(3), F.lit(True), F.lit(True))) == 0xDA
    assert one(spark, codec.shade_similarity(F.lit(0x55), F.lit(0x45))) == pytest.approx(1 - 16 / 255)


def test_addresses(spark):
    addr = (0x00 << 16) | (1 << 8) | 6
    assert one(spark, codec.address_text(F.lit(addr))) == "EM106"
    assert one(spark, codec.address_from_text(F.lit("em106"))) == addr
    assert one(spark, codec.address_from_text(F.lit("ZZ106"))) is None
    assert one(spark, codec.address_text(F.lit(0x031102))) == "QU1102"
    assert one(spark, codec.address_from_text(F.lit("QU1102"))) == 0x031102
    assert one(spark, codec.address_from_bytes(codec.address_bytes(F.lit(0x031102)))) == 0x031102
    assert one(spark, codec.is_null_address(F.lit(0xFF0000)))
    assert one(spark, codec.domain_code(F.lit(0x990000))) == "??"


def test_text_form(spark):
    back = one(spark, codec.from_text(F.lit("EM001:5D · AC000:45|")))
    assert [(r["addr"], r["shade"]) for r in back] == [(1, 0x5D), (0x010000, 0x45)]
    assert one(spark, codec.to_text(codec.from_text(F.lit("EM001:5D·AC000:45")))) == "EM001:5D·AC000:45"
    assert one(spark, codec.from_text(F.lit(""))) == []


def test_binary_round_trip(spark):
    token = "named_struct('pos', 0, 'word', 'x', 'addr', 66051, 'shade', 69, 'role', 2, 'features', 2, 'related', array(named_struct('addr', 7, 'weight', 200, 'type', 'ISA', 'direction', 1)))"
    tokens = F.expr(f"array({token})").cast(f"array<{codec.TOKEN}>")
    for version, size in ((1, 12), (2, 28), (3, 40)):
        data = codec.to_binary(tokens, version, code_mode=True)
        assert one(spark, F.length(data)) == size
        back = one(spark, codec.from_binary(data))
        assert back["version"] == version and back["code_mode"]
        t = back["tokens"][0]
        assert (t["addr"], t["shade"]) == (66051, 69)
        if version == 3:
            assert (t["role"], t["features"], t["related"][0]["type"], t["related"][0]["direction"]) == (2, 2, "ISA", 1)
        if version > 1:
            assert (t["related"][0]["addr"], t["related"][0]["weight"], len(t["related"])) == (7, 200, 1)
    with pytest.raises(Exception, match="not a binary sequence"):
        one(spark, codec.from_binary(F.lit(b"XX000000").cast("binary")))
    assert one(spark, F.length(codec.to_binary(tokens, 1, metadata=F.lit("abc")))) == 17


@pytest.mark.parametrize(
    "name,parts",
    [
        ("fetchUserData", "fetch user data"), ("HttpResponseCode", "http response code"), ("HTTPResponseCode", "http response code"), ("MAX_RETRY_COUNT", "maximum retry count"),
        ("user-profile-api", "user profile interface"), ("getDBConn", "get database connection"), ("user42Name", "user 42 name"), ("", ""),
    ],
)
def test_identifiers(spark, name, parts):
    assert " ".join(one(spark, text.split_identifier(F.lit(name)))) == parts


def test_context(spark):
    rows = one(spark, text.scan_context(F.lit("not a happy dog. Slightly happy! Hereby he walks")))
    assert [r["word"] for r in rows] == ["a", "happy", "dog", "happy", "hereby", "he", "walks"]
    assert [r["negated"] for r in rows] == [True, False, False, False, False, False, False]
    assert [r["level"] for r in rows] == [None, None, None, 0, None, None, None]
    assert [r["formal"] for r in rows] == [False] * 4 + [True] * 3
    assert one(spark, text.scan_context(F.lit(None).cast("string"))) == []


def test_patterns_and_language(spark):
    source = "def fib(n):\n    if n < 2: return n\n    return fib(n - 1) + fib(n - 2)"
    found = one(spark, text.detect_patterns(F.lit(source)))
    assert {"recursion", "conditional-branch", "function-def"} <= set(found)
    assert one(spark, text.pattern_bonus(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("b")))) == pytest.approx(0.12)
    assert one(spark, text.language_of(F.lit("a/b.TSX"))) == "typescript"
    assert one(spark, text.language_of(F.lit("x.txt"))) is None
    assert one(spark, text.is_keyword(F.lit("None"), F.lit("python"))) and not one(spark, text.is_keyword(F.lit("if"), F.lit("cobol")))


def test_morphology(spark):
    w = F.lit
    assert one(spark, text.variants(w("stop"), w("v"))) == ["stops", "stopped", "stopping"]
    assert one(spark, text.variants(w("happy"), w("a"))) == ["happier", "happiest", "happily"]
    assert one(spark, text.variants(w("running"), w("v"))) == []
    assert one(spark, text.plural(w("knife"))) == "knives"


def test_graph_words(spark):
    assert one(spark, text.concept_word(F.lit("/c/en/hot_dog/n"))) == "hot dog"
    assert one(spark, text.concept_word(F.lit("/c/fr/chien"))) is None
    assert one(spark, codec.relation_type(F.lit("is_a"))) == "ISA" and one(spark, codec.relation_type(F.lit("?"))) == "RELATED"
    assert one(spark, codec.relation_direction(F.lit("reverse"))) == 2
    assert one(spark, text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
