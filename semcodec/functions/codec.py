"""Addresses, shades and the text and binary forms of sequences, as Columns.

An address is one integer: domain << 16 | category << 8 | concept. A shade is one byte of four two-bit fields: intensity, abstraction,
formality, polarity. A sequence is an array of structs with at least addr and shade.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CODE_DOMAINS, DEFAULT_ROLE, DIRECTIONS, DOMAINS, NULL_ADDRESS, RELATION_ALIASES, RELATIONS, ROLES

TOKEN = "struct<pos:int,word:string,addr:int,shade:int,role:int,features:int,related:array<struct<addr:int,weight:int,type:string,direction:int>>>"
BYTES_PER_TOKEN = {1: 4, 2: 20, 3: 32}


def lookup_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def pack(domain: Column, category: Column, concept: Column) -> Column:
    return (F.shiftleft(domain.cast("int"), 16) + F.shiftleft(category.cast("int"), 8) + concept.cast("int")).cast("int")


def domain_of(addr: Column) -> Column:
    return F.shiftright(addr, 16).bitwiseAND(F.lit(255))


def category_of(addr: Column) -> Column:
    return F.shiftright(addr, 8).bitwiseAND(F.lit(255))


def concept_of(addr: Column) -> Column:
    return addr.bitwiseAND(F.lit(255))


def is_null_address(addr: Column) -> Column:
    """Only the domain counts."""
    return domain_of(addr) == 255


def is_code(addr: Column) -> Column:
    return domain_of(addr).between(*CODE_DOMAINS)


def address_bytes(addr: Column) -> Column:
    return F.unhex(F.lpad(F.hex(addr.cast("long")), 6, "0"))


def address_from_bytes(data: Column) -> Column:
    return F.conv(F.hex(F.substring(data, 1, 3)), 16, 10).cast("int")


def domain_code(addr: Column) -> Column:
    return F.coalesce(lookup_map({number: code for code, (number, _) in DOMAINS.items()})[domain_of(addr)], F.lit("??"))


def address_text(addr: Column) -> Column:
    """Domain code, category in hexadecimal, concept in two digits; a category over 15 takes two digits too."""
    return F.concat(domain_code(addr), F.hex(category_of(addr).cast("long")), F.lpad(F.hex(concept_of(addr).cast("long")), 2, "0"))


def address_from_text(text: Column) -> Column:
    """The address of five characters such as EM106, or null where the domain is unknown or a digit is bad.

    Six characters are read as a two-digit category.
    """
    code = lookup_map({code: number for code, (number, _) in DOMAINS.items()})[F.upper(F.substring(text, 1, 2))]
    digits = F.substring(text, 3, 8)
    good = digits.rlike("^[0-9A-Fa-f]{3,4}$")
    number = lambda c: F.conv(c, 16, 10).cast("int")
    return F.when(good, pack(code, number(F.left(digits, F.length(digits) - 2)), number(F.right(digits, F.lit(2)))))


def shade(intensity: Column, abstraction: Column, formality: Column, polarity: Column) -> Column:
    return (F.shiftleft(intensity.cast("int"), 6) + F.shiftleft(abstraction.cast("int"), 4) + F.shiftleft(formality.cast("int"), 2) + polarity.cast("int")).cast("int")


def shade_parts(value: Column) -> dict[str, Column]:
    return {name: F.shiftright(value, bits).bitwiseAND(F.lit(3)) for name, bits in (("intensity", 6), ("abstraction", 4), ("formality", 2), ("polarity", 0))}


def shade_hex(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("long")), 2, "0")


def shade_similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.abs(a - b) / F.lit(255.0)


def word_shade(word: Column, polarity: Column | None = None, formality: Column | None = None, intensity: Column | None = None) -> Column:
    """A word's shade from its hints (1 where there is none) and its length: abstraction is a quarter of it, 3 at most."""
    one = F.lit(1)
    hint = lambda c: F.coalesce(c, one) if c is not None else one
    return shade(hint(intensity), F.least(F.lit(3), F.floor(F.length(word) / 4)), hint(formality), hint(polarity))


def in_context(value: Column, level: Column, negated: Column, formal: Column) -> Column:
    """A shade with the intensity replaced where a level is given, the polarity flipped, the formality raised by one."""
    p = shade_parts(value)
    return shade(F.coalesce(level, p["intensity"]), p["abstraction"], F.when(formal, F.least(F.lit(3), p["formality"] + 1)).otherwise(p["formality"]), F.when(negated, 3 - p["polarity"]).otherwise(p["polarity"]))


def role_of(addr: Column) -> Column:
    return F.coalesce(lookup_map({DOMAINS[code][0]: role for code, role in ROLES.items()})[domain_of(addr)], F.lit(DEFAULT_ROLE))


def clamped_weight(weight: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), weight.cast("int")))


def relation_type(name: Column) -> Column:
    """The relation's name for any of its aliases; unknown or null: RELATED."""
    return F.coalesce(lookup_map({r: r for r in RELATIONS} | RELATION_ALIASES)[F.upper(name)], F.lit("RELATED"))


def relation_direction(name: Column) -> Column:
    """0 undirected, 1 out, 2 in."""
    return F.coalesce(lookup_map(DIRECTIONS)[F.upper(name)], F.lit(0))


def byte_size(tokens: Column, version: int = 3) -> Column:
    return F.lit(8) + F.size(tokens) * BYTES_PER_TOKEN[version]


def domains(tokens: Column) -> Column:
    """The distinct domain numbers of a sequence, sorted."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: domain_of(t["addr"]))))


def to_text(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.concat(address_text(t["addr"]), F.lit(":"), shade_hex(t["shade"]))), "·")


def from_text(text: Column) -> Column:
    """array<struct<addr,shade>> of EM001:5D·...; also split at | and ,; blank parts are skipped."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[·|,]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(
        parts, lambda p: F.struct(address_from_text(F.substring_index(p, ":", 1)).alias("addr"), F.conv(F.substring_index(p, ":", -1), 16, 10).cast("int").alias("shade"))
    )


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def to_binary(tokens: Column, version: int = 3, code_mode: bool = False, metadata: Column | None = None) -> Column:
    """The binary form: an 8-byte header, then 4, 20 or 32 bytes a token; over 65,535 tokens is an error."""
    flags = (1 if metadata is not None else 0) | (2 if code_mode else 0) | {1: 0, 2: 4, 3: 8}[version]
    size = F.when(F.size(tokens) > 65535, F.raise_error(F.lit("a binary sequence holds 65535 tokens at most")).cast("int")).otherwise(F.size(tokens))
    parts = [F.lit(f"5353{version:02X}{flags:02X}"), _hex(size, 4), F.lit("0000")]

    def related(t: Column) -> Column:
        own = F.slice(F.coalesce(t["related"], F.array().cast("array<struct<addr:int,weight:int,type:string,direction:int>>")), 1, 4)
        number = lookup_map({r: k for k, r in enumerate(RELATIONS)})
        one = lambda r: F.concat(F.concat(_hex(F.coalesce(number[r["type"]], F.lit(0)), 2), _hex(r["direction"], 2)) if version == 3 else F.lit(""), _hex(r["addr"], 6), _hex(r["weight"], 2))
        blank = ("0000" if version == 3 else "") + f"{NULL_ADDRESS:06X}00"
        return F.rpad(F.array_join(F.transform(own, one), ""), 4 * len(blank), blank)

    def token(t: Column) -> Column:
        head = F.concat(_hex(t["addr"], 6), _hex(t["shade"], 2))
        if version == 1:
            return head
        if version == 2:
            return F.concat(head, related(t))
        return F.concat(head, _hex(t["role"], 2), F.lit("00"), _hex(t["features"], 4), related(t))

    parts.append(F.array_join(F.transform(tokens, token), ""))
    if metadata is not None:
        parts += [_hex(F.octet_length(metadata), 4), F.hex(F.encode(metadata, "UTF-8"))]
    return F.unhex(F.concat(*parts))


def from_binary(data: Column) -> Column:
    """struct<version, code_mode, tokens> of a binary sequence of any version; metadata is skipped; a bad header is an error.

    The digits and the version are bound by a lambda: inside the functions over tokens and edges, Spark would work out `data` anew for each number read.
    """
    version = F.conv(F.substring(F.hex(data), 5, 2), 16, 10).cast("int")
    return F.get(F.transform(F.array(F.struct(F.hex(data).alias("text"), version.alias("version"))), lambda x: _from_digits(x["text"], x["version"])), F.lit(0))


def _from_digits(text: Column, version: Column) -> Column:
    number = lambda at, digits: F.conv(F.substr(text, at, F.lit(digits)), 16, 10).cast("int")
    bad = ~text.startswith("5353") | ~version.isin(1, 2, 3) | text.isNull()
    width = F.when(version == 1, 8).when(version == 2, 40).otherwise(64)
    names = F.array(*map(F.lit, RELATIONS))

    def token(i: Column) -> Column:
        at = F.lit(17) + i * width
        wide = F.when(version == 3, 12).otherwise(8)
        skip = F.when(version == 3, 4).otherwise(0)
        base = at + F.when(version == 3, 16).otherwise(8)

        def relation(k: Column) -> Column:
            here = base + k * wide
            return F.struct(
                number(here + skip, 6).alias("addr"),
                number(here + skip + 6, 2).alias("weight"),
                F.when(version == 3, F.get(names, number(here, 2))).otherwise(F.lit("RELATED")).alias("type"),
                F.when(version == 3, number(here + 2, 2)).otherwise(F.lit(0)).alias("direction"),
            )

        kept = F.when(version == 1, F.array().cast("array<struct<addr:int,weight:int,type:string,direction:int>>")).otherwise(
            F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), relation), lambda r: ~is_null_address(r["addr"]))
        )
        return F.struct(
            i.cast("int").alias("pos"), F.lit("").alias("word"), number(at, 6).alias("addr"), number(at + 6, 2).alias("shade"),
            F.when(version == 3, number(at + 8, 2)).otherwise(0).alias("role"), F.when(version == 3, number(at + 12, 4)).otherwise(0).alias("features"), kept.alias("related"),
        )

    n = number(F.lit(9), 4)
    none = F.array().cast(f"array<{TOKEN}>")
    tokens = F.when(n == 0, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), token))
    good = F.struct(version.alias("version"), (number(F.lit(7), 2).bitwiseAND(F.lit(2)) != 0).alias("code_mode"), tokens.alias("tokens"))
    return F.when(bad, F.raise_error(F.lit("not a binary sequence")).cast(f"struct<version:int,code_mode:boolean,tokens:array<{TOKEN}>>")).otherwise(good)
