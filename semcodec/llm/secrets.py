"""Secret scans: fixed patterns, and further candidates judged by who else has them in the corpus.

Base spans come from three fixed patterns. The method looks at further candidates (well-known token prefixes, key blocks,
bearer values, and values of other assignments) and counts for the hash of each value in how many
repositories and by how many owners it is found. A value that more than two owners or repositories have is a copied example; one that belongs to one or two
(a document with a credential may have one copy elsewhere) and looks random is taken for a live credential and reported as well. The limits are plain
numbers: what other owners a table has doesn't matter.

The counts are partially aggregated before each shuffle: (value, owner, repository), then (value, owner), then value. What
is joined back to the documents are the values of few owners and repositories only, so a widely copied example is not gathered anywhere.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize, prepare_workers, unused

#: Fixed patterns and least lengths; kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
_ANY_CASE = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(" + "|".join(map(_ANY_CASE, ("password", "passwd", "secret", "token"))) + "|" + _ANY_CASE("api") + "_?" + _ANY_CASE("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_HINTS = ("password", "passwd", "secret", "token", "api")
_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\s]*)-----END")
_SEGMENT = re.compile(r"[A-Za-z0-9_-]*")


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """What stands between the lines of a key block, without the white space around it; no character of it may be a dash, so a block is read once."""
    for m in _BLOCK.finditer(text):
        inner = m[1].strip()
        if len(inner) >= 32:
            a = m.start(1) + len(m[1]) - len(m[1].lstrip())
            yield a, a + len(inner)


def _web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Three segments with dots between them, the first from an `eyJ` at a word's beginning; each run of characters is read a fixed number of times."""
    at = text.find("eyJ")
    while at >= 0:
        ends = [_SEGMENT.match(text, at).end()]
        while len(ends) < 3 and text[ends[-1] : ends[-1] + 1] == ".":
            ends.append(_SEGMENT.match(text, ends[-1] + 1).end())
        after = ends[0]
        if len(ends) == 3 and min(ends[1] - ends[0], ends[2] - ends[1]) > 8:
            while 0 <= at <= ends[0] - 11:
                if at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_"):
                    yield at, ends[2]
                    after = ends[2]
                    break
                at = text.find("eyJ", at + 1)
        at = text.find("eyJ", after)


def _group(pattern: str):
    compiled = re.compile(pattern)
    return lambda text: (m.span(1) for m in compiled.finditer(text))


#: The method's own candidates: where the values are.
_MORE = (
    ("token", _group(r"\b((?:ghp|gho|ghs|glpat|xox[abp]|sk|pk|rk)[_-][A-Za-z0-9_-]{16,})")),
    ("bearer", _group(r"\b[Bb]earer\x20+([A-Za-z0-9._~+/=-]{20,})")),
    ("jwt", _web_tokens),
    ("block", _blocks),
    ("other", _group(r"""\b(?:auth|credential|private|access|client|pwd|key)[A-Za-z_]*["']?\x20*[:=]\x20*["']([^\s"']{12,})["']""")),
)


def _base(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) in code points, ordered by start, then kind as listed."""
    found = [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    return [(a, z, KINDS[k], value) for a, k, z, value in sorted(found)]


def _more(text: str, taken: list[tuple]) -> list[tuple[int, int, str, str]]:
    """The method's candidates that don't overlap a base span or an earlier candidate."""
    found: list[tuple[int, int, str, str]] = []
    covered = None
    for kind, values in _MORE:
        for a, z in values(text):
            if covered is None:
                covered = bytearray(len(text))
                for x, y, *_ in taken:
                    covered[x:y] = b"\1" * (y - x)
            if covered.find(1, a, z) < 0:
                covered[a:z] = b"\1" * (z - a)
                found.append((a, z, kind, text[a:z]))
    return sorted(found)


def entropy(value: str) -> float:
    """Bits for each character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    candidate = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("fixed", pa.bool_()), ("value", pa.string()), ("bits", pa.float64())])
    for b in batches:
        base, every = [], []
        for x in b.column(3):
            text = x.as_py() or ""
            own = _base(text)
            base.append([{"start": a, "end": z, "kind": k} for a, z, k, _ in own])
            every.append([{"start": a, "end": z, "kind": k, "fixed": n < len(own), "value": hashlib.sha256(v.encode()).hexdigest(), "bits": entropy(v)} for n, (a, z, k, v) in enumerate([*own, *_more(text, own)])])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(base, pa.list_(span)), pa.array(every, pa.list_(candidate))], ["doc_id", "owner", "repo", "base", "candidates"])


_SPAN = "array<struct<start:long,end:long,kind:string>>"


def scan(docs: DataFrame, owner: Column | str = "source", repository: Column | str = "lang", *, max_owners: int = 2, max_repos: int = 2, min_bits: float = 3.0) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, owner, base, more and live: arrays of (start, end, kind), one row for each row.

    base: spans of the fixed patterns; more: what the method adds; live: of both, those taken for live credentials.

    owner and repository say who has a document; a repository is told apart by its owner and its name. A null text is empty;
    a null owner or repository counts as one of its own. Repeated rows count once towards owners. A value is taken for live if at most `max_owners` owners
    and at most `max_repos` repositories have it and its characters have `min_bits` bits of entropy or more; no other row counts. An empty table gives an empty table. Whole texts of any length are scanned; other columns of docs, whatever
    their names, are ignored.
    """
    prepare_workers(docs.sparkSession)
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    rows = docs.select("doc_id", F.coalesce(col(owner), F.lit("")).alias("owner"), F.coalesce(col(repository), F.lit("")).alias("repo"), "text")
    seen = rows.mapInArrow(_scan, f"doc_id long, owner string, repo string, base {_SPAN}, candidates array<struct<start:long,end:long,kind:string,fixed:boolean,value:string,bits:double>>")
    seen = materialize(seen.withColumn("row", F.monotonically_increasing_id()), "spans")
    some = seen.where(F.size("candidates") > 0).select("row", "owner", "repo", F.explode("candidates").alias("c")).select("row", "owner", "repo", "c.*")
    owners = some.select("value", "owner", "repo").distinct().groupBy("value", "owner").agg(F.count("*").alias("repos")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    live = owners.where((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).select("value", "owners", "repos")
    told = some.where(F.col("bits") >= min_bits).join(live, "value").groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind", "fixed")).alias("told"))
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    told = told.select("row", F.transform(F.filter("told", lambda s: ~s["fixed"]), plain).alias("more"), F.transform("told", plain).alias("live"))
    none = F.expr(f"cast(array() as {_SPAN})")
    return seen.join(told, "row", "left").select("doc_id", "owner", "base", F.coalesce("more", none).alias("more"), F.coalesce("live", none).alias("live"))


def _rank(kind: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), kind), F.lit(0)), F.lit(len(KINDS) + 1))


def listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind as listed, then name, joined by commas."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts, digest and list of scan()'s spans."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "more")).alias("spans"), listed(F.col("live")).alias("live_spans"))


def _redact(mark: str, key: str, spans_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, k, spans_at = [], b.schema.get_field_index("text"), b.schema.get_field_index(spans_column)
            for row, text, spans in zip(b.column(b.schema.get_field_index(key)).to_pylist(), b.column(k).to_pylist(), b.column(spans_at).to_pylist()):
                if row is None and text:
                    spans = [{"start": a, "end": z} for a, z, *_ in _base(text)]
                if spans:
                    end, parts = 0, []
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["end"] > end:
                            parts += [text[end : max(end, s["start"])], mark if s["start"] >= end else ""]
                            end = s["end"]
                    text = "".join(parts) + text[end:]
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == k else b.column(i) for i in range(b.num_columns) if i != spans_at]
            yield pa.RecordBatch.from_arrays(columns, [n for n in b.schema.names if n != spans_column])

    return run


#: Spans up to which they are broadcast to the texts (some 60 bytes each); beyond that both sides are shuffled.
BROADCAST_SPANS = 300_000


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[secret]", key: str = "doc_id") -> DataFrame:
    """docs, in the same columns, with all spans of scan(docs) replaced by `mark`, overlapping ones together.

    Joined by found's doc_id with docs' `key`, whose values must be unique. In rows where it is null the fixed patterns' spans are replaced. Columns of docs
    may have any names.
    """
    prepare_workers(docs.sparkSession)
    spans = unused("spans", docs.columns)
    hits = found.where((F.size("base") > 0) | (F.size("more") > 0)).select(F.col("doc_id").alias(key), F.concat("base", "more").alias(spans))
    many = hits.agg(F.sum(F.size(spans))).first()[0] or 0
    return docs.join(F.broadcast(hits) if many <= BROADCAST_SPANS else hits, key, "left").select(*columns(docs), spans).mapInArrow(_redact(mark, key, spans), docs.schema)
