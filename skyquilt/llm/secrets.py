"""Secret scans with corpus-wide ownership frequency.

Three base patterns (assignments, access keys, long hexadecimal runs) are found
in every text, and with them bare tokens: eight or more token characters with
letters and digits, outside base spans.  A candidate's value is hashed; over the
whole corpus the distinct owners and repositories that hold it are counted.
Values that many owners or repositories hold are copied examples; values of few
of both look live.  Frequency also decides on bare tokens: one counts if its
value looks live and is either a base value somewhere in the corpus, as a
password that is assigned in one document and pasted into another, or opaque
(20 and more characters, with digits and letters of both cases).  Base spans
always stay; every span is told as live or example.

Scale: texts are read once.  What follows is a narrow table of documents and
their candidates, in the checkpoint folder; counting owners combines before
the shuffle, and the join back has one row for each value on one side, so a
value copied into every document is split by Spark.

Defined results: null text has no spans; a null owner or repository is one of
its own; repeated rows have a row each, and add no owner; null ids are kept; no
documents give no rows; extra columns are ignored.  Values compare without full
stops at their ends.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.llm.words import slices
from skyquilt.session import cut, table

#: A value in more owners or repositories than this is an example.
MOST_OWNERS = 2
MOST_REPOSITORIES = 3
#: The base patterns, and the kinds in their order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "bare")
#: Bare tokens, and the length from which one may be opaque.
BARE, OPAQUE = r"[A-Za-z0-9+/_=-]{8,}", 20
_COMPILED = (re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX), re.compile(BARE))
#: Texts without these hold no span of a kind; a linear-time engine finds out.
_MAYBE = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "AKIA", HEX, "[0-9][A-Za-z+/_=-]|[A-Za-z+/_=-][0-9]")
_DIGIT, _LOWER, _UPPER = (re.compile(x) for x in ("[0-9]", "[a-z]", "[A-Z]"))


def scan_text(text: str, kinds: tuple[int, ...]) -> list[tuple[int, int, int, int, bool]]:
    """(start, kind, end, hash of the value, opaque) of all spans, in order."""
    out = []
    for k in kinds:
        for m in _COMPILED[k].finditer(text):
            value = m.group(2) if k == 0 else m.group()
            if k == 0 and len(value) < 6:
                continue
            opaque = False
            if k == 3:
                lower, upper = _LOWER.search(value), _UPPER.search(value)
                if not _DIGIT.search(value) or not (lower or upper):
                    continue
                opaque = bool(len(value) >= OPAQUE and lower and upper)
            out.append((m.start(), k, m.end(), xxhash.xxh64_intdigest(value.strip(".").encode(), 42), opaque))
    # a bare token that overlaps a base span tells nothing new
    base = sorted((x[0], x[2]) for x in out if x[1] < 3)
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))

    def alone(start: int, end: int) -> bool:
        i = bisect_right(starts, start)
        return not (i and reach[i - 1] > start or i < len(starts) and starts[i] < end)

    return sorted(x for x in out if x[1] < 3 or alone(x[0], x[2]))


def joined(spans: list[tuple[int, int, int, int, bool]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


_SPAN = "array<struct<start:long,kind:int,stop:long,hash:long,opaque:boolean>>"


def scan(docs: DataFrame, text: str, doc: str, owner: Sequence[str], repository: Sequence[str]) -> DataFrame:
    """One narrow row for each document: ids, counts, digest and all candidate spans."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("hash", pa.int64()), ("opaque", pa.bool_())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for part in slices(batch):
                texts = part.column(3).fill_null("")
                maybe = [pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p in _MAYBE]
                counts, digest = np.zeros((3, part.num_rows), np.int64), [empty] * part.num_rows
                spans: list = [[]] * part.num_rows
                for i in np.flatnonzero(np.logical_or.reduce(maybe)):
                    found = scan_text(texts[i].as_py(), tuple(k for k in range(4) if maybe[k][i]))
                    base = [x for x in found if x[1] < 3]
                    for x in base:
                        counts[x[1], i] += 1
                    digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[i] = [{"start": s, "kind": k, "stop": e, "hash": h - (1 << 64) if h >> 63 else h, "opaque": o} for s, k, e, h, o in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), *map(pa.array, counts), pa.array(digest), pa.array(spans, kind)],
                    names=["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    # several columns name an owner or repository together; a null is a value of its own
    name = lambda columns: F.to_json(F.array(*(F.col(c).cast("string") for c in columns)))
    src = docs.select(F.col(doc).alias("doc_id"), name(owner).alias("owner"), name(repository).alias("repository"), F.col(text).alias("text"))
    return src.mapInArrow(find, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, spans {_SPAN}")


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, n_owners, n_repositories, in_base`` of each value over the corpus; ``in_base``: some
    base pattern finds it somewhere."""
    pairs = candidates.groupBy("hash", "owner", "repository").agg(F.max(F.col("kind") < 3).alias("in_base"))
    return pairs.groupBy("hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"), F.max("in_base").alias("in_base"))


def find_secrets(docs: DataFrame, text: str = "text", doc: str = "doc_id", owner: Sequence[str] = ("source",), repository: Sequence[str] = ("source", "lang")) -> DataFrame:
    """One row for each document; ``spans`` is an array of structs with kind, place, numbers of
    owners and repositories, and ``live``: held by few of both."""
    rows = cut(scan(docs, text, doc, owner, repository)).withColumn("__row", F.monotonically_increasing_id())
    some = rows.where(F.size("spans") > 0).select("__row", "owner", "repository", F.explode("spans").alias("s")).select("__row", "owner", "repository", "s.*")
    known = cut(ownership(some))
    live = (F.col("n_owners") <= MOST_OWNERS) & (F.col("n_repositories") <= MOST_REPOSITORIES)
    told = some.join(known, "hash").withColumn("live", live).where("kind < 3 or live and (in_base or opaque)")
    one = F.struct("start", "kind", "stop", "n_owners", "n_repositories", "live")
    kept = told.groupBy("__row").agg(F.array_sort(F.collect_list(one)).alias("kept"))
    out = rows.drop("spans").join(kept, "__row", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,n_owners:bigint,n_repositories:bigint,live:boolean>>")
    return out.select("doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("kept", none).alias("spans"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source owns its documents, those of one language being a repository of it."""
    out = find_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    said = F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
    classes = F.transform("spans", lambda s: F.when(s["live"], "live").otherwise("example"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(said, ",").alias("spans"), F.array_join(classes, ",").alias("classes"))


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


def _oracle() -> str:
    """Places from the lengths of the matches and of the pieces between them."""
    head, tail = ASSIGN.split(")", 1)
    patterns = [_either_case(head) + ")" + tail, ACCESS, HEX, BARE]
    found = " UNION ALL ".join(f"SELECT rid, source, lang, {k} AS kind, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d" for k, p in enumerate(x.replace("'", "''") for x in patterns))
    value = f"CASE WHEN kind = 0 THEN regexp_extract(m, '{patterns[0].replace(chr(39), chr(39) * 2)}', 2) ELSE m END"
    span = f"[{', '.join(repr(k) for k in KINDS)}][kind + 1] || ':' || a || ':' || e"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
f AS ({found}),
g AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0),
s AS (SELECT rid, source, lang, kind, ms[i] AS m, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint AS a FROM g),
v AS (SELECT *, a + length(m) AS e, {value} AS raw FROM s),
b AS (SELECT *, trim(raw, '.') AS v FROM v WHERE kind IN (1, 2) OR kind = 0 AND length(raw) >= 6 OR kind = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')),
c AS (SELECT * FROM b WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM b x WHERE x.rid = b.rid AND x.kind < 3 AND x.a < b.e AND b.a < x.e)),
o AS (
  SELECT v, bool_or(kind < 3) AS in_base,
         count(DISTINCT coalesce('s' || source, 'n')) <= {MOST_OWNERS} AND count(DISTINCT coalesce('s' || source, 'n') || chr(1) || coalesce('s' || lang, 'n')) <= {MOST_REPOSITORIES} AS live
  FROM c GROUP BY v),
k AS (
  SELECT c.*, live, {span} AS said FROM c JOIN o USING (v)
  WHERE kind < 3 OR live AND (in_base OR length(m) >= {OPAQUE} AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]'))),
z AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(said, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY a, kind) AS spans,
         string_agg(CASE WHEN live THEN 'live' ELSE 'example' END, ',' ORDER BY a, kind) AS classes
  FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(classes, '') AS classes
FROM d LEFT JOIN z USING (rid)"""


ORACLE = _oracle()
