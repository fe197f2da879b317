import hashlib
import random
import re

from skyquilt.llm import secrets

PATTERNS = [("assign", re.compile(secrets.ASSIGN, re.I | re.A)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]


def base(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            if len(m.group(2) if k == 0 else m.group()) >= (6, 20, 24)[k]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def texts():
    rng = random.Random(4)
    bits = ["token=abc", "secret=token:abcdefgh", 'PassWord" : "hunter22', "api_key=", "APIKEY=x.y-z_1", "AKIA" + "Q" * 16, "AKIAAKIA" + "7" * 12, "AKIA123", "deadbeef" * 3, "0" * 23, "é", " ", "\n", "ſecret=aaaaaaa", "passwd='''qqqqqqq", "Zx9" * 9, "token:=abcde", "token = \u00e9abcdefg"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, "", "a" * 200000, "token=abcdef " * 3000]


def test_base_spans(spark):
    some = texts()
    df = spark.createDataFrame([(i, t, f"s{i % 5}", "en", "q", "r") for i, t in enumerate(some)], "doc_id long, text string, source string, lang string, spans string, hash string")
    for r in secrets.find_secrets(df).collect():
        want = base(some[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k + ":") for x in want) for k in ("assign", "access", "hex")]
        assert [f"{secrets.KINDS[s.kind]}:{s.start}:{s.stop}" for s in r.spans if s.kind < 3] == want


def brute_spans(rows):
    """Spans and classes of (text, owner, repository) rows, by counting sets of owners."""
    wide, found, holders = re.compile(secrets.BARE), [], {}
    for text, owner, repository in rows:
        spans = []
        for k, (_, p) in enumerate([*PATTERNS, ("bare", wide)]):
            for m in p.finditer(text or ""):
                value = m.group(2) if k == 0 else m.group()
                if len(value) < (6, 20, 24, 8)[k] or k == 3 and not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
                    continue
                spans.append((m.start(), k, m.end(), value.strip(".")))
        spans = [x for x in spans if x[1] < 3 or not any(y[1] < 3 and y[0] < x[2] and x[0] < y[2] for y in spans)]
        for _, k, _, v in spans:
            owners, repositories, base = holders.setdefault(v, (set(), set(), []))
            owners.add(owner)
            repositories.add(repository)
            base.append(k < 3)
        found.append(sorted(spans))
    out = []
    for spans in found:
        kept = []
        for s, k, e, v in spans:
            owners, repositories, base = holders[v]
            live = len(owners) <= secrets.MOST_OWNERS and len(repositories) <= secrets.MOST_REPOSITORIES
            opaque = len(v) >= secrets.OPAQUE and re.search("[a-z]", v) and re.search("[A-Z]", v)
            if k < 3 or live and (any(base) or opaque):
                kept.append((k, s, e, len(owners), len(repositories), live))
        out.append(kept)
    return out


def test_ownership_against_brute_force(spark):
    rng = random.Random(9)
    values = [f"v{i}x{'9' * (i % 9)}.q" + "Zz" * (i % 11) for i in range(60)] + [f"plain{i}word9" for i in range(90)] + ["Ab3" * 8, "deadbeef" * 4, "AKIA" + "R7" * 9]
    form = ["token={}", "password: {}", "{}", "see {} there", "secret='{}'"]
    rows = [(i if i % 17 else None, " \n".join(rng.choice(form).format(rng.choice(values)) for _ in range(rng.randint(0, 4))) or None, rng.choice([None, "", "n", "s1", "s2", "s3"]), rng.choice([None, "en", "de"])) for i in range(150)]
    rows += rows[:3]
    got = secrets.find_secrets(spark.createDataFrame([(*r, "h", "k") for r in rows], "doc_id long, text string, source string, lang string, hash string, kind string")).collect()
    want = brute_spans([(t, s, (s, g)) for _, t, s, g in rows])
    have = sorted((str(r.doc_id), [(s.kind, s.start, s.stop, s.n_owners, s.n_repositories, s.live) for s in r.spans]) for r in got)
    assert have == sorted((str(r[0]), w) for r, w in zip(rows, want))
    kinds = [(k, live) for w in want for k, *_, live in w]
    assert {(3, True), (0, True)} <= set(kinds)


def test_pasted_password(spark):
    """Assigned in one document, bare in another: frequency adds the bare one, unless everybody has it."""
    rows = [(1, "password=hunter2x99", "a", "en"), (2, "look: hunter2x99 and other7words", "a", "de"), (3, "token=EXAMPLE123", "a", "en")] + [(10 + i, "use EXAMPLE123 here", f"o{i}", "en") for i in range(5)]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert [(s.kind, s.start, s.stop, s.live) for s in got[2].spans] == [(3, 6, 16, True)]
    assert [(s.kind, s.live, s.n_owners) for s in got[3].spans] == [(0, False, 6)] and all(got[10 + i].spans == [] for i in range(5))


def test_twin(spark, tmp_path):
    import duckdb

    some = [t for t in texts() if t is None or len(t) < 5000] + ["use hunter22 x", "Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9", "secret=é token=abcdef9."]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, f"s{i % 3}", "en") for i, t in enumerate(some)], "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(path)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = secrets.op6_secret_scans(spark, str(tmp_path))
    want = duckdb.sql(secrets.ORACLE)
    assert sorted(map(str, got.select(*want.columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, want.df().itertuples(index=False, name=None)))


def test_no_rows(spark):
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string, source string, lang string")).count() == 0
