import hashlib
import re

from pyspark.sql import functions as F

from lexlake.llm import pii as P

from .conftest import EDGES, make_docs

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def check(found, rows):
    want = []
    for doc_id, text in rows:
        spans = base(text)
        want.append((str(doc_id), *(sum(s[3] == k for s in spans) for k, _ in KINDS), hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), *(r[f"n_{k}"] for k, _ in KINDS), r["base_sha256"]) for r in found) == sorted(want)
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(str(doc_id), []).append({f"{s[3]}:{s[0]}:{s[2]}" for s in base(text)})
    for r in found:
        assert any(own <= set(r["spans"].split(",")) for own in texts[str(r["doc_id"])])


ODD = [
    "a@b.c_d@e.f x.y@z", "a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.4 1.1.1", "4111-1111-1111-1111 4111 1111 1111 1112 12  34", "+1 (017) 555-7713 + 12 +1234567 +123456789()", "é😀 1.1.1.1 😀 a@b.cc",
    "9" * 30_000, "1.1." * 20_000, "a" * 50_000 + "@b.c", "a.a@" * 5000, "@" * 1000, "+1" * 3000, "a@" + "b." * 30_000 + "c", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
]


def test_edges(edge_docs, no_docs):
    check(P.find(edge_docs).collect(), [(r[0], r[1]) for r in EDGES])
    assert P.find(no_docs).collect() == [] and P.redact(no_docs).collect() == []


def test_odd_texts(spark):
    rows = list(enumerate(ODD))
    check(P.find(make_docs(spark, rows)).collect(), rows)


def test_documents(docs):
    check(P.find(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def secrets(n):
    plain = [(k, f"ordinary words number {k} and nothing else 1999-{k} of version {k}.2") for k in range(n)]
    told = [(n + k, f'set token = "{hashlib.sha1(str(k).encode()).hexdigest()}" and mail me{k}@mail.example.com from 10.0.0.{k % 250} now') for k in range(n)]
    named = [(2 * n + k, f"the file {hashlib.md5(str(k).encode()).hexdigest()}.bin was built {'a' * 20} times") for k in range(n)]
    return plain, told, named


def test_trees_add_secrets_and_leave_clean_texts_alone(spark):
    plain, told, named = secrets(120)
    found = {r["doc_id"]: r["spans"] for r in P.find(make_docs(spark, plain + told + named)).collect()}
    assert all("secret:13:53" in found[k] for k, _ in told)
    assert all(found[k] == "" for k, _ in plain + named)


def hits(spark, rows):
    return {r["doc_id"] for r in P.find(make_docs(spark, rows)).collect() if "secret:" in r["spans"]}


def sha(k):
    return hashlib.sha1(str(k).encode()).hexdigest()


def test_tokens_that_nothing_announces_are_found(spark):
    """Cue words make labels and are no features: trees know tokens by their format. Recall on the unannounced alone, precision against names and numbers."""
    plain, told, named = secrets(200)
    bare = [(1000 + k, f"then {sha(1000 + k)} came by") for k in range(50)]
    quoted = [(2000 + k, f'then "{sha(2000 + k)}" came by') for k in range(60)]
    numbers = [(3000 + k, f"order 2024-{k:04d}-{k * 7919 % 10000:04d} weighs {k}.5 and the Donaudampfschifffahrt goes on") for k in range(200)]
    found = hits(spark, plain + told + named + bare + quoted + numbers)
    for rows in (bare, quoted, told):
        assert len({k for k, _ in rows} & found) >= 0.9 * len(rows)
    wrong = {k for k, _ in plain + named + numbers} & found
    assert len(wrong) <= 0.1 * len(found)
    assert not {"cue", "luhn", "digits", "ending", "before_sign", "before_quote"} & set(P.FEATURES)


def test_a_format_that_is_seldom_announced_is_left_alone(spark):
    """Most 20-digit tokens are plain; a few stand behind a cue word by chance."""
    digits = lambda k: str(int(sha(k), 16))[:20]
    plain = [(k, f"parcel {digits(k)} has come") for k in range(200)]
    told = [(1000 + k, f"the key {digits(5000 + k)} has come") for k in range(20)]
    assert not hits(spark, plain + told) & {k for k, _ in plain}


def test_thresholds():
    pure = [(0.9, 80, 80), (0.5, 20, 19), (0.1, 100, 0)]
    assert P._threshold(pure, False) == 0.5 and P._threshold(pure, True) == 0.5
    half = [(0.6, 100, 60), (0.5, 10, 6), (0.1, 300, 0)]
    assert P._threshold(half, True) == 0.5 and P._threshold(half, False) is None
    assert P._threshold([(0.3, 100, 30), (0.1, 50, 0)], True) is None and P._threshold([], True) is None and P._threshold([(0.2, 9, 0)], True) is None


def test_added_spans_that_overlap_a_third_but_not_each_other_both_stay(spark):
    spans = [("number", 0, 10, 0.9), ("secret", 8, 20, 0.95), ("number", 19, 30, 0.9), ("secret", 40, 50, 0.5), ("number", 40, 52, 0.5), ("address", 48, 60, 0.4)]
    rows = spark.createDataFrame([(sorted((-p, s - e, s, k, e) for k, s, e, p in spans),)], "spans array<struct<worse:double,shorter:int,start:int,kind:string,end:int>>")
    chosen = {(s["kind"], s["start"]) for s in rows.select(P._best(F.col("spans")).alias("s")).first()["s"]}
    assert chosen == {("secret", 8), ("number", 40)}
    wide = [("secret", 5, 25, 0.5), ("number", 0, 10, 0.9), ("number", 20, 30, 0.9)]
    rows = spark.createDataFrame([(sorted((-p, s - e, s, k, e) for k, s, e, p in wide),)], rows.schema)
    assert {s["start"] for s in rows.select(P._best(F.col("spans")).alias("s")).first()["s"]} == {0, 20}


def test_redaction(spark):
    plain, told, named = secrets(120)
    docs = make_docs(spark, plain + told + named + told[:1])
    left = P.redact(docs)
    rows = left.collect()
    assert left.columns == docs.columns and len(rows) == 361
    for r in rows:
        want = dict(plain + named).get(r["doc_id"], 'set token = "[SECRET]" and mail [EMAIL] from [IP] now')
        assert r["text"] == want and r["n_chars"] == len(want)


def test_null_texts_stay_null(edge_docs):
    assert {r["text"] for r in P.redact(edge_docs).where("doc_id = 1").collect()} == {None}
