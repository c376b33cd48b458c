import hashlib
import random
import re
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from ripplework.llm import pii as P
from ripplework.llm.pii import CANDIDATE, find_pii, masked, op7_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def naive(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


TEXTS = [
    "mail a.b@c.de and x@y.z_w@q.r, not a@b or @c.d",
    "🙂 é 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 00255.0.0.256 0000000255.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 12 34, 4111111111111111",
    "call +1 (017) 555-7713 or +12 345 or ++1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "+4111111111111111 a@1.2.3.4",
    "", None, "9" * 70000, "a." * 40000 + "@b.c", "1 " * 9000, "+1" * 9000, "@" * 500, "plain words alone",
    "5 @ 6 . 7 5500000000000004.1.1.1",
]


def rows_of(spark, texts):
    return spark.createDataFrame([(i if i % 4 else 8, t, 1, "k") for i, t in enumerate(texts)] + [(None, texts[0], 2, "k"), (8, texts[0], 3, "k")], "doc_id long, text string, base int, key string")


def test_base_against_plain_patterns(spark):
    df = rows_of(spark, TEXTS)
    want = Counter((r["doc_id"], tuple(naive(r["text"]))) for r in df.collect())
    got = Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["base"])) for r in find_pii(df).collect())
    assert got == want


def test_query_on_real_rows(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = naive(r["text"])
        want[r["doc_id"]] = [sum(s[0] == k for s in spans) for k in PLAIN] + [hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), spans]
    for r in op7_pii(spark, sf).collect():
        own = want.pop(r["doc_id"])
        assert list(r)[1:6] == own[:5]
        assert {f"{k}:{a}:{b}" for k, a, b in own[5]} <= set(r["spans"].split(",")) | {""}
    assert not want


def test_contexts_reveal_identifiers(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(12)]
    texts = [f'word token = "{h}" more' for h in hexes] + ['other TOKEN = "short1234x" end', "note: chapter12a see: appendix9b", "token was 12345678", "login: a1@mail.example.com"]
    spans = {r["text"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["spans"]] for r in find_pii(rows_of(spark, texts)).collect()}
    assert all(spans[t] == [("id", h)] for t, h in zip(texts, hexes, strict=False))
    assert spans[texts[12]] == [("id", "short1234x")]  # of no seed's shape: the context alone tells
    assert spans[texts[13]] == [] and spans[texts[14]] == []
    assert [k for k, _ in spans[texts[15]]] == ["email"]


def test_contexts_of_any_key_and_value(spark):
    """Keys with _ - digits and quotes, spaces as marks, and values of other characters, long ones and spaced ones."""
    hexes = iter(hashlib.sha1(str(i).encode()).hexdigest() for i in range(99))
    odd = {
        'api_key = "{}" .': "a.b/c+d1e==", "client-secret: {} .": "x@y12345", "key1={};": "ab-12345", '{{"token": "{}"}}': "eyJ0.eyJ1.sig_2-x", "Authorization: Bearer {}": "z1" * 150,
        "passport {}, of": "X1234567", "phone: {} .": "017 555 7713",
    }
    seeded = [(form, next(hexes)) for form in odd for _ in range(6)]
    texts = [form.format(v) for form, v in [*seeded, *odd.items()]]
    spans = {r["text"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["spans"]] for r in find_pii(rows_of(spark, texts)).collect()}
    for text, (_, value) in zip(texts, [*seeded, *odd.items()], strict=True):
        assert spans[text] == [("id", value)], text


def test_base_matches_reveal_contexts(spark):
    texts = [f"mailbox: user{i}@mail.example.com!" for i in range(6)] + [f"host_2 10.0.0.{i} is" for i in range(6)] + ["mailbox: user9@localhost!", "host_2 node-7.local is", "room chapter-12 was"]
    spans = {r["text"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["spans"]] for r in find_pii(rows_of(spark, texts)).collect()}
    assert spans[texts[0]] == [("email", "user0@mail.example.com")] and spans[texts[6]] == [("ip", "10.0.0.0")]
    assert spans[texts[12]] == [("id", "user9@localhost")] and spans[texts[13]] == [("id", "node-7.local")] and spans[texts[14]] == []


def test_long_runs_are_read_once(spark):
    texts = ["a." * 60000, "1 " * 9000 + "x", "1.1" * 30000 + "x", "a-" * 60000, "1." * 40000, "x1=" * 30000]
    df = rows_of(spark, texts).withColumn("n", F.size(F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1))))
    assert {r["text"]: r["n"] for r in df.collect()} == dict(zip(texts, [0, 1, 1, 0, 1, 0], strict=True))


def test_many_matches_in_one_text(spark):
    """Places and masks of thousands of matches in a text, cut in chunks inside, are those of the plain patterns."""
    text = "".join(f"mail u{k}@h{k}.example.org or 10.0.{k % 256}.7, " + ("call +49 170 1234567" if k % 3 else "") + "\u00e9\n" for k in range(3000))
    got = find_pii(rows_of(spark, [text, "none", text[:501]])).select("doc_id", "text", "base", masked("text", "base").alias("clean")).collect()
    for r in got:
        want = naive(r["text"])
        assert [(x["kind"], x["start"], x["end"]) for x in r["base"]] == [tuple(x[:3]) for x in want]
        out, at = [], 0
        for kind, start, end, *_ in want:
            if start >= at:
                out += [r["text"][at:start], f"[{kind}]"]
            at = max(at, end)
        assert r["clean"] == "".join(out) + r["text"][at:]


def test_added_spans_against_brute_force(spark):
    """All candidates, contexts, rounds and thresholds again, in plain Python."""
    rng = random.Random(3)
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = []
    for k in range(60):
        texts.append(f"the key is {token(40)} for now")
        texts.append(f"write to a{k}@b{k}.example.com or ref-{token(12)} today")
        texts.append(f"the key is T{token(10)}7 for {'now' if k % 2 else 'later'} and order {10**8 + k} went out")
        texts.append(f"number {10**9 + 7 * k} of lot={token(9)}1")
    texts.append("the key is " + "x1" * 500 + " for now")
    got = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["spans"]} for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    edges, seeds, places = defaultdict(set), set(), defaultdict(set)
    for i, text in enumerate(texts):
        base = [x[:3] for x in naive(text)]
        found = [m for m in regex.finditer(P.CANDIDATE, text)]
        for m in found:
            inside = any(a < m.end() and b > m.start() for _, a, b in base)
            if not inside and len(m[0]) < P.MIN_LENGTH:
                continue
            if inside or re.search(P.SECRET, m[0]):
                seeds.add(m[0])
            before, after = re.search(r"([\w-]{1,64})([^\w-]{1,8})\Z", text[max(0, m.start() - P.REACH) : m.start()]), re.match(r"([^\w-]{1,8})([\w-]{1,64})", text[m.end() : m.end() + P.REACH])
            bare = lambda x: re.sub(r"[\s\"'`]", "", x) or " "
            for name in ([f"{before[1].lower()}{bare(before[2])}_"] if before else []) + ([f"_{bare(after[1])}{after[2].lower()}"] if after else []):
                edges[name].add(m[0])
                if not inside:
                    places[name].add((i, m.start(), m.end()))
    score = {v: float(v in seeds) for own in edges.values() for v in own}
    for _ in range(P.ROUNDS):
        pattern = {p: sum(score[v] for v in own) / (len(own) + P.PRIOR) for p, own in edges.items()}
        score = {v: 1.0 if v in seeds else max(pattern[p] for p, own in edges.items() if v in own) for v in score}
    want = {x for p in edges if len(edges[p]) >= P.MIN_VALUES and pattern[p] >= P.MIN_SCORE for x in places[p]}
    assert {(i, a, b) for i, own in got.items() for kind, a, b in own if kind == "id"} == want
    assert any(b - a == 1000 for _, a, b in want) and len(want) > 60


def test_masking(spark):
    df = find_pii(rows_of(spark, ["a b@c.de f 10.0.0.1", "none", "+4111111111111111!"]))
    got = {r["text"]: r["m"] for r in df.withColumn("m", masked("text", "spans")).collect()}
    assert got == {"a b@c.de f 10.0.0.1": "a [email] f [ip]", "none": "none", "+4111111111111111!": "+[card]!"}


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert F is not None
