"""Personal data: exact base patterns, and identifiers that bootstrapped contexts reveal. DataFrame operations only.

Base kinds (email, ip, card, phone) are found by their patterns, leftmost and without overlap within a kind; matches that
fail their check are dropped. The patterns are written with possessive repeats and start guards, so that a long run of
digits or letters is read once; both keep exactly the matches of the plain patterns.

Beyond these, identifiers are found by bootstrapping: a candidate is a token with a digit or an at sign in it (letters,
digits, _ + - / % @, dots inside, = signs at its end), or numbers that spaces and parentheses join; it has 8 characters at
least, and no most. The word and the marks before it are one lexical pattern, the marks and the word after it another; keys
may have digits, hyphens and underscores, and marks may be quotes, brackets or spaces alone. Seeds are candidates that
overlap base matches, of any length, and those of a secret's shape (32 or more hex digits with both letters and digits).
Patterns and values form a graph, and each of ROUNDS rounds scores them in turn: a pattern by the mean score of its distinct
values, with a prior for rarely seen ones, and a value by its best pattern; seeds keep the score 1. Patterns of at least
MIN_VALUES values and MIN_SCORE then mark all their candidates as the kind `id`, seen before or not, except where base
matches stand. Of a context, the 72 nearest characters are read.

Defined cases: a null or empty text has no spans; rows that share a doc_id are kept apart; a null doc_id passes through;
repeated rows give repeated results, and count once as evidence; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of, text_of

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_C = "A-Za-z0-9_+/%@-"
_START = rf"(?<![{_C}])(?<![{_C}]\.{{1,2}})"
_NUMBER = rf"[0-9]++(?:[.-][0-9]++)*+(?![{_C}]|\.{{1,2}}[{_C}])"
_NUMBERS = rf"\+?+{_NUMBER}(?:[ ()]{{1,3}}+{_NUMBER})++"
_TELLING = r"(?=[A-Za-z_+/%-]*+(?:\.{1,2}+[A-Za-z_+/%-]++)*+(?:\.{1,2}+)?+[0-9@])"
#: Tokens below MIN_LENGTH are of use only as base matches, which have a dot in them.
MIN_LENGTH = 8
_TOKEN = rf"{_TELLING}(?=[.{_C}]{{{MIN_LENGTH - 2}}}[.={_C}]{{2}}|[{_C}]++\.[{_C}])[{_C}]++(?:\.{{1,2}}+[{_C}]++)*+(?:={{1,2}}+(?![{_C}]))?+"
#: Numbers that spaces join, or a token; each is read a bounded number of times, however long.
CANDIDATE = rf"{_START}(?:{_NUMBERS}|{_TOKEN})"
#: Characters of context, and the word and marks at its near end.
REACH = 72
_WORD, _MARKS = r"[\p{L}\p{N}_-]{1,64}", r"[^\p{L}\p{N}_-]{1,8}"
BEFORE = rf"({_WORD})({_MARKS})\z"
AFTER = rf"\A({_MARKS})({_WORD})"
SECRET = r"^(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,}$"
ROUNDS = 3
MIN_VALUES = 3
MIN_SCORE = 0.6
#: Values of the score 0 that every pattern starts with.
PRIOR = 1.0

MATCH = "struct<value:string,start:int,end:int>"
SPAN = "struct<kind:string,start:int,end:int,rank:int>"


def _found(text: Column, pattern: str, maybe: Column) -> tuple[Column, Column]:
    """Matches, and the texts between them, of texts that may have any."""
    none = F.array().cast("array<string>")
    return F.when(maybe, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).otherwise(none), F.when(maybe, F.split(text, pattern, -1)).otherwise(none)


def _once(value: Column, use) -> Column:
    """use(value), with value evaluated once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _in_chunks(items: Column, zero: Column, step, kind: str) -> Column:
    """One array of what step(at, chunk) gives for chunks of an array, in order; kind: the type of its elements.

    step returns struct(at, out: array): what goes on to the next chunk, and the chunk's part of the result. An array that
    grows by an element a step is copied with each; chunks of the square root's size keep the copies few at any length.
    """

    def run(bound: Column) -> Column:
        xs, size = bound["xs"], bound["size"]
        start = F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))

        def chunk(state: Column, first: Column) -> Column:
            done = _once(F.slice(xs, first + 1, size), lambda own: step(state["at"], own))
            return _once(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

        firsts = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1, size)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(firsts, start, chunk, lambda s: F.flatten(s["out"]))

    sized = lambda xs: F.struct(xs.alias("xs"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int")).alias("size"))
    return _once(_once(items, sized), run)


def _placed(matches: Column, between: Column) -> Column:
    """array<struct(value, start, end)> from the matches and what stands between them, in code points."""

    def chunk(at: Column, xs: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(f"array<{MATCH}>").alias("out"))

        def step(state: Column, x: Column) -> Column:
            begin = state["at"] + x["gap"]
            end = begin + F.length(x["value"])
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(x["value"].alias("value"), begin.alias("start"), end.alias("end")))).alias("out"))

        return F.aggregate(xs, start, step)

    pairs = _once(between, lambda gaps: F.transform(matches, lambda m, i: F.struct(m.alias("value"), F.length(F.get(gaps, i)).alias("gap"))))
    return _in_chunks(pairs, F.lit(0), chunk, MATCH)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small)
    n = F.length(_digits(value))
    return n.between(9, 15) if kind == "phone" else n.between(12, 19) & F.when(n.between(12, 19), _luhn(value)).otherwise(False)


def _maybe(kind: str) -> Column:
    text = F.col("text")
    return {
        "email": F.contains(text, F.lit("@")) & F.contains(text, F.lit(".")),
        "ip": F.contains(text, F.lit(".")) & text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike("[0-9][ -]?[0-9]"),
        "phone": F.contains(text, F.lit("+")),
    }[kind]


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with `base`: array of (kind, start, end, rank) by start, then kind as listed."""
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
    own: dict[str, Column] = {}
    for kind, pattern in patterns.items():
        own[f"_m_{kind}"], own[f"_b_{kind}"] = _found(F.col("text"), pattern, _maybe(kind))
    docs = docs.withColumns(own)
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(r).alias("rank"), F.col(f"_m_{k}").alias("m"), F.col(f"_b_{k}").alias("b")) for r, k in enumerate(KINDS)))

    def spans(of: Column) -> Column:
        valid = lambda x: F.when(of["kind"] == "email", F.lit(True)).when(of["kind"] == "ip", _valid("ip", x["value"])).when(of["kind"] == "card", _valid("card", x["value"])).otherwise(_valid("phone", x["value"]))
        good = F.filter(_placed(of["m"], of["b"]), valid)
        return F.transform(good, lambda x: F.struct(of["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), of["rank"].alias("rank")))

    found = F.flatten(F.transform(F.filter(each, lambda k: F.size(k["m"]) > 0), spans))
    return docs.withColumn("base", _by_place(found)).drop(*own)


def _by_place(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["rank"].alias("b"), s["end"].alias("c"), s["kind"].alias("d")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["d"].alias("kind"), s["a"].alias("start"), s["c"].alias("end"), s["b"].alias("rank")))


def _near_word(side: str, pattern: str, word: int) -> Column:
    """The lower-cased word of a context with its marks, less quotes and white space; null where there is none."""
    context = F.col(side)
    marks = F.regexp_replace(F.regexp_extract(context, pattern, 3 - word), "[\\s\"'`]", "")
    marks = F.when(marks == "", " ").otherwise(marks)
    key = F.lower(F.regexp_extract(context, pattern, word))
    return F.when(context.rlike(pattern), F.concat(key, marks, F.lit("_")) if side == "before" else F.concat(F.lit("_"), marks, key))


def _overlapping(placed: Column, base: Column) -> Column:
    """placed with in_base: whether a base span overlaps. Each chunk looks at the base spans in its own stretch alone."""
    kind = "struct<value:string,start:int,end:int,in_base:boolean>"

    def chunk(at: Column, xs: Column) -> Column:
        ends = F.struct(F.element_at(xs, 1)["start"].alias("low"), F.element_at(xs, -1)["end"].alias("high"))
        inside = _once(ends, lambda e: F.filter(base, lambda s: (s["start"] < e["high"]) & (s["end"] > e["low"])))

        def marked(near: Column) -> Column:
            hit = lambda x: F.exists(near, lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"]))
            return F.transform(xs, lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), x["end"].alias("end"), hit(x).alias("in_base")))

        return F.struct(at.alias("at"), _once(inside, marked).alias("out"))

    return _in_chunks(placed, F.lit(0), chunk, kind)


def candidates(docs: DataFrame) -> DataFrame:
    """key, pattern, value (its hash), start, end, in_base, seed of each candidate in docs (key, text, base), once for each of its patterns."""
    some = docs.where(F.col("text").rlike(CANDIDATE)).select("key", "base", *[x.alias(n) for n, x in zip(("m", "b"), _found(F.col("text"), CANDIDATE, F.lit(True)), strict=True)])
    # a neighbouring token can be a word of the context: key1=...
    tail = lambda x: F.substring(x, -REACH, REACH)
    head = lambda x: F.substring(x, 1, REACH)
    or_none = lambda x: F.coalesce(x, F.lit(""))
    before = lambda i: tail(F.concat(tail(or_none(F.when(i > 0, F.get("m", i - 1)))), tail(F.get("b", i))))
    after = lambda i: head(F.concat(head(F.get("b", i + 1)), head(or_none(F.get("m", i + 1)))))
    placed = _overlapping(_placed(F.col("m"), F.col("b")), F.col("base"))
    each = F.transform(placed, lambda x, i: F.struct(x["value"].alias("value"), x["start"].alias("start"), x["end"].alias("end"), x["in_base"].alias("in_base"), before(i).alias("before"), after(i).alias("after")))
    each = some.select("key", F.explode(each).alias("x")).select("key", "x.*").where(F.col("in_base") | (F.length("value") >= MIN_LENGTH))
    each = each.withColumn("pattern", F.explode(F.array_compact(F.array(_near_word("before", BEFORE, 1), _near_word("after", AFTER, 2)))))
    return each.select("key", "pattern", F.md5("value").alias("value"), "start", "end", "in_base", (F.col("in_base") | F.col("value").rlike(SECRET)).alias("seed"))


def score_patterns(found: DataFrame) -> DataFrame:
    """pattern, score, n_values after the rounds over the graph of distinct (pattern, value) pairs; aggregations alone, no pairs of values."""
    edges = materialize(found.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    values = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(ROUNDS):
        patterns = edges.join(values, "value").groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + F.lit(PRIOR))).alias("score"), F.count(F.lit(1)).alias("n_values"))
        patterns = materialize(patterns, "pii-patterns")
        best = edges.join(patterns.select("pattern", F.col("score").alias("of")), "pattern")
        values = best.groupBy("value").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(F.col("of"))).alias("score"))
    return patterns


def find_pii(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, text, base and spans (all of them) as arrays of (kind, start, end, rank), and columns to carry along."""
    docs = rows_of(documents, "doc_id", "text", *carry).withColumn("text", text_of())
    docs = base_spans(docs.withColumn("_key", F.xxhash64("doc_id", "text")))
    found = materialize(candidates(docs.withColumnRenamed("_key", "key")).distinct(), "pii-candidates")
    trusted = score_patterns(found).where((F.col("n_values") >= MIN_VALUES) & (F.col("score") >= MIN_SCORE)).select("pattern")
    added = found.where("NOT in_base").join(trusted, "pattern", "left_semi")
    span = F.struct(F.lit("id").alias("kind"), F.col("start"), F.col("end"), F.lit(len(KINDS)).alias("rank"))
    more = added.groupBy(F.col("key").alias("a_key")).agg(F.collect_set(span).alias("more"))
    joined = docs.join(more, docs["_key"] == more["a_key"], "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(_by_place(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))))
    return joined.select("doc_id", "text", "base", spans.alias("spans"), *carry)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: str) -> Column:
    """The text with each span, and what overlapping spans cover together, replaced by its first kind in brackets."""
    def chunk(at: Column, xs: Column) -> Column:
        """The chunk's stretch of text is cut out once: a cut costs as much as stands before it."""

        def inside(own: Column) -> Column:
            start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))

            def step(state: Column, s: Column) -> Column:
                gap = F.substring(own, state["at"] - at + 1, F.greatest(F.lit(0), s["start"] - state["at"]))
                fresh = s["start"] >= state["at"]
                piece = F.when(fresh, F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
                return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

            return F.aggregate(xs, start, step, lambda s: F.struct(s["at"].alias("at"), F.array(F.array_join(s["out"], "")).alias("out")))

        return _once(F.substring(F.col(text), at + 1, F.array_max(F.transform(xs, lambda s: s["end"])) - at), inside)

    end = F.array_max(F.transform(F.col(spans), lambda s: s["end"]))
    rest = F.substring(F.col(text), end + 1, F.length(text))
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(F.concat(F.array_join(_in_chunks(F.col(spans), F.lit(0), chunk, "string"), ""), rest))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n_id = F.size(F.filter("spans", lambda s: s["kind"] == "id")).cast("long").alias("n_id")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), n_id)
