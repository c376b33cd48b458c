import re
from collections import Counter

import pyarrow as pa

from ripplework.llm.quality_rules import _judge, judge_documents

TEXTS = [
    "", None, " \n\t", "one two three", "plain words stand here in a line that is long enough to stay",
    "a b c d e a b c d e f g h i j k l m n o p", "x " * 40, "dup line here\ndup line here\n\n\ndup line here\nand some other words to follow on now",
    "home | about | news | more | last\n" * 3 + "short end", "w*** x$$$ y### z%%% q&&& r<<< s>>> t*** u### v***",
    "these are words of a good text and there are enough of them here\nAll rights reserved.", "é\x1cü\x85ö ß " * 6, "long " + "z" * 50000,
    "very very very very very very bad bad bad bad bad bad line", "good words one two three four five six seven eight nine ten\n" * 2,
    "This whole text is licensed under the terms of some public license.\nAll rights reserved.",
]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {p for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), failed


def test_base_and_verdict(spark):
    rows = [(i if i % 5 else None, t, True) for i, t in enumerate(TEXTS + TEXTS[:3])]
    got = judge_documents(spark.createDataFrame(rows, "doc_id long, text string, kept boolean").repartition(3)).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in got) == Counter((d, *base(t)) for d, t, _ in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = {r["cleaned"] for r in got if r["kept"]}
    assert TEXTS[4] in kept and TEXTS[10].split("\n")[0] in kept  # the boilerplate line went, the text stayed
    assert all(t.split() for t in kept)  # nothing but boilerplate goes as a whole
    assert not any("***" in t or "very very" in t for t in kept)
    assert judge_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lost_lines_count():
    """Whatever rule removes a line, its words are lost: the text goes if they are more than half."""
    good = "these are words of a good text and there are enough of them here."
    cases = {
        "marks": "a** b$$ c%% d##", "bars": "one|two|three|four", "separators": "Home > Products > Tools", "links": "see https://x.example/a",
        "punctuation": "-- ** --", "capitals": "BUY ALL THE THINGS NOW", "stutter": "go go go go go now", "phrase": "Accept cookies to go on with this",
        "short phrase": "Read more", "bullets": "first \u2022 second \u2022 third",
    }
    for name, line in cases.items():
        for n, kept in ((1, True), (40, False)):
            text = "\n".join([good, *[f"{line}"] * n])
            got = judged([text])
            assert got["n_failed_lines"] == [n], name
            assert got["cleaned"] == [good] and got["n_left_words"] == [14], name
            if not got["base_failed"][0]:
                assert list(got["kept"]) == [kept], name
    varied = [f"Click here for item {k} of {k * k} in the list of {k + 3}" for k in range(70)]
    got = judged(["\n".join([good, *varied])])
    assert not got["kept"][0] and not got["base_failed"][0] and got["n_lost_words"][0] == 70 * 12


def test_menus():
    menu = "\n".join(["Home", "About us", "Our shop", "Contact"])
    prose = "\n".join(["this text has a title and goes on for long enough to stay here.", "Yes.", "No!", "Why?", "Title", "Part two", "One more"])
    got = judged([f"{prose}\n{menu}", prose, f"{prose}\nand an end that parts them from the rest.\n{menu}\n\n \nLast entry"])
    assert got["n_failed_lines"] == [7, 0, 5]  # blank lines part no menu; a run goes on over them
    assert "Home" not in got["cleaned"][2] and got["cleaned"][1] == prose


def judged(texts):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    return _judge()(batch)


def test_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = judge_documents(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert judged.where("n_words >= 10 AND quality = 1 AND NOT kept AND NOT base_failed").count() == 0  # the rules themselves take no good text
    counts = {(r["quality"], r["kept"]): r["count"] for r in judged.where("n_words >= 10").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.03 * counts[1, True] and counts.get((0, True), 0) <= 0.05 * counts[0, False]
