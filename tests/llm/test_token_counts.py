from ripplework.llm.token_counts import MARK, ScoredTrie, count_tokens, piece_scores

SCORES = piece_scores()


def naive(word):
    """(score, tokens) over all cuts, by recursion from the end; of equal scores, the longest last piece."""
    text = MARK + word
    best = {0: (0.0, 0)}
    stranger = min(SCORES.values()) - 10
    for end in range(1, len(text) + 1):
        options = [(best[end - 1][0] + stranger, best[end - 1][1] + len(text[end - 1].encode()), 0)]
        options += [(best[k][0] + SCORES[text[k:end]], best[k][1] + 1, end - k) for k in range(end) if text[k:end] in SCORES]
        best[end] = max(options, key=lambda x: (x[0], x[2]))[:2]
    return best[len(text)][1]


def test_counts(spark):
    texts = ["the thing things thin", "", None, "ünïcödé 漢字🙂 the", "a" * 300, "x", "international internationally", " \n\t "]
    rows = [(i if i != 2 else None, t, 9) for i, t in enumerate(texts + texts[:2])]
    got = sorted(map(str, count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()))
    want = [(d, len((t or "").split()), sum(naive(w) for w in (t or "").split())) for d, t, _ in rows]
    assert got == sorted(f"Row(doc_id={d}, n_words={n}, n_tokens={k})" for d, n, k in want)
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_prefixes_change_nothing():
    words = sorted({w for k in range(40) for w in (f"under{k}", f"unders{k}tand", "u" * k)} - {""})
    trie = ScoredTrie(SCORES)
    assert trie.counts(words) == {w: naive(w) for w in words}
