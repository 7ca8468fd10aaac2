"""Words that a polynomial hash takes for one another stay apart."""

from collections import Counter

import numpy as np

from featurelab.llm import common, hmm, ngram_join

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def thue_morse(bits):
    """A word of letters a and b, and the word with both exchanged."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_are_those_of_different_words_only():
    words = [w for bits in range(15) for w in thue_morse(bits)] + ["x" * n for n in range(1, 300)] + ["é" * n for n in range(1, 80)]
    data = " ".join([*words, *words[::-1]]).encode()
    h, first, starts, ends = common.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    by_word = {data[a:b].decode(): int(x) for x, a, b in zip(h, starts, ends)}
    assert len(h) == 2 * len(words) and first.tolist() == [0, len(h)]
    assert h.tolist() == [by_word[w] for w in [*words, *words[::-1]]] and len(set(by_word.values())) == len(set(words))


def test_the_join_links_no_different_words(spark):
    rows = [(100 * bits + 10 * k + copy, word, "en", "s", 1) for bits in range(10, 15) for k, word in enumerate(thue_morse(bits)) for copy in range(2)]
    got = {r.doc_id: r.component_id for r in ngram_join.document_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i // 10 * 10 for i, *_ in rows}


def test_the_language_model_knows_seen_words_only(spark):
    pairs = [thue_morse(bits) for bits in range(10, 15)]
    base = hmm.held_out(spark.createDataFrame([(i, "", "en", "s", 1) for i in range(60)], DOCS)).collect()
    train, held = ([r.doc_id for r in base if r.held_out == x] for x in (False, True))
    rows = [(i, " ".join(a for a, _ in pairs) + " some words", "en", "s", 1) for i in train] + [(i, f"{a} {b} some", "en", "s", 1) for i, (a, b) in zip(held, pairs)]
    got = {r.doc_id: r for r in hmm.score_texts(hmm.held_out(spark.createDataFrame(rows, DOCS))).collect()}
    counts = Counter(w for i, t, *_ in rows if i in train for w in t.split())
    for i, text, *_ in rows:
        assert got[i].n_known == sum(w in counts for w in text.split()) + 1
    assert {got[i].n_known for i, _ in zip(held, pairs)} == {3}
