"""Quality ledger against a plain reading of its rules."""

import re
from collections import Counter

from loomery.llm import quality


def brute(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return (len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures(spark, odd):
    texts = ["a\nb\na\n\n c \na", "# * | x\n" * 5, "one two three four five six seven eight " * 3, "x", "\x0b\x0c a b c", None]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    got = sorted((tuple(r) for r in quality.ledger(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
    assert got == sorted(brute(r.text) for r in docs.collect())


def test_policies_and_ablation(spark, odd):
    ledger = quality.ledger(odd)
    rows = quality.verdicts(ledger, "base").collect()
    assert all(r.kept == (r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words) for r in rows)
    table = {(r.policy, r.rule): r for r in quality.ablation(ledger).collect()}
    assert table["base", "few_words"].n_failed == sum(r.n_words < 20 for r in rows)
    assert table["base", "few_words"].n_kept == sum(r.kept for r in rows)
    assert table["base", "few_words"].n_kept_without == sum(100 * r.n_repeat_words <= 30 * r.n_words for r in rows)
    assert table["v2", "few_words"].n_failed_alone <= table["v2", "few_words"].n_failed


def test_screen_keeps_columns_and_clean_texts(odd, none):
    kept = quality.screen(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, 8, None, 9, 10, 2**62}
    assert kept.where("doc_id = 8").count() == 2
    assert quality.screen(none).count() == 0 and quality.ledger(none).count() == 0
