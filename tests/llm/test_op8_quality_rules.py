"""Quality statistics against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from stockledger.llm import quality_rules as Q

STOP = re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(Q.STOP_WORDS) + r")(?![^\W_])")


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if wins[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep),
            len(w) < 20 or 100 * len(rep) > 30 * len(w), sum(a == b for a, b in zip(w, w[1:])),
            sum(x.endswith("!") for x in w), sum(any(c.isalpha() for c in x) for x in w), len(STOP.findall(t)))


def test_statistics(spark):
    rng = random.Random(8)
    vocab = ["the", "Der", "a", "é漢", "x!", "#tag", "<b>", "...", "und,", "1", "\n", "\t", "- item\n", "same line\n"]
    rows = [(i, " ".join(rng.choice(vocab[: rng.randint(2, len(vocab))]) for _ in range(rng.randint(0, 120)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "a b c d e f g h"), (204, "a b c d e f g h " * 2), (205, "a b c d e f g h i " * 3),
             (206, "w" * 50000), (207, "one two three four " * 4000), (None, "x"), (3, rows[3][1]), (208, "\n".join(["same"] * 30))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", F.lit("clash")).withColumn("kept", F.lit(0))
    out = Q.apply_rules(d)
    got = sorted(map(tuple, out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                                       "n_echo_words", "n_exclaimed", "n_alpha_words", "n_stop_words").collect()), key=str)
    assert got == sorted([(i, *brute(t)) for i, t in rows], key=str)
    assert out.where("kept and (base_failed or size(failed) > 0)").count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert Q.apply_rules(d.where("false")).count() == 0


def test_rules_keep_prose_and_drop_junk(spark):
    prose = "The cat of the house is on the mat and it was by the door for a day with this and that. " * 1
    body = prose + "Another of those in town is to be at sea, as are the boats from that harbour on the left."
    junk = {1: " ".join(x + "***" for x in body.split()), 2: " ".join(x + "!!" for x in body.split()), 3: "spam " * 60,
            4: " | ".join(body.split()), 5: "short"}
    rows = [(0, body), *junk.items()]
    got = {r.id: r.kept for r in Q.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False}


def test_empty_tables_give_no_rows_everywhere(spark):
    """Operators that work row by row, and the classifiers with nothing to learn from."""
    from stockledger.llm import language, licenses, quality_model, quality_rules
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.apply_rules(none).count() == 0 and licenses.scan(none).count() == 0
    assert language.identify(none, language.train(none)).count() == 0
    model = quality_model.train(none, labels)
    assert quality_model.score(none, model).count() == 0
    some = spark.createDataFrame([(1, "a text"), (2, None), (3, "a text")], "doc_id long, text string")
    assert [r.score for r in quality_model.score(some, model).collect()] == [0.5] * 3
