from bagspark.llm.quality_rules import quality_rules
from tests.llm.helpers import corpus, frame, words


def plain(text):
    text = text or ""
    w = words(text)
    runs = {}
    for k in range(len(w) - 7):
        runs.setdefault(tuple(w[k : k + 8]), []).append(k)
    inside = {k + j for at in runs.values() if len(at) > 1 for k in at for j in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n)


def test_counts_equal_brute_force(spark):
    repeated = "a b c d e f g h " * 5
    rows = corpus(4) + [(1, repeated), (2, repeated + " ".join(f"u{k}" for k in range(300))), (3, "# * $ % & | < >\n# * $\n# * $\n \n \n"), (3, None), (None, "a b"),
                        (4, "w " * 5000), (5, " ".join(f"t{k % 7}" for k in range(100)))]
    out = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(frame(spark, rows)).collect()), key=str)
    assert out == sorted(((i, *plain(t)) for i, t in rows), key=str)


def test_clean_prose_is_kept_and_junk_is_not(spark):
    prose = "The house of the man is in the old part of town and it was built with stone for his family. " * 1
    other = " ".join(f"word{k} the" for k in range(60))
    junk = [" ".join(f"w{k}###" for k in range(80)), "\n".join(["same old line of the text"] * 30), "word" * 20 + " " + "x" * 400 + " a" * 25]
    kept = {r.doc_id: r.kept for r in quality_rules(frame(spark, list(enumerate([prose, other, *junk])))).collect()}
    assert kept == {0: True, 1: True, 2: False, 3: False, 4: False}


def test_one_projection_without_python_or_shuffle(spark):
    plan = quality_rules(frame(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert quality_rules(frame(spark, [])).collect() == []
