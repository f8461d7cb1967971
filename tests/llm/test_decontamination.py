import random
from collections import Counter

import pytest

from bagspark.llm import decontamination
from bagspark.llm.decontamination import contaminated, decontaminated
from tests.llm.helpers import frame, lower, words


def plain(rows, items):
    """Brute force over every window of every text that shares a shingle: {(doc, item): similarity}."""
    out, texts = {}, [(doc, words(lower(text))) for doc, text in rows]
    runs = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    held = {k: [set(runs(w, k)) for _, w in texts] for k in range(1, 6)}
    for item, itext in items:
        goal = words(lower(itext))
        k = min(5, len(goal))
        y = Counter(runs(goal, k)) if goal else {}
        for (doc, w), own in zip(texts, held[k] if goal else ()):
            for a in range(max(1, len(w) - len(goal) + 1)) if own & set(y) else ():
                x = Counter(runs(w[a : a + len(goal)], k))
                value = sum((x & y).values()) / max(sum((x | y).values()), 1)
                if value >= 0.75 and value > out.get((doc, item), 0):
                    out[doc, item] = value
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(15, 60)))) for k in range(40)] + [(90, "just three words"), (91, "One"), (92, None), (93, ""), (94, "a b c d e f a b c d e f a b c d")]
    rows = []
    for d in range(150):
        w = [word() for _ in range(rng.randrange(0, 120))]
        if d % 2:
            planted = words(rng.choice(items)[1])
            for _ in range(rng.randrange(4)):
                if planted:
                    planted[rng.randrange(len(planted))] = word()
            if d % 3 == 0:
                planted = planted[: int(len(planted) * 0.85)]
            at = rng.randrange(len(w) + 1)
            w[at:at] = planted
        rows.append((d, " \n".join(w)))
    return rows + [(200, None), (201, ""), (202, items[0][1].upper()), (203, "x just three words y"), (204, " ".join([items[1][1]] * 400)), (None, items[2][1])], items


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("part", [16 << 20, 2000])
def test_equals_brute_force(spark, monkeypatch, case, part):
    monkeypatch.setattr(decontamination, "PART_BYTES", part)
    rows, items = case
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(frame(spark, rows), bench(spark, items)).collect()}
    assert got == pytest.approx(plain(rows, items))


def test_clean_rows_stay_whole(spark, case):
    rows, items = case
    dirty = {d for d, _ in plain(rows, items)}
    out = decontaminated(frame(spark, rows), bench(spark, items))
    assert out.columns == frame(spark, []).columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {r for r in rows if r[0] not in dirty}


def test_empty_tables(spark, case):
    rows, items = case
    assert contaminated(frame(spark, []), bench(spark, items)).collect() == []
    assert contaminated(frame(spark, rows), bench(spark, [])).collect() == []
    assert decontaminated(frame(spark, rows), bench(spark, [])).count() == len(rows)
