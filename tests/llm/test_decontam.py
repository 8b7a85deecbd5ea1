"""Decontamination on planted stretches and re-parameterised items."""

import random

from reelspan.llm import decontam

ITEMS = [
    (1, "A farmer named Anna sells 12 red apples and then Anna buys 5 km of rope for 12 euros at noon today."),
    (2, "short item of few words only"),
    (3, "every single word of this item has to stand in the text somewhere near"),
    (4, None),
]
SAME = "Filler text first. " + ITEMS[0][1] + " And more after it."
OTHER = SAME.replace("Anna", "Berta").replace("12", "31").replace(" 5 ", " 8 ")
MIXED = SAME.replace("Anna buys", "Clara buys")  # one name of the item stands for two
TWICE = SAME.replace(" 5 ", " 12 ")  # two numbers of the item become one


def found(spark, docs):
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as hash")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "3 as size")
    return docs, items, {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontam.leaks(docs, items).collect()}


def test_templates_and_slots(spark):
    long = "pad " * 30_000 + ITEMS[2][1] + " pad" * 1000
    rows = [(1, SAME), (2, OTHER), (3, MIXED), (4, TWICE), (5, "nothing here at all, only words that no item has in this order"), (6, ""), (7, None), (8, long), (None, SAME), (1, SAME)]
    docs, items, got = found(spark, rows)
    assert got == {(1, 1): True, (2, 1): False, (8, 3): True, (None, 1): True}
    assert sorted(r["doc_id"] for r in decontam.clean(docs, items).collect()) == [3, 4, 5, 6, 7]
    assert decontam.clean(docs, items).columns == docs.columns
    assert decontam.leaks(docs.limit(0), items).count() == 0
    assert decontam.clean(docs, items.limit(0)).count() == len(rows)


def test_part_of_an_item_needs_thirteen_words(spark):
    words = ITEMS[0][1].split()
    _, _, got = found(spark, [(1, " ".join(words[2:15])), (2, " ".join(words[2:14]))])
    assert set(got) == {(1, 1)}


def test_short_and_slot_heavy_items(spark):
    items = [
        (1, "Name the largest moon of Saturn."),
        (2, "1, 1, 2, 3, 5, 8, 13, 21: what comes next?"),
        (3, "Which river flows through the old town of this province?"),
        (4, "12 31 45 7 8 9 10 11 14 99"),
        (5, "What is 17?"),
    ]
    docs = [
        (1, "Quiz. " + items[0][1]), (2, "a 7 " + items[1][1]), (3, "Question 7\n" + items[2][1] + " Answer"), (4, "table 1 " + items[3][1] + " 5"), (5, "say what is 17 then"),
        (6, "name the largest moon of mars"), (7, "1, 1, 2, 3, 5, 8, 13, 21: what went next?"), (8, "the river flows through the old town of this province"), (9, "12 31 45 7 8 9 10 11 14 98"), (10, "what is 18"),
        (11, "We ask: " + items[2][1]),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    # doc 8 lacks only the item's first word
    assert got == {(i, i): True for i in range(1, 6)} | {(11, 3): True}


def test_a_stretch_that_begins_with_a_name(spark):
    words = ITEMS[0][1].split()
    _, _, got = found(spark, [(1, " ".join(words[3:16])), (2, "so said " + " ".join(words[3:16]))])
    assert set(got) == {(1, 1), (2, 1)}


def test_a_changed_slot_does_not_hide_an_unchanged_stretch(spark):
    start = "At dawn Anna opens the small bakery near the river and sells bread to every neighbour who walks past before the school bell rings"
    item = start + " while the old clock of the tower counts slowly through a long and quiet morning until at last the baker closes the shop and thanks Anna for all her help."
    docs = spark.createDataFrame([(1, "Text. " + item[::-1].replace("annA", "atreB", 1)[::-1]), (2, item.replace("Anna", "Berta")), (3, item)], "doc_id long, text string")
    got = {r["doc_id"]: (r["same_values"], r["n_words"]) for r in decontam.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    words = len(item.split())
    assert got == {1: (True, words - 5), 2: (False, words), 3: (True, words)}


def test_spellings_of_letters_alone_need_no_pattern(monkeypatch):
    """Most spellings stand once; each is read as slot reads it, but only those with more than letters between marks go through the patterns."""
    rng = random.Random(4)
    odd = ["Été", "ÉTÉ", "İx", "ǅon", "ß", "漢字", "Km", "km", "M", "m", "Twelve", "12", "5km", "-7%", "$", "€5", "_a_", "a_", "it's", "O'Neil", "x-y", "+", "%a", "-A", "...", "''", "a²", "²", "٣", "a\u0301"]
    marks = "()[].,;:!?\"'-+%$€«»_ "
    words = [w for x in odd for w in (x, x + ".", f"({x})", f'"{x}",')] + ["".join(rng.choice("aBé1" + marks) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    words = [w for x in words for w in x.split()]
    seen, edge = [], decontam._EDGE
    want = [(w, [decontam._code(decontam.slot(w, f)[0]) for f in (True, False)], [decontam.slot(w, f)[1] for f in (True, False)], decontam._code("=" + edge.sub("", w).lower())) for w in words]

    class Counted:
        def sub(self, to, word):
            seen.append(word)
            return edge.sub(to, word)

    monkeypatch.setattr(decontam, "_EDGE", Counted())
    templates = decontam.Templates()
    for w, codes, values, bare in want:
        got = templates.found[templates.place[w]]
        assert [list(got[:2]), list(got[6:]), got[2:4], got[5]] == [codes, values, tuple(v != "" for v in values), bare], w
    assert seen and not any(w.strip(".,()[]!?").isalpha() and w.strip(".,()[]!?").lower() not in decontam.UNITS | decontam.NUMBERS for w in seen)
