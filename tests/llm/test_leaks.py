import random

from parley.llm.leaks import leaks

ITEMS = [
    (1, "A train leaves Paris at 3 km per hour. Then the train from Paris meets 12 cows and 3 dogs near Rome today."),
    (2, "Plain words only that say nothing of any kind of number or name at all, really not one."),
    (3, "Too few"),
    (4, None),
    (5, "four plain little words"),
    (1, "A train leaves Paris at 3 km per hour. Then the train from Paris meets 12 cows and 3 dogs near Rome today."),
]
SAME = "A train leaves London at 7 miles per hour. Then the train from London meets 99 cows and 7 dogs near Oslo today."
LOOSE = "A train leaves London at 7 miles per hour. Then the train from Madrid meets 99 cows and 8 dogs near Oslo today."


def frame(spark, texts):
    rows = [(k, t, 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_templates(spark):
    draw = random.Random(1)
    noise = " ".join(f"w{draw.randrange(99)}" for _ in range(3000))
    texts = [
        f"{noise}. {ITEMS[0][1]} {noise}", f"Before it.\n{SAME}\nafter", f"Before it. {LOOSE} after", noise, "", None,
        ITEMS[1][1].upper() + " tail", "Plain words only that say nothing of any kind", "with four (plain) little words!",
        f"{SAME} {LOOSE}", f"{SAME} {SAME.replace('London', 'Rome').replace('7', '5')}",
    ]
    docs, items = frame(spark, texts + [texts[1]])
    got = {}
    for r in leaks(docs, items).collect():
        got.setdefault(r.doc_id, []).append((r.item_id, r.n_changed > 0))
    assert got == {
        0: [(1, False)], 1: [(1, True)], 11: [(1, True)], 6: [(2, False)], 8: [(5, False)], 9: [(1, True)], 10: [(1, True)],
    }


def test_every_planted_passage_and_no_clean_text(spark):
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 8))) for _ in range(500)]
    sentence = lambda n: " ".join(draw.choices(words, k=n)).capitalize() + "."
    items = [(k, " ".join(sentence(12) for _ in range(3))) for k in range(20)]
    texts, planted = [], set()
    for k in range(120):
        parts = [sentence(draw.randint(3, 30)) for _ in range(20)]
        if k % 3 == 0:
            item = draw.randrange(20)
            parts.insert(draw.randrange(20), items[item][1])
            planted.add((k, item))
        texts.append((k, draw.choice([" ", "\n"]).join(parts)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted


def test_empty(spark):
    docs, items = frame(spark, ["a b c d e f g h"])
    assert leaks(docs.limit(0), items).count() == 0
    assert leaks(docs, items.limit(0)).count() == 0


def found(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()
    return {(r.doc_id, r.item_id) for r in got}


def test_edited_and_partial_copies(spark):
    draw = random.Random(8)
    items = [" ".join(f"w{draw.randrange(5000)}x" for _ in range(n)) for n in range(30, 101, 5)]
    texts, wanted = [], set()
    for k, item in enumerate(items):
        words = item.split()
        for at in draw.sample(range(len(words)), len(words) // 10):
            words[at] = "other"
        wanted.add((len(texts), k))
        texts.append("before it " + " ".join(words) + " after")
    wanted.add((len(texts), 2))
    texts.append("cut " + " ".join(items[2].split()[10:30]) + " here")
    # A copy with one of two equal numbers and one name at the start of a sentence changed.
    items += ["Tom has 3 red apples in the box. Then the old man puts 3 pears on top of it", "Tom sees a dog then Ann runs home now"]
    n = len(items)
    wanted |= {(len(texts), n - 2), (len(texts) + 1, n - 1), (len(texts) + 2, n - 1)}
    texts += ["x. Tom has 3 red apples in the box. Then the old man puts 4 pears on top of it. y"]
    texts += ["Bob sees a dog then Eve runs home now", "they say Bob sees a dog then Eve runs home now"]
    assert found(spark, items, texts) == wanted


def test_exact_copies_of_short_numeric_and_title_case_items(spark):
    items = ["What is 17 * 23?", "The Battle Of Hastings Took Place In October 1066", "12 14 15 99 1 2 3 4 5 6", "ask Ann Lee and Bob Ray of Rome"]
    texts = [f"so: {t} And more." for t in items] + [t.upper() for t in items] + [f"a {t.lower()} z" for t in items]
    wanted = {(k, k % 4) for k in range(12)}
    others = ["What is 18 * 23?", "12 14 15 98 1 2 3 4", "the battle of bulge took place in may 1944"]
    assert found(spark, items, texts + others) == wanted
