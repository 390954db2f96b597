"""Leaked evaluation passages."""

import random

from claimlake.llm import leakage as K

WORDS = [f"w{n}" for n in range(400)]


def passage(seed, n=60):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


ITEMS = [(i, "Stock text for all.\n\n" + " ".join(passage(i)) + "\nA) one two\nB) three four") for i in range(8)]


def found(spark, *texts, items=ITEMS, **options):
    docs = spark.createDataFrame([(n, t, "x", 1.0) for n, t in enumerate(texts)], "doc_id bigint, text string, item_id string, coverage double")
    evals = spark.createDataFrame([(i, "s", t) for i, t in items], "item_id bigint, suite string, text string")
    return {(r.doc_id, r.item_id) for r in K.leaked_items(docs, evals, **options).collect()}


def test_passages():
    own = K.passages(ITEMS)
    assert own[3] == passage(3)


def test_automaton_matches_brute_force():
    index = K.LeakIndex({i: passage(i, 30) for i in range(4)})
    rng = random.Random(1)
    text = [rng.choice(WORDS[:6]) for _ in range(20)] + passage(2, 30)[5:15] + ["zz"] + passage(1, 30)[:7]
    numbers = [index.vocabulary.get(w) for w in text]
    known = {tuple(p[a:b]) for p in index.passage.values() for a in range(len(p)) for b in range(a + 1, len(p) + 1)}
    want = set()
    for end in range(1, len(numbers) + 1):
        longest = max((k for k in range(end + 1) if k == 0 or tuple(numbers[end - k : end]) in known), default=0)
        if longest >= 3 and (end == len(numbers) or tuple(numbers[end - longest : end + 1]) not in known):
            want.add((end, longest))
    assert {(e, n) for e, n, _ in index.matches(numbers)} == want
    three = {tuple(numbers[n - 3 : n]) for n in range(3, len(numbers) + 1)}
    hits = {i for c in index.trace(numbers, 99)[0] for i in index.items[c]}
    assert hits == {i for i, p in index.passage.items() if three & {tuple(p[n - 3 : n]) for n in range(3, len(p) + 1)}}


def test_cases(spark):
    p = passage(0)
    noise = ["filler"] * 200
    changed = [w if n % 9 else "zzz" for n, w in enumerate(p)]
    shuffled = p[:]
    random.Random(2).shuffle(shuffled)
    texts = [
        " ".join(noise + p + noise),
        " ".join(noise) + " " + "\n> ".join(w.upper() + "," for w in p) + " end",
        " ".join(f"<b>{w}</b>" if n % 4 else f"**{w}**" for n, w in enumerate(p)),
        " ".join(changed),
        " ".join(p[20:46]),
        " ".join(p[:14]),
        " ".join(shuffled),
        "Stock text for all. A) one two B) three four",
        None,
        "",
    ]
    assert found(spark, *texts) == {(n, 0) for n in range(5)}


def test_words():
    assert K.words_of("A <b>bold</b> half-\n> way, snake_case &amp; X.Y") == ["a", "bold", "halfway", "snake", "case", "x", "y"]


def test_blocks_give_the_same(spark):
    texts = [" ".join(passage(i)) for i in range(8)] + [" ".join(passage(1) + ["x"] * 900 + passage(5))]
    whole = found(spark, *texts)
    assert whole == found(spark, *texts, block_words=100) and {(8, 1), (8, 5)} <= whole


def test_empty_and_repeated(spark):
    assert found(spark, " ".join(passage(0)), items=[]) == set()
    assert found(spark) == set()
    assert found(spark, " ".join(passage(0)), items=[(1, None), (2, "short one"), (3, " ".join(passage(0))), (3, " ".join(passage(0)))]) == {(0, 3)}


def test_very_long_text(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice(WORDS) for _ in range(100_000)) + " " + " ".join(passage(6))
    assert (0, 6) in found(spark, text)


def test_more_near_equal_items_than_a_narrow_class_holds(spark):
    base = passage(40)
    items = [(i, " ".join(base[:i] + [f"own{i}"] + base[i + 1 :])) for i in range(20)]
    assert found(spark, " ".join(base), items=items) == {(0, i) for i in range(20)}
    lines = lambda ws: "\n".join(" ".join(ws[n : n + 6]) for n in range(0, 60, 6))
    items = [(i, lines(base[:i] + [f"own{i}"] + base[i + 1 :])) for i in range(20)]
    assert found(spark, "x " + " ".join(base), items=items) == {(0, i) for i in range(20)}
    same = [(i, " ".join(base)) for i in range(20)]
    assert found(spark, " ".join(base), items=same) == {(0, i) for i in range(20)}


def test_several_questions_on_one_passage(spark):
    stock = "Read the text and answer the question that follows."
    items = [(i, f"{stock}\n\n{' '.join(passage(50))}\n\nWhat of w{i} and w{i + 9}?\nA) one\nB) two") for i in range(4)]
    items += [(i, f"{stock}\n\n{' '.join(passage(i))}") for i in range(10, 20)]
    assert found(spark, "Intro. " + " ".join(passage(50)) + " End.", stock, items=items) == {(0, i) for i in range(4)}


def test_an_item_inside_another(spark):
    p = passage(60, 90)
    items = [(1, " ".join(p)), (2, " ".join(p[30:60] + passage(61, 20)))]
    assert found(spark, " ".join(p), items=items) == {(0, 1), (0, 2)}


def cleaned(spark, texts, items, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    evals = spark.createDataFrame([(i, "s", t) for i, t in items], "item_id bigint, suite string, text string")
    return {r.doc_id: (r.text, r.item_ids) for r in K.without_leaks(docs, evals, **options).collect()}


def test_stretches_are_cut(spark):
    p = passage(0)
    marked = "Before &amp; now. <b>" + " ".join(p[:30]) + "</b> one\n> " + ", ".join(p[30:]).upper() + ". After İt."
    texts = [marked, "nothing", " ".join(passage(1)[:15]) + " rest", None, ""]
    got = cleaned(spark, texts, ITEMS)
    assert got[0] == ("Before &amp; now. <b>. After İt.", [0])
    assert got[1] == ("nothing", []) and got[2] == (texts[2], []) and got[4] == ("", []) and 3 not in got
    assert cleaned(spark, texts, ITEMS, span_words=12)[2] == (" rest", [])
    assert cleaned(spark, texts, ITEMS, block_words=100) == got and cleaned(spark, texts, []) == {n: (t, []) for n, t in enumerate(texts) if t is not None}


def test_places_of_words():
    for text in ("A <b>bold</b> half-\n> way, snake_case &amp; X.Y", "Über\u200bfluß İstanbul &#65;b x&lt;y", "", "a"):
        assert len(K.word_spans(text)) == len(K.words_of(text))
    text = "Ein <i>Wort</i> mit half-\nway."
    assert [text[a:b].lower() for a, b in K.word_spans(text)] == ["ein", "wort", "mit", "half-\nway"]


def test_shared_turns_of_phrase_are_no_leak(spark):
    p = passage(70)
    phrases = [w for n in range(0, 60, 6) for w in [*p[n : n + 5], f"other{n}", f"more{n}"]]
    assert found(spark, " ".join(phrases), items=[(1, " ".join(p))]) == set()
