"""Sentence alignment on an invented language pair with known links."""

import itertools
import random

import numpy as np
import pyarrow as pa

from claimlake.llm import bitext as B

VOCABULARY = {f"noun{n:02d}x"[:4] + chr(97 + n): f"wort{chr(97 + n)}" for n in range(26)}


def corpus(n_pages, sentences, seed):
    rng = random.Random(seed)
    words, rows, truth = list(VOCABULARY), [], set()
    for page in range(n_pages):
        source = [[rng.choice(words) for _ in range(7)] for _ in range(sentences)]
        target, links, i = [], [], 0
        while i < sentences:
            kind = rng.random()
            if kind < 0.1 and i + 1 < sentences:
                links += [(i, len(target)), (i + 1, len(target))]
                target.append(source[i] + source[i + 1])
                i += 1
            elif kind < 0.2:
                links += [(i, len(target)), (i, len(target) + 1)]
                target += [source[i][:4], source[i][4:]]
            elif kind < 0.26:
                pass
            else:
                links.append((i, len(target)))
                target.append(source[i])
            i += 1
        rows += [(page, "source", n + 1, " ".join(s)) for n, s in enumerate(source)]
        rows += [(page, "translation", n + 1, " ".join(VOCABULARY[w] for w in s)) for n, s in enumerate(target)]
        truth |= {(page, i + 1, j + 1) for i, j in links}
    return rows, truth


def run(spark, rows, langs=None, **options):
    sentences = spark.createDataFrame(rows, "pair_id bigint, side string, sent_no int, text string")
    pairs = spark.createDataFrame([(p, (langs or {}).get(p, "xx"), "clash") for p in sorted({r[0] for r in rows if r[0] is not None})], "pair_id bigint, lang string, text string")
    return {(r.pair_id, r.source_no, r.translation_no) for r in B.align_pairs(pairs, sentences, **options).collect()}


def scores(got, truth):
    return len(got & truth) / len(got), len(got & truth) / len(truth)


def test_merges_splits_omissions(spark):
    rows, truth = corpus(40, 12, 1)
    random.Random(2).shuffle(rows)
    precision, recall = scores(run(spark, rows + rows[:50]), truth)
    assert precision > 0.95 and recall > 0.95


def test_long_page_in_windows(spark):
    rows, truth = corpus(2, 150, 3)
    precision, recall = scores(run(spark, rows, window=40), truth)
    assert precision > 0.9 and recall > 0.9


def test_far_moves_by_code(spark):
    rows, _ = corpus(1, 100, 4)
    top = max(n for _, s, n, _ in rows if s == "translation") + 1
    rows += [(0, "source", 101, "see `only.here` noise"), (0, "translation", 0, "siehe `only.here`"), (0, "translation", top, "ende")]
    assert (0, 101, 0) in run(spark, rows, window=20)


def test_far_moves_and_long_omissions_of_plain_prose(spark):
    rng = random.Random(6)
    spelled = ["".join(x) for x in itertools.product("bdfgk", "aeiou", "lmnrs", "ai")]
    other = dict(zip(spelled, rng.sample([w + "t" for w in spelled], len(spelled)), strict=True))
    text = lambda n: [[rng.choice(spelled) for _ in range(8)] for _ in range(n)]
    rows = []
    for page in range(60):
        for n, w in enumerate(text(12)):
            rows += [(page, "source", n, " ".join(w)), (page, "translation", n, " ".join(other[x] for x in w))]
    source = text(120)
    order = [*range(100, 110), *range(60, 100), *range(110, 120)]  # half is left out, a passage is moved to the front
    rows += [(99, "source", n, " ".join(w)) for n, w in enumerate(source)] + [(99, "translation", n, " ".join(other[x] for x in source[k])) for n, k in enumerate(order)]
    got = {x for x in run(spark, rows, window=12) if x[0] == 99}
    precision, recall = scores(got, {(99, k, n) for n, k in enumerate(order)})
    assert precision > 0.9 and recall > 0.9


def test_no_window_grows_with_its_page(spark):
    rows = [(1, "source", n, f"one n{n}") for n in range(3)] + [(1, "translation", n, f"eins n{n}") for n in range(400)]
    rows += [(2, side, n if n < 99 else 2**31 - 1, f"two n{n}") for side in ("source", "translation") for n in range(-1, 100)] + [(2, "source", -(2**31), "low")]
    sentences = spark.createDataFrame(rows, "pair_id bigint, side string, sent_no int, text string")
    pages = B.units(spark.createDataFrame([(1, "xx"), (2, "xx")], "pair_id bigint, lang string"), sentences, window=20).collect()
    assert max(len(r.s_no) for r in pages) <= 20 and max(len(r.t_no) for r in pages) <= 80
    assert {(r.pair_id, n) for r in pages for n in r.t_no} == {(p, n) for p, side, n, _ in rows if side == "translation"}


def test_windows_reach_python_in_small_flat_batches(spark):
    rows, _ = corpus(60, 30, 9)
    sentences = spark.createDataFrame(rows, "pair_id bigint, side string, sent_no int, text string")
    pages = B.units(spark.createDataFrame([(p, "xx") for p in range(60)], "pair_id bigint, lang string"), sentences)
    modelled = B.with_model(pages, B.learn_lexicon(pages, False))
    assert not any("struct" in kind for _, kind in modelled.dtypes)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, least = spark.conf.get(key), B._BATCH_BYTES
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    try:
        B._BATCH_BYTES = 1
        with B._small_batches(spark):
            assert {r.n for r in modelled.mapInArrow(sizes, "n bigint").collect()} == {1}
    finally:
        B._BATCH_BYTES = least
    assert spark.conf.get(key) == before


def test_transport_masses():
    similar = np.array([[0.9, 0.1], [0.1, 0.1]])
    plan = B.transport(similar, np.array([1.0, 1.0]), np.array([1.0, 1.0]))
    assert plan[0, 0] > 0.9 and plan[1].sum() < 0.1
    assert B.transport(np.zeros((1, 3)), np.ones(1), np.ones(3)).sum() < 0.05


def test_words_and_language():
    assert B.words("Set `--a-b` to 37,022 and 1.5") == ["`--a-b", "#37022", "#15", "set", "to", "and"]
    assert B.words("锚点表") == ["锚点", "点表"]
    said = lambda *texts: [sum(x) for x in zip(*(B._evidence(t.lower(), B.words(t)) for t in texts), strict=True)]
    assert B.language("zh_Hans", said("a")) == "zh" and B.language(None, said("锚点表增长")) == "zh" and B.language(None, said("der Suchpfad und die Seite")) == "de" and B.language("", said("")) == "und"
    assert B.language(None, said(*["x q z"] * 60, "der Suchpfad und die Seite")) == "de"
    kinds = [h & 7 for h in B.hashed(["word", "#15", "#150", "#37022", "`a", "`--a-b"])]
    assert kinds == [B.WORD, B.NUMBER, B.LONG_NUMBER, B.LONGER_NUMBER, B.CODE, B.LONG_CODE]


def test_nulls_one_sided_and_empty(spark):
    rows = [(1, "source", 1, "a b"), (2, "translation", 1, "x"), (None, "source", 1, "a"), (3, "source", None, "a"), (3, None, 1, "a"), (3, "source", 1, None), (3, "translation", 1, " ")]
    assert run(spark, rows) == set()
    assert run(spark, [(1, "source", 1, "see `q.r`"), (1, "translation", 1, "siehe `q.r`")]) == {(1, 1, 1)}
    assert run(spark, rows[:0] + [(9, "source", 1, "")]) == set()
