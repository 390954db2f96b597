"""Packing into containers of fixed capacity."""

import math
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimlake.llm import packing as K


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60), st.integers(1, 9))
def test_differencing_keeps_every_item(sizes, k):
    windows = K.differencing(sorted(sizes, reverse=True), k)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert len(windows) <= k


def test_differencing_balances():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 500) for _ in range(600)), reverse=True)
    sums = [sum(sizes[i] for i in w) for w in K.differencing(sizes, 20)]
    assert max(sums) - min(sums) <= 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80), st.integers(100, 300))
def test_pack_is_whole_and_within_capacity(sizes, capacity):
    windows = K.pack(sizes, capacity)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= capacity for w in windows)


def test_pack_is_tight():
    rng = random.Random(2)
    sizes = [min(511, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(5000)]
    assert len(K.pack(sizes, 512)) <= 1.005 * math.ceil(sum(sizes) / 512) + 1


needs_vocabulary = pytest.mark.skipif(not os.path.exists(K.TOKENIZER), reason="no tokenizer files here")


@needs_vocabulary
def test_documents(spark):
    rng = random.Random(3)
    rows = [(n, " ".join(rng.choice(["alpha", "beta", "x1", "你好"]) for _ in range(rng.choice([0, 3, 40, 900]))), "c") for n in range(200)] + [(7, "short", "c"), (900, None, "c"), (None, "x", "c"), (901, "word " * 20_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, container string")
    plans = spark.createDataFrame([(1, 64), (2, 5000), (3, None), (4, 0), (None, 9)], "plan_id int, capacity_tokens int")
    packed = K.pack_documents(docs, plans, block_items=50).cache()
    sizes = {r.doc_id: r.tokens for r in K.token_sizes(docs).collect()}
    assert set(sizes) == {*range(200), 901}
    for plan, capacity in ((1, 64), (2, 5000)):
        pieces = packed.where(f"plan_id = {plan}").collect()
        for doc, total in sizes.items():
            own = sorted((p.token_start, p.tokens) for p in pieces if p.doc_id == doc)
            assert own[0][0] == 0 and sum(t for _, t in own) == total and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
            assert len(own) == max(1, math.ceil(total / capacity))
    report = {r.plan_id: r for r in K.fill_report(packed, plans).collect()}
    assert set(report) == {1, 2} and all(r.over_full == 0 for r in report.values())
    packed.unpersist()


@needs_vocabulary
def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    plans = spark.createDataFrame([(1, 64)], "plan_id int, capacity_tokens int")
    assert K.pack_documents(docs, plans).isEmpty()
    assert K.pack_documents(spark.createDataFrame([(1, "x")], docs.schema), plans.limit(0)).isEmpty()


def test_differencing_alone_raises_the_count():
    rng = random.Random(5)
    for capacity in (100, 1000):
        sizes = [rng.randint(1, 90) for _ in range(700)]
        windows = K.balance(sizes, capacity)
        assert sorted(i for w in windows for i in w) == list(range(700))
        loads = [sum(sizes[i] for i in w) for w in windows]
        assert max(loads) <= capacity and len(windows) <= 1.4 * sum(sizes) / capacity + 1
    assert K.balance([], 10) == [] and K.balance([10, 10, 10], 10) and len(K.balance([0, 0], 10)) <= 2
