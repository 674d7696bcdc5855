import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvidex.llm import packing, tokens


@given(st.lists(st.integers(0, 64), max_size=300))
@settings(max_examples=60, deadline=None)
def test_plans_use_every_item_once(sizes):
    hist = np.bincount(sizes, minlength=65) if sizes else np.zeros(65, np.int64)
    used: Counter = Counter()
    containers = 0
    for count, content in packing.plan_containers(hist):
        assert count > 0 and sum(n * k for n, k in content) <= 64
        containers += count
        for n, k in content:
            used[n] += count * k
    assert used == Counter({n: int(c) for n, c in enumerate(hist) if n and c})
    total = sum(sizes)
    assert total / 64 <= containers <= max(0, 2 * total / 64 + 1)


def test_little_room_is_left():
    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.lognormal(4.8, 1.0, 20_000).astype(int) + 1, 512)
    hist = np.bincount(sizes, minlength=513)
    n = sum(c for c, _ in packing.plan_containers(hist))
    assert sizes.sum() / 512 / n > 0.99


def test_least_squares_finds_a_perfect_packing():
    hist = np.zeros(101, np.int64)
    hist[[70, 30, 50, 25]] = [40, 40, 30, 60]
    lengths, times, x = packing.solved_combinations(hist)
    assert len(lengths) and all(99 <= (row * t).sum() <= 100 for row, t in zip(lengths, times))
    used = sum(np.bincount(lengths[:, j], weights=times[:, j] * x, minlength=101) for j in range(packing.DEPTH))
    assert (x >= 0).all() and np.abs(used[1:] - hist[1:]).max() < 1
    assert sum(c for c, _ in packing.plan_containers(hist)) == hist @ np.arange(101) / 100


@pytest.mark.parametrize("capacity", [8192, 32768])
@pytest.mark.parametrize("shape", ["flat", "long"])
def test_full_histograms(capacity, shape):
    """Thousands of different lengths: no length is left out, and hardly any room."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, capacity + 1, 60_000) if shape == "flat" else np.minimum(rng.lognormal(np.log(capacity) - 2.5, 1.2, 60_000).astype(int) + 1, capacity)
    hist = np.bincount(sizes, minlength=capacity + 1)
    used: Counter = Counter()
    containers = 0
    for count, content in packing.plan_containers(hist):
        containers += count
        assert sum(n * k for n, k in content) <= capacity
        for n, k in content:
            used[n] += count * k
    assert used == Counter({n: int(c) for n, c in enumerate(hist) if n and c})
    # items over half the capacity can't share a container, and everything needs its room
    least = max(int((sizes > capacity / 2).sum()), -(-int(sizes.sum()) // capacity))
    assert containers <= least * (1.001 if shape == "long" else 1.002) + 1


SPECS = [(1, "byte_bpe_50k", 16), (2, "byte_bpe_50k", 64), (3, "byte_bpe_multi_50k", 16)]


@pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZER_DIR), reason="no vocabularies")
def test_pack(spark):
    rows = [(i, " word" * (i % 40)) for i in range(300)] + [(7, " word" * 7), (1000, None), (1001, ""), (1002, " long" * 5000), (None, " null id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spec_id", F.lit("x")).withColumn("size", F.lit(1)).withColumn("container_id", F.lit(1))
    specs = spark.createDataFrame(SPECS, "spec_id int, tokenizer string, capacity int")
    got = packing.pack(docs, specs).collect()
    encoders = {n: tokens.Encoder(tokens.load_model(n)) for _, n, _ in SPECS}
    for spec, name, capacity in SPECS:
        mine = [r for r in got if r["spec_id"] == spec]
        room: dict = defaultdict(int)
        pieces: dict = defaultdict(list)
        for r in mine:
            pieces[r["doc_id"]].append(r)
            if r["container_id"] is None:
                assert r["n_tokens"] == 0
            else:
                room[r["container_id"]] += r["n_tokens"]
        assert max(room.values()) <= capacity and sorted(room) == list(range(len(room)))
        assert sum(room.values()) == sum(encoders[name].count(t) for _, t in rows)
        assert sum(room.values()) / capacity / len(room) > 0.9
        for doc, text in rows:
            n = encoders[name].count(text)
            parts = sorted(pieces[doc], key=lambda r: r["piece_no"])
            if doc == 7:
                assert len(parts) == 2  # the repeated row is an item of its own
            elif n <= capacity:
                assert [(r["piece_no"], r["start_token"], r["n_tokens"]) for r in parts] == [(0, 0, n)]
            else:
                at = 0
                for i, r in enumerate(parts):
                    assert (r["piece_no"], r["start_token"]) == (i, at)
                    at += r["n_tokens"]
                assert at == n and all(r["n_tokens"] == capacity for r in parts[:-1])


@pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZER_DIR), reason="no vocabularies")
def test_pack_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    specs = spark.createDataFrame(SPECS, "spec_id int, tokenizer string, capacity int")
    assert packing.pack(docs, specs).count() == 0
    assert packing.pack(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), specs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, spark.createDataFrame([(1, "byte_bpe_50k", None)], "spec_id int, tokenizer string, capacity int"))
