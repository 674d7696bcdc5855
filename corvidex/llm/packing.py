"""Filling containers of fixed capacity with whole texts.

The plan is made from the histogram of lengths alone, whose size is bounded by
the capacity: shallow combinations of lengths that fill a container up to a
small window are enumerated, non-negative least squares finds how often each is
to be repeated so that together they use up the histogram. Which combinations
are tried is settled by rounds of pricing: those are added that use up most of
what the last solution left over. The repeats are
rounded down, and what is left is packed greedily, largest first, into the room
that is left, then into new containers. The plan is a list of groups (lengths of
a container, number of such containers). Rows then find their place by their
length and their number among the rows of that length; no row meets another.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvidex.llm.tokens import TOKENIZER_DIR, load_model, text_slices, worker_encoder
from corvidex.session import durable, ship

#: Distinct lengths in a combination; the first may be repeated.
DEPTH = 3
#: Free tokens that an enumerated combination may leave, as a share of the capacity.
WINDOW = 1 / 256
#: Rounds of pricing, the best beginnings that are looked at in each, and the fillings kept of each.
ROUNDS, BEGINNINGS, FILLINGS = 4, 512, 16
#: Rows a bucket gets on average where all rows have one length, and the bounds of the number of buckets.
BUCKET_ROWS, MIN_BUCKETS, MAX_BUCKETS = 100_000, 64, 1 << 16


def beginnings(hist: np.ndarray) -> np.ndarray:
    """(length, times): every length that occurs, with each number of times worth trying in a container."""
    cap = len(hist) - 1
    a = np.flatnonzero(hist[1:]) + 1
    fits = cap // a
    times = np.stack([np.full(len(a), 1), np.full(len(a), 2), np.full(len(a), 3), np.maximum(1, fits // 2), np.maximum(1, fits - 1), fits])
    rows = np.stack([np.tile(a, len(times)), times.ravel()], 1)
    rows = rows[(rows[:, 1] <= cap // rows[:, 0]) & (rows[:, 1] <= hist[rows[:, 0]])]
    return np.unique(rows, axis=0)


def first_combinations(hist: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times): each beginning with the longest length that then fits, where at most ``window`` is left free."""
    cap = len(hist) - 1
    begin = beginnings(hist)
    longest = np.where(hist > 0, np.arange(cap + 1), 0)
    longest[0] = 0
    longest = np.maximum.accumulate(longest)
    room = cap - begin[:, 0] * begin[:, 1]
    rest = longest[room]
    ok = room - rest <= window
    lengths = np.stack([begin[:, 0], rest, np.zeros(len(begin), np.int64)], 1)[ok]
    return lengths, np.stack([begin[:, 1][ok], lengths[:, 1] > 0, np.zeros(len(lengths), np.int64)], 1).astype(np.int64)


def priced_combinations(hist: np.ndarray, window: int, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times): the combinations that use up most of what is left over, ``price`` being the residual of each length.

    The BEGINNINGS best of all beginnings are filled with every length that
    occurs and the best third length within the window; the FILLINGS best of each
    are given. No length is left out: one that is short of use has a high price
    and comes first in a later round.
    """
    cap = len(hist) - 1
    begin = beginnings(hist)
    if not len(begin):
        return np.zeros((0, DEPTH), np.int64), np.zeros((0, DEPTH), np.int64)
    gain = begin[:, 1] * price[begin[:, 0]]
    best = begin[np.argsort(-gain, kind="stable")[:BEGINNINGS]]
    seconds = np.concatenate([[0], np.flatnonzero(hist[1:]) + 1])
    worth = np.where(hist > 0, price, -np.inf)
    worth[0] = -np.inf
    # the best third length for each room: the dearest of those that leave at most ``window``
    padded = np.concatenate([np.full(window, -np.inf), worth])
    view = np.lib.stride_tricks.sliding_window_view(padded, window + 1)
    at = view.argmax(axis=1)
    third, third_worth = np.arange(cap + 1) - window + at, view[np.arange(cap + 1), at]
    none = (np.arange(cap + 1) <= window) & (third_worth < 0)
    third, third_worth = np.where(none | ~np.isfinite(third_worth), 0, third), np.where(none, 0.0, third_worth)
    second_worth = np.where(seconds > 0, price[seconds], 0.0)
    out = []
    for a, m in best:
        room = cap - a * m - seconds
        ok = np.flatnonzero(room >= 0)
        total = second_worth[ok] + third_worth[room[ok]]
        ok, total = ok[np.isfinite(total)], total[np.isfinite(total)]
        for i in ok[np.argpartition(-total, FILLINGS - 1)[:FILLINGS]] if len(ok) > FILLINGS else ok:
            out.append((a, seconds[i], third[room[i]], m))
    rows = np.array(out, np.int64).reshape(-1, 4)
    lengths = rows[:, :3]
    return lengths, np.stack([rows[:, 3], lengths[:, 1] > 0, lengths[:, 2] > 0], 1).astype(np.int64)


def solved_combinations(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, times, repeats) by column generation: solve, price by the residual, add the best combinations, solve again."""
    window = max(1, int((len(hist) - 1) * WINDOW))
    target = hist.astype(float)
    target[0] = 0
    lengths, times = first_combinations(hist, window)
    x = solve_counts(hist, lengths, times)
    for _ in range(ROUNDS):
        used = sum(np.bincount(lengths[:, j], weights=times[:, j] * x, minlength=len(hist)) for j in range(DEPTH)) if len(x) else np.zeros(len(hist))
        price = target - used
        price[0] = 0
        if price.max(initial=0.0) < 0.5:  # less than an item of any length is left
            break
        more, more_times = priced_combinations(hist, window, price)
        rows = np.concatenate([np.concatenate([lengths, times], 1), np.concatenate([more, more_times], 1)])
        rows, first = np.unique(rows, axis=0, return_index=True)
        x = np.concatenate([x, np.zeros(len(more))])[first]
        lengths, times = rows[:, :DEPTH], rows[:, DEPTH:]
        x = solve_counts(hist, lengths, times, start=x)
    return lengths, times, x


def solve_counts(hist: np.ndarray, lengths: np.ndarray, times: np.ndarray, rounds: int = 120, start: np.ndarray | None = None) -> np.ndarray:
    """Non-negative repeats x with least sum over lengths n of n * (used - available)^2.

    Long items weigh more: what is left over of them needs containers of its own.

    Accelerated projected gradient from ``start``; the matrix has DEPTH entries a
    column and is never written out.
    """
    if not len(lengths):
        return np.zeros(0)
    n = len(hist)
    target = hist.astype(float)
    target[0] = 0
    scale = max(1.0, target.max())
    target /= scale
    t = times.astype(float)
    t[lengths == 0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(lengths[:, j], weights=t[:, j] * x, minlength=n) for j in range(lengths.shape[1]))

    weight = np.arange(n) / max(1, n - 1)

    def back(r: np.ndarray) -> np.ndarray:
        r = weight * r
        return sum(t[:, j] * r[lengths[:, j]] for j in range(lengths.shape[1]))

    v = np.ones(len(lengths))
    for _ in range(20):  # the largest eigenvalue of A'A
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(lengths)) if start is None else start / scale
    s = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - back(forward(y) - target) / (norm * 1.05))
        s2 = (1 + (1 + 4 * s * s) ** 0.5) / 2
        y = nxt + (s - 1) / s2 * (nxt - x)
        x, s = nxt, s2
    return x * scale


def plan_containers(hist: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups (number of containers, [(length, times in each)]) that use ``hist`` up exactly.

    ``hist[n]``: items of length n, for n up to the capacity ``len(hist) - 1``.
    Items of length 0 take no room and are not planned. Where rounding leaves so
    much over that the greedy part would need fewer containers if it packed
    everything (few items of each of many lengths), its plan is taken.
    """
    cap = len(hist) - 1
    left = hist.astype(np.int64).copy()
    left[0] = 0
    everything = left.copy()
    groups: list[list] = []  # [count, content, free]
    lengths, times, x = solved_combinations(left)
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 1:
            break
        content = [(int(n), int(k)) for n, k in zip(lengths[i], times[i]) if n and k]
        merged: dict[int, int] = defaultdict(int)
        for n, k in content:
            merged[n] += k
        count = min(int(x[i]), *(int(left[n]) // k for n, k in merged.items()))
        if count > 0:
            for n, k in merged.items():
                left[n] -= k * count
            groups.append([count, tuple(merged.items()), cap - sum(n * k for n, k in merged.items())])
    plan = _greedy(groups, left)
    least = max(int(everything[cap // 2 + 1 :].sum()), -(-int(everything @ np.arange(cap + 1)) // cap))
    if sum(n for n, _ in plan) > least:
        plan = min(plan, _greedy([], everything), key=lambda p: sum(n for n, _ in p))
    return plan


def _greedy(groups: list, left: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """``groups`` with the items of ``left`` put in, largest first, to the tightest room they fit, else to new containers."""
    cap = len(left) - 1
    by_free: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    frees: list[int] = []

    def put(count: int, content: tuple, free: int) -> None:
        if not by_free[free]:
            insort(frees, free)
        by_free[free].append((count, content))

    for count, content, free in groups:
        put(count, content, free)
    for n in map(int, np.flatnonzero(left)[::-1]):
        todo = int(left[n])
        while todo:
            at = bisect_left(frees, n)
            if at == len(frees):
                each = cap // n
                if todo >= each:
                    put(todo // each, ((n, each),), cap - n * each)
                    todo %= each
                else:
                    put(1, ((n, todo),), cap - n * todo)
                    todo = 0
                continue
            free = frees[at]
            count, content = by_free[free].pop()
            if not by_free[free]:
                frees.pop(at)
            each = min(free // n, max(1, todo // count))
            used = min(count, todo // each)
            if used < count:
                put(count - used, content, free)
            put(used, (*content, (n, each)), free - n * each)
            todo -= used * each
    return [(count, list(content)) for free in sorted(by_free) for count, content in by_free[free]]


def placement(hist: np.ndarray, first: int = 0) -> tuple[np.ndarray, int]:
    """The plan by item: rows (length, rank from, container from, times in each), sorted; and the next free container.

    The items of a length with ranks rank_from + i, for i < count * times, lie in
    container_from + i // times.
    """
    rows, used, at = [], defaultdict(int), first
    for count, content in plan_containers(hist):
        for n, k in content:
            rows.append((n, used[n], at, k))
            used[n] += count * k
        at += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4), at


def token_sizes(docs: DataFrame, id_col: str, text_col: str, tokenizers: list[str], tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, sizes ARRAY<BIGINT>): tokens of each row by each tokenizer; 0 for null and empty texts."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    models = [sc.broadcast(load_model(t, tokenizer_dir)) for t in tokenizers]
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text_to_size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [worker_encoder(m) for m in models]
        for whole in batches:
            for batch in text_slices(whole, "text_to_size"):
                cut = encoders[0].split  # the vocabularies share one pre-tokenisation
                flat = []
                for text in batch.column("text_to_size").to_pylist():
                    tokens = cut(text or "")
                    flat += [sum(map(e.counts.__getitem__, tokens)) for e in encoders]
                sizes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(encoders)), pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes], names=["doc_id", "sizes"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, sizes array<bigint>")


def pack(
    docs: DataFrame,
    specs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_dir: str = TOKENIZER_DIR,
) -> DataFrame:
    """Every text of ``docs`` assigned to containers of each spec.

    ``specs`` has spec_id, tokenizer, capacity and is small (it is read to the
    driver; a null capacity or tokenizer or one below 1 raises ValueError).
    Columns out: spec_id, doc_id, piece_no, start_token, n_tokens, container_id
    (from 0 within a spec). A text longer than the capacity is cut into full
    pieces, each filling a container, and one rest; any other text stays whole.
    Null and empty texts take no room: container_id null, n_tokens 0. Repeated
    rows are items of their own. Empty documents or specs give no rows.
    """
    spark = docs.sparkSession
    wanted = sorted((int(r["spec_id"]), r["tokenizer"], r["capacity"]) for r in specs.select("spec_id", "tokenizer", "capacity").distinct().collect())
    for spec_id, name, capacity in wanted:
        if name is None or capacity is None or capacity < 1:
            raise ValueError(f"spec {spec_id}: tokenizer and a capacity of at least 1 are needed")
    schema = f"spec_id int, doc_id {dict(docs.dtypes)[id_col]}, piece_no bigint, start_token bigint, n_tokens bigint, container_id bigint"
    if not wanted:
        return spark.createDataFrame([], schema)
    tokenizers = sorted({name for _, name, _ in wanted})
    # tokenizing is the costly part: its few bytes a row are written once
    sizes = durable(token_sizes(docs, id_col, text_col, tokenizers, tokenizer_dir))
    # a length may be that of most rows, so rows are numbered within buckets of a length
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, sizes.count() // BUCKET_ROWS))
    which = F.array(*(F.struct(F.lit(s).alias("spec_id"), F.col("sizes")[tokenizers.index(n)].alias("size"), F.lit(c).cast("bigint").alias("capacity")) for s, n, c in wanted))
    items = (
        sizes.select("doc_id", F.explode(which).alias("w"))
        .select("doc_id", "w.spec_id", "w.size", "w.capacity")
        .withColumn("rest", F.when(F.col("size") > F.col("capacity"), F.col("size") % F.col("capacity")).otherwise(F.col("size")))
        .withColumn("full", F.when(F.col("size") > F.col("capacity"), F.expr("size div capacity")).otherwise(F.lit(0).cast("bigint")))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    )
    # counted by length and bucket, then by length: at most capacity rows a spec
    counts = items.groupBy("spec_id", "rest", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("full"))
    counts = durable(counts)
    totals = counts.groupBy("spec_id", "rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect()
    plans: dict[int, np.ndarray] = {}
    first_full: list[tuple[int, int, int]] = []  # (spec, rest, full containers of shorter rests)
    for spec_id, _, capacity in wanted:
        hist = np.zeros(capacity + 1, np.int64)
        full = 0
        for r in sorted((r for r in totals if r["spec_id"] == spec_id), key=lambda r: r["rest"]):
            hist[r["rest"]] += r["n"]
            first_full.append((spec_id, r["rest"], full))
            full += r["full"]
        plans[spec_id], _ = placement(hist, first=full)
    plan = spark.sparkContext.broadcast(plans)  # bounded by the capacities, not by the rows

    # numbers before each bucket: a window over the buckets of a length
    w = Window.partitionBy("spec_id", "rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shorter = F.broadcast(spark.createDataFrame(first_full, "spec_id int, rest bigint, shorter bigint"))  # at most capacity rows a spec
    before = counts.join(shorter, ["spec_id", "rest"]).select(
        "spec_id", "rest", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), (F.col("shorter") + F.coalesce(F.sum("full").over(w), F.lit(0))).alias("full_before")
    )
    inner = Window.partitionBy("spec_id", "rest", "bucket").orderBy("doc_id", "size")
    numbered = (
        items.withColumn("k", F.row_number().over(inner) - 1)
        .withColumn("full_k", F.coalesce(F.sum("full").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(before, ["spec_id", "rest", "bucket"])
        .select("spec_id", "doc_id", "size", "capacity", "rest", "full", (F.col("before") + F.col("k")).alias("rank"), (F.col("full_before") + F.col("full_k")).alias("full_from"))
    )
    kind = dict(docs.dtypes)[id_col]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = {s: p[:, 0] * (1 << 40) + p[:, 1] for s, p in plan.value.items()}
        for b in batches:
            spec, rest, rank = (np.asarray(b.column(c)) for c in ("spec_id", "rest", "rank"))
            out = np.full(len(spec), -1, np.int64)
            for s in np.unique(spec):
                p, mine = plan.value[int(s)], (spec == s) & (rest > 0)
                at = np.searchsorted(keys[int(s)], rest[mine] * (1 << 40) + rank[mine], side="right") - 1
                out[mine] = p[at, 2] + (rank[mine] - p[at, 1]) // p[at, 3]
            cols = [b.column(c) for c in ("spec_id", "doc_id", "size", "capacity", "rest", "full", "full_from")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, mask=out < 0)], names=["spec_id", "doc_id", "size", "capacity", "rest", "full", "full_from", "container_id"])

    placed = numbered.mapInArrow(place, f"spec_id int, doc_id {kind}, size bigint, capacity bigint, rest bigint, full bigint, full_from bigint, container_id bigint")
    # pieces 0 .. full - 1 fill a container each; the rest, or the text itself, comes last
    last = F.when((F.col("rest") > 0) | (F.col("size") == 0), F.col("full")).otherwise(F.col("full") - 1)
    pieces = placed.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    is_full = F.col("piece_no") < F.col("full")
    return pieces.select(
        "spec_id",
        "doc_id",
        "piece_no",
        (F.col("piece_no") * F.col("capacity")).alias("start_token"),
        F.when(is_full, F.col("capacity")).otherwise(F.col("rest")).alias("n_tokens"),
        F.when(is_full, F.col("full_from") + F.col("piece_no")).otherwise(F.col("container_id")).alias("container_id"),
    )
