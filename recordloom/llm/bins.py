"""Filling containers of fixed capacity with items by bin completion.

Sizes are whole numbers up to the capacity, so all that the packing needs to know
is how many items of each size there are: a histogram of at most ``capacity``
rows, whatever the number of items. On it a branch and bound runs on the driver:

* the largest size left opens a container; the undominated fillings around it are
  enumerated (a filling is dominated if another one holds larger items in its
  place), and a filling is applied to as many containers as the counts allow;
* a branch ends when its waste exceeds what a packing better than the incumbent may
  waste; the first incumbent is best fit decreasing; the search ends at the lower
  bound or after ``nodes`` applications of a filling.

The plan says which ranks of each size go into which containers. Items are ranked
within their size in salted groups, so a size that a third of all items have is
ranked by many tasks, and each row finds its container by a binary search in the
plan, whose size is bounded by the capacity, not by the data.

Defined cases: an item without size (a null or empty text) takes no space and has
no container (null); an item longer than the capacity is divided into pieces of
the capacity and a rest; repeated items are packed each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.bpe import DEFAULT_VOCABULARY, token_counts
from recordloom.session import cut

#: Fixed value: tokens that a container takes.
CAPACITY = 1024
#: Applications of a filling after which the search keeps its incumbent.
NODES = 20_000
#: Undominated fillings that are branched on for one container, the least wasteful first; sets that their enumeration visits, and fillings found after which it ends.
WIDTH, VISITED, FOUND = 4, 3000, 32

Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs: by the space, and by the items that can't share a container."""
    space = -(-sum(s * n for s, n in counts.items()) // capacity)
    best = space
    for k in {0, *(s for s in counts if s <= capacity // 2)}:
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        half = {s: n for s, n in counts.items() if capacity // 2 < s <= capacity - k}
        middle = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        free = sum((capacity - s) * n for s, n in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(middle - free) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing on the histogram; containers with equal contents stay one entry."""
    open_: dict[int, list[list]] = {}  # space left -> [contents, containers]
    for size in sorted((s for s in counts if counts[s] > 0), reverse=True):
        left = counts[size]
        while left:
            space = min((r for r in open_ if r >= size), default=None)
            if space is None:
                fit = max(1, capacity // size)
                whole, rest = divmod(left, fit)
                for items, n in ((fit, whole), (rest, 1 if rest else 0)):
                    if n:
                        open_.setdefault(capacity - size * items, []).append([(size,) * items, n])
                left = 0
                continue
            group = open_[space][-1]
            take = min(left, group[1])
            if take == group[1]:
                open_[space].pop()
                if not open_[space]:
                    del open_[space]
            else:
                group[1] -= take
            open_.setdefault(space - size, []).append([(*group[0], size), take])
            left -= take
    return [(contents, n) for groups in open_.values() for contents, n in groups]


def fillings(counts: dict[int, int], sizes: list[int], space: int, allowed: int, width: int = WIDTH, most: int = VISITED) -> list[tuple[int, ...]]:
    """Undominated fillings of ``space`` that waste at most ``allowed``, least waste and fewest items first.

    ``sizes`` is sorted, largest first. Depth-first over at most ``most`` sets; an item
    that fills the space left exactly dominates all sets of smaller items in its
    place, so it ends the enumeration behind the items chosen before it, and of
    all fillings if it is the only one.
    """
    found: list[tuple[int, int, tuple[int, ...]]] = []
    seen = 0

    def go(at: int, space_left: int, chosen: tuple[int, ...]) -> bool:
        """Enumerates the sets that continue ``chosen``; does it fill the space?"""
        nonlocal seen
        seen += 1
        if space_left == 0:
            found.append((0, len(chosen), chosen))
            return True
        grown = False
        for i in range(at, len(sizes)):
            s = sizes[i]
            if s > space_left or seen > most:
                continue
            held = counts[s] - chosen.count(s)
            if held <= 0:
                continue
            grown = True
            if i == len(sizes) - 1:  # of the smallest size as many as fit, at once
                times = min(held, space_left // s)
                rest = space_left - s * times
                if rest <= allowed:
                    found.append((rest, len(chosen) + times, (*chosen, *[s] * times)))
                return rest == 0
            if go(i, space_left - s, (*chosen, s)) or len(found) >= FOUND:
                break  # smaller items in this place are dominated
        if not grown and space_left <= allowed:
            found.append((space_left, len(chosen), chosen))
        return False

    go(0, space, ())
    # a filling that a set of the same number of items, each at least as large, replaces is dominated
    kept: list[tuple[int, int, tuple[int, ...]]] = []
    for f in sorted(set(found), key=lambda x: (x[0], x[1], [-s for s in x[2]])):
        if not any(len(k[2]) == len(f[2]) and all(a >= b for a, b in zip(k[2], f[2])) for k in kept):
            kept.append(f)
        if len(kept) >= width:
            break
    return [f[2] for f in kept]


def pack(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """A packing as (contents, containers) by bin completion with best fit as the first incumbent."""
    counts = {s: n for s, n in counts.items() if n > 0}
    if not counts:
        return []
    total = sum(s * n for s, n in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    applied = 0
    # explicit stack: (counts, patterns so far, containers, waste, fillings still to try)
    left = dict(counts)

    def options(state: dict[int, int], waste: int) -> list[tuple[int, ...]]:
        sizes = sorted((s for s in state if state[s] > 0), reverse=True)
        largest = sizes[0]
        allowed = (best_n - 1) * capacity - total - waste
        if allowed < 0:
            return []
        reduced = dict(state)
        reduced[largest] -= 1
        return [(largest, *f) for f in fillings(reduced, sizes, capacity - largest, allowed)]

    stack = [[left, [], 0, 0, None]]
    while stack and best_n > bound and applied < nodes:
        state, patterns, used, waste, todo = stack[-1]
        if todo is None:
            if not any(state.values()):
                if used < best_n:
                    best, best_n = list(patterns), used
                stack.pop()
                continue
            todo = stack[-1][4] = options(state, waste)
        if not todo:
            stack.pop()
            continue
        contents = todo.pop(0)
        uses = {s: contents.count(s) for s in set(contents)}
        times = min(state[s] // n for s, n in uses.items())
        free = capacity - sum(contents)
        if free:  # as many as the waste of a better packing allows, at least one
            times = max(1, min(times, ((best_n - 1) * capacity - total - waste) // free)) if free <= (best_n - 1) * capacity - total - waste else 0
        if not times:
            continue
        applied += 1
        nxt = {s: n - uses.get(s, 0) * times for s, n in state.items() if n - uses.get(s, 0) * times}
        stack.append([nxt, [*patterns, (contents, times)], used + times, waste + free * times, None])
    return best


def slots(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The plan as arrays sorted by (size, first rank): size, first rank, first container."""
    next_rank: dict[int, int] = {}
    rows, base = [], 1
    for contents, n in patterns:
        for s in contents:
            rank = next_rank.get(s, 0)
            rows.append((s, rank, base))
            next_rank[s] = rank + n
        base += n
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def ranked(items: DataFrame, salts: int) -> DataFrame:
    """Adds ``rank``: a number from 0 within each ``tokens``, given out by salted groups."""
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    ahead = Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("tokens", "salt").count().select("tokens", "salt", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece"))
    return salted.withColumn("within", within).join(starts, ["tokens", "salt"]).withColumn("rank", F.col("start") + F.col("within") - 1)


def fill_containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, first_token, tokens, container_id of each text or piece of a text."""
    spark = documents.sparkSession
    sized = token_counts(documents, vocabulary)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(capacity))).cast("int")
    items = cut(
        sized.select("doc_id", F.col("tokens").alias("total"), F.explode(F.sequence(F.lit(1), pieces)).alias("piece"))
        .withColumn("first_token", (F.col("piece") - 1).cast("bigint") * capacity)
        .withColumn("tokens", F.least(F.lit(capacity).cast("bigint"), F.col("total") - F.col("first_token")).cast("int"))
        .drop("total")
    )
    histogram = items.where("tokens > 0").groupBy("tokens").count()
    counts = {r["tokens"]: r["count"] for r in histogram.collect()}  # at most ``capacity`` rows
    size, first, base = slots(pack(counts, capacity, nodes))
    shift = 1 << 40
    starts = size * shift + first

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            doc, piece, at, tokens, rank = (batch.column(i) for i in range(5))
            t, r = tokens.to_numpy().astype(np.int64), rank.to_numpy()
            k = np.searchsorted(starts, t * shift + r, side="right") - 1
            container = base[k] + r - first[k]
            yield pa.RecordBatch.from_arrays([doc, piece, at, tokens, pa.array(container, pa.int64())], names=["doc_id", "piece", "first_token", "tokens", "container_id"])

    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc_id bigint, piece int, first_token bigint, tokens int, container_id bigint"
    empty = items.where("tokens <= 0").selectExpr("doc_id", "piece", "first_token", "tokens", "cast(null as bigint) as container_id")
    if not counts:
        return empty
    placed = ranked(items.where("tokens > 0"), salts).select("doc_id", "piece", "first_token", "tokens", "rank").mapInArrow(place, schema)
    return placed.unionByName(empty)
