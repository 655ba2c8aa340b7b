"""Problem 7: filling fixed-capacity containers with items, by swap-based local search.

Items meet in groups of bounded size; each group is packed on its own. A first packing
(largest first into the fullest bin with room) is improved by exchanging one item for one,
two for one or moving one item between underfull bins. Each step raises the sum of
squared fills, and steps go on until none does or a round empties no bin more.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countflow.functions.common import bounded, cut, table
from countflow.llm.tokens import VOCABULARY, with_sizes

#: Items that are packed together (a parameter: memory and time of one task).
GROUP_ITEMS = 8_000

SCHEMA = "container_kind string, container_id string, doc_id long, piece int, start_token long, n_tokens long"


class _Rooms:
    """Bins by free room, with the smallest sufficient room found by bit tricks."""

    def __init__(self, capacity: int) -> None:
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.mask = 0

    def add(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        m = self.mask >> size
        if not m:
            return None
        room = size + (m & -m).bit_length() - 1
        own = self.bins[room]
        b = own.pop()
        if not own:
            self.mask &= ~(1 << room)
        return b, room


def first_packing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices: largest item first, into the fullest bin that has room."""
    rooms, bins = _Rooms(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        got = rooms.take(s)
        if got is None:
            bins.append([])
            got = (len(bins) - 1, capacity)
        bins[got[0]].append(i)
        if got[1] - s:
            rooms.add(got[1] - s, got[0])
    return bins


class _Search:
    """Local search over the underfull bins of a packing, which are kept as counts of sizes.

    Items of one size are alike, so a bin has few distinct sizes (their sum is at most the
    capacity), and so few distinct pairs. Sizes and pair sums on hand are bits of an
    integer, so that the largest one that fits is found at once.
    """

    def __init__(self, bins: list[dict[int, int]], capacity: int) -> None:
        self.bins, self.capacity = bins, capacity
        self.fill = [sum(s * n for s, n in b.items()) for b in bins]
        self.version = [0] * len(bins)
        self.holders: dict[int, set[int]] = defaultdict(set)
        self.pairs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.sizes = self.sums = 0
        for k in self.open():
            self._enter(k)

    def open(self) -> list[int]:
        return [k for k, f in enumerate(self.fill) if 0 < f < self.capacity]

    def _enter(self, k: int) -> None:
        own = sorted(self.bins[k])
        for x, s in enumerate(own):
            self.holders[s].add(k)
            self.sizes |= 1 << s
            for t in own[x + (self.bins[k][s] < 2) :]:
                self.pairs[s + t].append((k, s, self.version[k]))
                self.sums |= 1 << s + t

    def _leave(self, k: int) -> None:
        self.version[k] += 1
        for s in self.bins[k]:
            self.holders[s].discard(k)
            if not self.holders[s]:
                self.sizes &= ~(1 << s)

    def _change(self, k: int, less: tuple[int, ...], more: tuple[int, ...]) -> None:
        own = self.bins[k]
        for s in less:
            own[s] -= 1
            if not own[s]:
                del own[s]
        for s in more:
            own[s] = own.get(s, 0) + 1
        self.fill[k] += sum(more) - sum(less)

    def step(self, k: int) -> bool:
        """The exchange or move that fills bin k most, if one raises the squared fill; whether there was one.

        With d the gain of k, the squared fill grows if k with d is fuller than the giver was.
        """
        room, mine, best = self.capacity - self.fill[k], self.fill[k], 0
        found = None
        for give in (0, *self.bins[k]):
            for held, pick in ((self.sizes, self._one), (self.sums, self._two) if give else (0, None)):
                at = held & (1 << room + give + 1) - 1
                while at:
                    total = at.bit_length() - 1
                    d = total - give
                    if d <= best:
                        break
                    got = pick(k, total, mine + d)
                    if got is not None:
                        best, found = d, (give, *got)
                        break
                    at ^= 1 << total
            if best == room:
                break
        if found is None:
            return False
        give, a, take = found
        self._leave(k)
        self._leave(a)
        back = (give,) if give else ()
        self._change(k, back, take)
        self._change(a, take, back)
        for b in (k, a):
            if 0 < self.fill[b] < self.capacity:
                self._enter(b)
        return True

    def _one(self, k: int, size: int, below: int):
        others = [a for a in self.holders[size] if a != k and self.fill[a] < below]
        return (min(others, key=lambda a: (self.fill[a], a)), (size,)) if others else None

    def _two(self, k: int, total: int, below: int):
        now = self.pairs[total] = [x for x in self.pairs[total] if self.version[x[0]] == x[2]]
        if not now:
            self.sums &= ~(1 << total)
        others = [x for x in now if x[0] != k and self.fill[x[0]] < below]
        if not others:
            return None
        a, s, _ = min(others, key=lambda x: (self.fill[x[0]], x))
        return a, (s, total - s)


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search on the underfull bins of a packing; returns the bins that still hold items.

    Bins are served from the fullest to the emptiest; each takes the best exchange of one
    for one, two for one, or move until none raises the squared fill. Rounds follow until
    one empties no bin.
    """
    counts: list[dict[int, int]] = []
    for b in bins:
        own: dict[int, int] = defaultdict(int)
        for i in b:
            own[sizes[i]] += 1
        counts.append(dict(own))
    search = _Search(counts, capacity)
    while True:
        before = sum(f > 0 for f in search.fill)
        for k in sorted(search.open(), key=lambda k: (-search.fill[k], k)):
            while 0 < search.fill[k] < capacity and search.step(k):
                pass
        if sum(f > 0 for f in search.fill) == before:
            break
    # Items of a size take the places of that size in order.
    waiting: dict[int, list[int]] = defaultdict(list)
    for i in sorted((i for b in bins for i in b), reverse=True):
        waiting[sizes[i]].append(i)
    return [[waiting[s].pop() for s in sorted(b) for _ in range(b[s])] for b in counts if b]


def pack(sizes: list[int], capacity: int) -> np.ndarray:
    """The bin of each item; sizes lie in 1..capacity."""
    out = np.zeros(len(sizes), np.int64)
    for k, b in enumerate(improve(first_packing(sizes, capacity), sizes, capacity)):
        out[b] = k
    return out


def _places(pdf: pd.DataFrame, capacity: int):
    """Ids and sizes of a group in a fixed order, their full containers, and what is left to pack."""
    pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
    doc, size = np.repeat(pdf["doc_id"].to_numpy(), pdf["copies"].to_numpy()), np.repeat(pdf["n_tokens"].to_numpy(), pdf["copies"].to_numpy())
    # Texts beyond the capacity: full containers of their own, and a rest that is packed like a text.
    n_full = np.where(size > capacity, size // capacity, 0)
    left = np.where(size > capacity, size % capacity, size)
    return doc, n_full, left, np.flatnonzero(left > 0)


def _fill_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    kind, group, capacity = key[0], int(key[1]), int(pdf["capacity_tokens"].iloc[0])
    doc, n_full, left, some = _places(pdf, capacity)
    at = np.repeat(np.arange(len(doc)), n_full)
    piece = np.arange(len(at)) - np.repeat(np.cumsum(n_full) - n_full, n_full)
    bins = pack(left[some].tolist(), capacity)
    ids = [f"{group}-{k}" for k in bins] + [f"{group}-s{k}" for k in range(len(at))]
    return pd.DataFrame({
        "container_kind": kind,
        "container_id": ids,
        "doc_id": np.concatenate([doc[some], doc[at]]),
        "piece": np.concatenate([n_full[some], piece]).astype(np.int32),
        "start_token": np.concatenate([n_full[some] * capacity, piece * capacity]),
        "n_tokens": np.concatenate([left[some], np.full(len(at), capacity)]),
    })


REPORT = "container_kind string, containers long, before_search long, items long, tokens long"


def _report_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity_tokens"].iloc[0])
    _, n_full, left, some = _places(pdf, capacity)
    sizes, full = left[some].tolist(), int(n_full.sum())
    first = first_packing(sizes, capacity)
    before = len(first)
    after = len(improve(first, sizes, capacity))
    return pd.DataFrame([(key[0], after + full, before + full, len(sizes) + full, sum(sizes) + full * capacity)], columns=[c.split()[0] for c in REPORT.split(", ")])


#: Copies of a text that stay together at most.
COPIES = 1_000


def _grouped(sized: DataFrame, kinds: DataFrame, group_items: int):
    items = cut(sized.filter(F.col("n_tokens") > 0).groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("_n")))
    n = items.agg(F.sum("_n")).first()[0] or 0
    groups = max(1, -(-n // group_items))
    # Repeated rows are counted before they move, and spread in parts of a bounded number of copies.
    parts = items.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))))
    copies = F.least(F.lit(COPIES), F.col("_n") - F.col("_part") * COPIES).alias("copies")
    parts = parts.select("doc_id", "n_tokens", copies, F.pmod(F.xxhash64("doc_id", "n_tokens", "_part"), F.lit(groups)).alias("_g"))
    kinds = kinds.filter(F.col("capacity_tokens") > 0).select("container_kind", "capacity_tokens")
    # Each text is wanted once per kind: the few kinds ride along as one array.
    every = bounded(kinds.agg(F.collect_list(F.struct("container_kind", "capacity_tokens")).alias("_kinds")))
    rows = parts.join(every, F.lit(True)).withColumn("_k", F.explode("_kinds"))
    return rows.select("doc_id", "n_tokens", "copies", "_g", F.col("_k.container_kind").alias("container_kind"), F.col("_k.capacity_tokens").alias("capacity_tokens")).groupBy("container_kind", "_g")


def fill_containers(sized: DataFrame, kinds: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Every text in a container of each kind: (container_kind, container_id, doc_id, piece, start_token, n_tokens).

    sized: doc_id, n_tokens. kinds: container_kind, capacity_tokens (positive). A text is
    split only where it alone exceeds the capacity: into full containers and one rest. Texts
    without tokens (null or empty) need no place and are left out; repeated rows are placed
    each. Groups are formed by a hash of id and size, so they depend on no key and on no
    partitioning.
    """
    return _grouped(sized, kinds, group_items).applyInPandas(_fill_group, SCHEMA)


def report(sized: DataFrame, kinds: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Per kind: containers after and before the search, the least number that could hold all tokens, items, tokens and the share of the capacity used."""
    out = _grouped(sized, kinds, group_items).applyInPandas(_report_group, REPORT)
    out = out.groupBy("container_kind").agg(*[F.sum(c).alias(c) for c in ("containers", "before_search", "items", "tokens")]).join(bounded(kinds), "container_kind")
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers")
    return out.select("container_kind", "capacity_tokens", "containers", "before_search", least, "items", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("share_used"))


def _sized(spark, sf_dir: str, vocabulary: str) -> DataFrame:
    return with_sizes(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


def p7_containers(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return fill_containers(_sized(spark, sf_dir, vocabulary), table(spark, sf_dir, "container_sizes"))


def p7_report(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return report(_sized(spark, sf_dir, vocabulary), table(spark, sf_dir, "container_sizes"))


def p7_by_characters(spark, sf_dir: str) -> DataFrame:
    """The same packing with sizes in characters, which SQL can count: texts, pieces and characters placed, and faults (none may occur)."""
    kinds = table(spark, sf_dir, "container_sizes")
    sized = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_tokens"))
    packed = fill_containers(sized, kinds)
    bins = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"))
    full = bins.join(bounded(kinds), "container_kind").groupBy("container_kind").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    texts = packed.groupBy("container_kind", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("upto"))
    held = texts.groupBy("container_kind").agg(F.count(F.lit(1)).alias("texts"), F.sum("pieces").alias("pieces"), F.sum("n").alias("characters"), F.count_if(F.col("n") != F.col("upto")).alias("gaps"))
    return held.join(full, "container_kind")


BY_CHARACTERS = """
select container_kind, count(*) as texts, cast(sum(case when n <= capacity_tokens then 1 else (n + capacity_tokens - 1) // capacity_tokens end) as bigint) as pieces,
  cast(sum(n) as bigint) as characters, cast(0 as bigint) as gaps, cast(0 as bigint) as overfull
from (select doc_id, length(text) as n from documents where length(text) > 0) d cross join container_sizes group by container_kind
"""
