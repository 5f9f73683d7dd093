"""Filling fixed-capacity containers with texts.

Minimum bin slack: each container takes the largest text left and the fullest feasible combination of the others, found
by subset-sum dynamic programming over bitsets; the combination is then removed. Only the lengths matter to it, and of
those there are at most as many as the capacity has tokens, so the plan is made on the histogram of lengths, a
combination as often at once as its lengths allow. Texts are then numbered within their length (in salted parts, so a
length that holds any share of the rows is spread) and look their container up in the plan.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citebase.session import checkpointed

#: The public tokenizer whose tokens are counted, and its folder.
TOKENIZER, FOLDER = "byte_bpe_multi_50k.tiktoken", "/opt/tokenizers"
#: Different blank-separated pieces whose token counts a worker remembers.
CACHE = 500_000
#: Kinds of containers planned at once, which with their capacities bound a broadcast plan; more are planned in turn.
KINDS_BOUND = 100
#: Bytes of partial sums that a combination holds before they are put down as numbers of steps.
STEPS_BYTES = 1 << 26
#: Parts into which the texts of one length are spread.
SALTS = 256
#: Fixed value: the pattern that parts a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_RUNS = re.compile(r"\s \s|\s $")


class TokenCounter:
    """Tokens of a text, counted piece by piece where it is parted by single blanks; pieces recur, so counts are kept.

    The pattern never joins characters across a blank that follows a character other than white space, so the counts of
    the pieces add up; texts with longer runs of blanks are encoded whole.
    """

    def __init__(self, folder: str = FOLDER, name: str = TOKENIZER):
        import tiktoken

        with open(f"{folder}/{name}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if _RUNS.search(text):
            return len(self.encode(text))
        first, *rest = text.split(" ")
        known, total = self.known, len(self.encode(first))
        for p in rest:
            n = known.get(p)
            if n is None:
                if len(known) >= CACHE:
                    known.clear()
                n = known[p] = len(self.encode(" " + p))
            total += n
        return total


def token_sizes(documents: DataFrame, folder: str = FOLDER, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every text; null and empty texts have none."""

    def run(batches):
        count = TokenCounter(folder, name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, tokens bigint")


def fullest(capacity: int, sizes: list[int], left: dict[int, int]) -> dict[int, int]:
    """The fullest combination of the lengths left that fits: subset sums as bits of one integer, size by size.

    ``sizes`` descend. Stops as soon as the capacity is met. Of each step only the sums that it was the first to reach are
    kept; once they hold ``STEPS_BYTES`` they are put down as one number for each sum, so memory stays the capacity's.
    """
    reach, full, steps, held, first = 1, 1 << capacity, [], 0, None
    mask = (full << 1) - 1
    for s in sizes:
        if s > capacity:
            continue
        n, unit = min(left[s], capacity // s), 1
        while n > 0:  # binary parts of the multiplicity
            k = min(unit, n)
            new = (reach << (s * k)) & mask & ~reach
            if new:
                steps.append((s, k, new))
                reach |= new
                held += new.bit_length() // 8
                if held > STEPS_BYTES:
                    first = _put_down(first, steps, capacity)
                    held = 0
            n, unit = n - k, unit * 2
        if reach & full:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for s, k, new in reversed(steps):  # what a step added to was reached by an earlier one
        if new and (new >> total) & 1:
            taken[s] += k
            total -= s * k
    while total:
        s, k, _ = steps[first[total] - 1]
        taken[s] += k
        total -= s * k
    return dict(taken)


def _put_down(first: np.ndarray | None, steps: list[tuple[int, int, int]], capacity: int) -> np.ndarray:
    """The number of the step that first reached each sum; the steps' own sums are emptied."""
    width = capacity // 8 + 1
    first = np.zeros(8 * width, np.int32) if first is None else first
    for at, (s, k, new) in enumerate(steps):
        if new:
            first[np.unpackbits(np.frombuffer(new.to_bytes(width, "little"), np.uint8), bitorder="little").view(bool)] = at + 1
            steps[at] = s, k, 0
    return first


def pack_lengths(capacity: int, histogram: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, per container, first container, containers) so that every text of each length has its place."""
    left = {s: n for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    sizes, used, container, plan = sorted(left, reverse=True), defaultdict(int), 0, []
    while sizes:
        seed = sizes[0]
        left[seed] -= 1
        taken = fullest(capacity - seed, [s for s in sizes if left[s]], left)
        left[seed] += 1
        taken[seed] = taken.get(seed, 0) + 1
        times = min(left[s] // k for s, k in taken.items())
        for s, k in taken.items():
            plan.append((s, used[s], k, container, times))
            used[s] += k * times
            left[s] -= k * times
        container += times
        sizes = [s for s in sizes if left[s]]
    if histogram.get(0):
        plan.append((0, 0, histogram[0], 0, 1))
    return plan


def pack(documents: DataFrame, container_sizes: DataFrame, folder: str = FOLDER, name: str = TOKENIZER) -> DataFrame:
    """(container_kind, container_id, doc_id, piece_index, tokens): every text in a container of each kind.

    Only a text longer than the capacity is cut, into full containers and a rest. Texts without tokens go to container 0.
    Kinds with a null capacity or one below 1 are left out; of a kind with several capacities the largest counts. Repeated rows
    are placed each. Container ids run from 0.
    """
    kinds = [tuple(r) for r in container_sizes.where("capacity_tokens > 0 and container_kind is not null").groupBy("container_kind").agg(F.max("capacity_tokens")).collect()]
    sizes = checkpointed(token_sizes(documents, folder, name))
    parts = [_pack(sizes, sorted(kinds)[k : k + KINDS_BOUND]) for k in range(0, len(kinds) or 1, KINDS_BOUND)]
    return reduce(DataFrame.unionByName, parts)


def _pack(sizes: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    spark = sizes.sparkSession
    schema = "container_kind string, capacity bigint"
    each = F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in kinds)) if kinds else F.array().cast(f"array<struct<{schema}>>")
    wide = sizes.select("doc_id", "tokens", F.explode(each).alias("c")).select("doc_id", "tokens", "c.*")
    last = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    items = wide.withColumn("piece_index", F.explode(F.sequence(F.lit(0), last))).select(
        "container_kind", "capacity", "doc_id", "piece_index", F.least("capacity", F.col("tokens") - F.col("piece_index") * F.col("capacity")).alias("size"), F.pmod(F.xxhash64("doc_id", "piece_index"), F.lit(SALTS)).alias("salt")
    )
    parts = checkpointed(items.groupBy("container_kind", "capacity", "size", "salt").count())
    histogram = parts.groupBy("container_kind", "capacity", "size").agg(F.sum("count").alias("count"))

    def plan(group: pd.DataFrame) -> pd.DataFrame:  # a row for each length: at most the capacity
        rows = pack_lengths(int(group["capacity"].iloc[0]), {int(s): int(n) for s, n in zip(group["size"], group["count"])})
        out = pd.DataFrame(rows, columns=["size", "start", "per", "container", "times"], dtype="int64")
        out.insert(0, "container_kind", group["container_kind"].iloc[0])
        return out

    made = histogram.groupBy("container_kind").applyInPandas(plan, "container_kind string, size bigint, start bigint, per bigint, container bigint, times bigint")
    lookup = defaultdict(list)
    # bounded by the capacities; sorted here, as a sort by the cluster would sample and so make the plan twice
    for k, s, start, per, container, _ in sorted(map(tuple, made.collect())):
        lookup[k, s].append((start, per, container))
    handle = spark.sparkContext.broadcast({key: tuple(np.array(c) for c in zip(*rows)) for key, rows in lookup.items()})
    before = Window.partitionBy("container_kind", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("container_kind", "size", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("container_kind", "size", "salt").orderBy("doc_id", "piece_index")
    ranked = items.withColumn("at", F.row_number().over(within)).join(offsets, ["container_kind", "size", "salt"])
    ranked = ranked.select("container_kind", "doc_id", "piece_index", "size", (F.col("offset") + F.col("at") - 1).alias("rank"))

    def place(batches):
        places = {key: (starts.tolist(), per.tolist(), first.tolist()) for key, (starts, per, first) in handle.value.items()}
        for b in batches:
            ids = []
            for kind, size, rank in zip(*(b.column(k).to_pylist() for k in (0, 3, 4))):
                starts, per, first = places[kind, size]
                j = bisect_right(starts, rank) - 1
                ids.append(first[j] + (rank - starts[j]) // per[j])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), b.column(1), b.column(2), b.column(3)], ["container_kind", "container_id", "doc_id", "piece_index", "tokens"])

    return ranked.mapInArrow(place, "container_kind string, container_id bigint, doc_id bigint, piece_index int, tokens bigint")
