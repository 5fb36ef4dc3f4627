"""Filling fixed-capacity containers with documents by a grouping genetic algorithm on islands.

1. Sizes are counted in tokens of a public tokenizer. A text longer than a container is cut into full pieces,
   each a container of its own, and a rest; no other text is split.
2. Items are spread by hash over groups of about GROUP items; every group is packed for itself, so no task ever
   holds more than a group, whatever the corpus's size.
3. In each group ISLANDS populations evolve apart. Crossover takes whole well-filled containers of one parent
   into the other, drops the containers there that hold the same items, lets displaced items take the places of one
   or two items where that fills a container better, and best-fits what is left; mutation opens the emptiest
   containers. After each of EPOCHS epochs the best packings of every island migrate to the next one. Groups that
   reach the lower bound (their tokens over the capacity, rounded up) are done: nothing can be better.
4. The items of containers that stay emptier than TAIL are packed once more, across groups.

Defined results: null texts and texts without tokens have nothing to place and give no row; repeated rows are
separate items; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize

CAPACITY = 2048
GROUP, ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITE = 2000, 3, 4, 12, 8, 2
#: Containers of a child in which displaced items may take places, and the largest items of a container that may give way.
LOCAL, GIVING = 80, 6
#: Containers emptier than this are packed again across groups.
TAIL = 0.97

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how texts are split into words before byte-pair encoding with this vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def tokenizer(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of all documents with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t.as_py())) for t in b.column(1)], pa.int64())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, "doc_id bigint, n_tokens bigint")


class Packing:
    """Containers as lists of items, with how full they are."""

    __slots__ = ("bins", "fill")

    def __init__(self, bins: list[list[int]], fill: list[int]):
        self.bins, self.fill = bins, fill

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer containers first; then unevenly filled ones, which leave the larger gaps."""
        return -len(self.bins), sum((f / capacity) ** 2 for f in self.fill)

    def assignment(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for k, b in enumerate(self.bins):
            out[b] = k
        return out

    @classmethod
    def of(cls, assignment: np.ndarray, sizes: list[int]) -> Packing:
        count = int(assignment.max()) + 1 if len(assignment) else 0
        bins: list[list[int]] = [[] for _ in range(count)]
        fill = [0] * count
        for i, k in enumerate(assignment.tolist()):
            bins[k].append(i)
            fill[k] += sizes[i]
        return cls(bins, fill)


def best_fit(packing: Packing, items: list[int], sizes: list[int], capacity: int) -> None:
    """Put items, in the given order, where the least room is left over."""
    bins, fill = packing.bins, packing.fill
    room = sorted(((capacity - f) << 32) | k for k, f in enumerate(fill))
    for i in items:
        s = sizes[i]
        at = bisect_left(room, s << 32)
        if at < len(room):
            k = room.pop(at) & 0xFFFFFFFF
            bins[k].append(i)
            fill[k] += s
        else:
            k = len(bins)
            bins.append([i])
            fill.append(s)
        insort(room, ((capacity - fill[k]) << 32) | k)


def seedling(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> Packing:
    """Best fit of the items by falling size, blurred by noise."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random()))
    p = Packing([], [])
    best_fit(p, order, sizes, capacity)
    return p


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """a with some of b's best-filled containers; a's containers that share items with them are opened."""
    ranked = sorted(range(len(b.bins)), key=lambda k: -b.fill[k])[: max(1, len(b.bins) // 2)]
    taken = rng.sample(ranked, max(1, len(ranked) // 3))
    inside = {i for k in taken for i in b.bins[k]}
    child, displaced = Packing([list(b.bins[k]) for k in taken], [b.fill[k] for k in taken]), []
    for items, f in zip(a.bins, a.fill):
        if inside.isdisjoint(items):
            child.bins.append(list(items))
            child.fill.append(f)
        else:
            displaced.extend(i for i in items if i not in inside)
    displaced.extend(mutate(child, rng))
    displaced = take_places(child, displaced, sizes, capacity, rng)
    displaced.sort(key=lambda i: -sizes[i])
    best_fit(child, displaced, sizes, capacity)
    return child


def take_places(p: Packing, free: list[int], sizes: list[int], capacity: int, rng: random.Random) -> list[int]:
    """Let one or two free items take the places of one or two items of a container where that fills it better; what is free then.

    The smaller items that come out are easier to fit than the larger ones that went in.
    """
    free = sorted(free, key=sizes.__getitem__)
    weights = [sizes[i] for i in free]
    for k in rng.sample(range(len(p.bins)), min(LOCAL, len(p.bins))):
        slack = capacity - p.fill[k]
        if not slack or not free:
            continue
        giving = sorted(p.bins[k], key=lambda i: -sizes[i])[:GIVING]
        best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
        for out in [(a,) for a in giving] + list(combinations(giving, 2)):
            gone = sum(sizes[i] for i in out)
            most = gone + slack
            at = bisect_right(weights, most) - 1
            if at >= 0 and weights[at] - gone > best[0]:
                best = (weights[at] - gone, out, (at,))
            if best[0] == slack:
                break
            high = len(free) - 1
            for low in range(len(free)):  # the heaviest pair of free items that fits, by two pointers
                while high > low and weights[low] + weights[high] > most:
                    high -= 1
                if high <= low:
                    break
                if weights[low] + weights[high] - gone > best[0]:
                    best = (weights[low] + weights[high] - gone, out, (low, high))
        gain, out, into = best
        if gain:
            p.bins[k] = [i for i in p.bins[k] if i not in out] + [free[i] for i in into]
            p.fill[k] += gain
            free = sorted([x for i, x in enumerate(free) if i not in into] + list(out), key=sizes.__getitem__)
            weights = [sizes[i] for i in free]
    return free


def mutate(p: Packing, rng: random.Random) -> list[int]:
    """Open the emptiest containers and a few others; their items."""
    if len(p.bins) < 4:
        return []
    worst = sorted(range(len(p.bins)), key=p.fill.__getitem__)[:3]
    open_ = set(worst) | set(rng.sample(range(len(p.bins)), 2))
    items = [i for k in open_ for i in p.bins[k]]
    p.bins[:] = [b for k, b in enumerate(p.bins) if k not in open_]
    p.fill[:] = [f for k, f in enumerate(p.fill) if k not in open_]
    return items


def evolve(population: list[Packing], sizes: list[int], capacity: int, generations: int, rng: random.Random) -> list[Packing]:
    """The population after some generations, best first; stops at the lower bound."""
    bound = -(-sum(sizes) // capacity)
    rank = lambda p: p.fitness(capacity)
    population.sort(key=rank, reverse=True)
    for _ in range(generations):
        if len(population[0].bins) <= bound:
            break
        parents = population[: max(2, len(population) // 2)]
        children = [crossover(*rng.sample(parents, 2) if len(parents) > 1 else (parents[0], parents[0]), sizes, capacity, rng) for _ in range(len(population) - 1)]
        population = sorted([population[0], *children, *population[1:]], key=rank, reverse=True)[: len(population)]
    return population


_STATE = "grp bigint, island int, bins int, bound int, score double, sizes binary, assignment binary"


def _rows(group: int, island: int, sizes: np.ndarray, capacity: int, packings: list[Packing]) -> pd.DataFrame:
    raw = sizes.astype(np.int32).tobytes()
    return pd.DataFrame(
        [(group, island, len(p.bins), int(-(-int(sizes.sum()) // capacity)), p.fitness(capacity)[1], raw, p.assignment(len(sizes)).tobytes()) for p in packings],
        columns=["grp", "island", "bins", "bound", "score", "sizes", "assignment"],
    )


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, generations: int = GENERATIONS, epochs: int = EPOCHS) -> DataFrame:
    """(item, size, grp, bin): a container for every item. items: item (string, unique), size (at most the capacity)."""
    n = items.count()
    groups = max(1, -(-n // group))
    items = items.select("item", "size", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("grp"))

    def found(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """An island's first population and its first epoch."""
        sizes = pdf.sort_values("item", kind="stable")["size"].to_numpy()
        rng, few = random.Random(f"{key[0]}/{key[1]}"), sizes.tolist()
        first = [seedling(few, capacity, rng, 0.0 if key[1] == 0 and k == 0 else 0.05 + 0.1 * k) for k in range(1 if _optimal(few, capacity) else POPULATION)]
        return _rows(key[0], key[1], sizes, capacity, evolve(first, few, capacity, generations, rng)[:ELITE])

    def epoch(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """An island's own elite with the immigrants, grown to a population and evolved."""
        sizes = np.frombuffer(pdf["sizes"].iloc[0], np.int32)
        few = sizes.tolist()
        elite = [Packing.of(np.frombuffer(a, np.int32), few) for a in pdf.sort_values(["bins", "score"], ascending=[True, False])["assignment"]]
        rng = random.Random(f"{key[0]}/{key[1]}/{len(elite)}")
        fresh = [seedling(few, capacity, rng, 0.3) for _ in range(max(0, POPULATION - len(elite)))]
        return _rows(int(key[0]), int(key[1]), sizes, capacity, evolve([*elite, *fresh], few, capacity, generations, rng)[:ELITE])

    spread = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    state = materialize(spread.groupBy("grp", "island").applyInPandas(found, _STATE), "islands")
    done = []
    for _ in range(epochs - 1):
        solved = state.groupBy("grp").agg((F.min("bins") <= F.min("bound")).alias("solved"))
        flagged = state.join(solved, "grp")
        left = flagged.where(~F.col("solved")).drop("solved")
        if left.isEmpty():
            break
        done.append(flagged.where("solved").drop("solved"))
        migrants = left.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        state = materialize(left.unionByName(migrants).groupBy("grp", "island").applyInPandas(epoch, _STATE), "islands")
    for d in done:
        state = state.unionByName(d.select(state.columns))
    best = state.groupBy("grp").agg(F.max(F.struct(-F.col("bins"), F.col("score"), F.col("assignment"))).alias("b")).select("grp", F.col("b.assignment").alias("assignment"))

    def place(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left.sort_values("item", kind="stable")
        return out.assign(bin=np.frombuffer(right["assignment"].iloc[0], np.int32))[["item", "size", "grp", "bin"]]

    return items.groupBy("grp").cogroup(best.groupBy("grp")).applyInPandas(place, "item string, size bigint, grp bigint, bin int")


def _optimal(sizes: list[int], capacity: int) -> bool:
    """Whether plain best fit already reaches the lower bound."""
    return len(seedling(sizes, capacity, random.Random(0), 0.0).bins) <= -(-sum(sizes) // capacity)


def fill_containers(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, group: int = GROUP) -> DataFrame:
    """(container, doc_id, piece_no, first_token, n_tokens): what lies in each container.

    first_token and n_tokens give the piece as a span of the document's tokens.
    """
    counts = token_counts(documents, path).where(F.col("n_tokens") > 0).withColumn("copy", F.monotonically_increasing_id())
    counts = materialize(counts, "tokens")
    whole = F.floor(F.col("n_tokens") / capacity)
    full = (
        counts.where(whole > 0)
        .select("doc_id", "copy", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece_no"))
        .select(F.concat_ws("-", F.lit("f"), "copy", "piece_no").alias("container"), "doc_id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens"))
    )
    rests = counts.select("doc_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("copy").cast("string")).alias("item"), whole.cast("int").alias("piece_no"), (whole * capacity).alias("first_token"), (F.col("n_tokens") - whole * capacity).alias("size")).where(F.col("size") > 0)
    packed = materialize(pack(rests.select("item", "size"), capacity, group), "packed")
    fill = packed.groupBy("grp", "bin").agg(F.sum("size").alias("__fill"))
    judged = packed.join(fill, ["grp", "bin"])
    first = judged.where(F.col("__fill") >= TAIL * capacity).select("item", F.concat_ws("-", F.lit("a"), "grp", "bin").alias("container"))
    again = materialize(judged.where(F.col("__fill") < TAIL * capacity).select("item", "size"), "tail")
    second = pack(again, capacity, group).select("item", F.concat_ws("-", F.lit("b"), "grp", "bin").alias("container"))
    placed = rests.join(first.unionByName(second), "item").select("container", "doc_id", "piece_no", "first_token", F.col("size").alias("n_tokens"))
    return full.unionByName(placed)


def summary(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, bound, unused_share): how well the containers are filled; bound is the fewest possible."""
    return (
        containers.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
        .agg(F.count("*").alias("containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"))
        .select("containers", "tokens", F.ceil(F.col("tokens") / capacity).cast("bigint").alias("bound"), (1 - F.col("tokens").cast("double") / (F.col("containers") * capacity)).alias("unused_share"))
    )
