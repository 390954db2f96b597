"""Documents packed into containers of a fixed number of tokens.

Sizes are counted once, in tokens of a public tokenizer. A document longer than
the capacity is cut into full pieces, which are containers of their own, and one
rest; everything else is never split. Rests and short documents are dealt to
blocks by hash, and each block is packed by multiway differencing (Karmarkar and
Karp): the two partial partitions with the largest imbalance are merged, the
heaviest windows of one onto the lightest of the other, until one partition into
as many windows as the block's tokens need is left. Windows that are full to
within a tolerance stay as differencing made them. Where one exceeds the capacity
or stays slack, its items are placed best fit, largest first, and the number of
windows rises as far as that needs.

A block's share of unused room is below one container in some thousands, so the
number of blocks, and with it the data, may grow without a global step.

Defined results for odd input
-----------------------------
* null text or doc_id: no row. Empty text: a piece of no tokens in some container.
* repeated doc_id: one document, the longest of its texts.
* null or non-positive capacity: the plan gives no rows.
* empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.session import materialise, settled

#: Ranks of the tokenizer and its public split pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(path: str, pattern: str):
    import tiktoken

    loaded = tiktoken.__dict__.setdefault("_loaded_by_path", {})  # one per worker process
    if path not in loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        loaded[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return loaded[path]


def _sizer(path: str, pattern: str) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [len(encode(t)) for t in batch["text"]]})

    return count


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens) of every document, texts read whole."""
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInPandas(_sizer(tokenizer, pattern), "doc_id bigint, tokens bigint").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` windows of indices into ``sizes`` with near-equal sums (largest differencing method).

    A partial partition keeps its windows that hold something as a heap; the rest are zeros.
    Merging a small partition into a large one touches only as many windows as the small one has.
    """
    if not sizes:
        return []
    joined: dict[int, tuple[int, int]] = {}
    parts = {n: ([(s, n)], s) for n, s in enumerate(sizes)}
    queue = [(-s, n) for n, s in enumerate(sizes)]
    heapq.heapify(queue)
    window = part = len(sizes)
    while len(queue) > 1:
        (_, x), (_, y) = heapq.heappop(queue), heapq.heappop(queue)
        (a, top_a), (b, top_b) = parts.pop(x), parts.pop(y)
        if len(a) < len(b):
            a, b, top_a = b, a, top_b
        free = k - len(a)
        merged = []
        for n, (s, w) in enumerate(sorted(b, reverse=True)):
            if n < free:
                merged.append((s, w))
            else:
                lightest, v = heapq.heappop(a)
                joined[window] = (v, w)
                merged.append((lightest + s, window))
                window += 1
        for entry in merged:
            heapq.heappush(a, entry)
            top_a = max(top_a, entry[0])
        parts[part] = (a, top_a)
        heapq.heappush(queue, (-(top_a - (a[0][0] if len(a) == k else 0)), part))
        part += 1
    out = []
    for _, w in parts.popitem()[1][0]:
        stack, items = [w], []
        while stack:
            n = stack.pop()
            if n in joined:
                stack.extend(joined[n])
            else:
                items.append(n)
        out.append(items)
    return out


def best_fit(sizes: list[int], items: Iterable[int], capacity: int) -> list[list[int]]:
    """Windows of ``items``, largest first, each into the fullest window that still takes it."""
    room: list[tuple[int, int]] = []
    windows: list[list[int]] = []
    for n in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[n], -1))
        if at == len(room):
            windows.append([n])
            insort(room, (capacity - sizes[n], len(windows) - 1))
        else:
            left, w = room.pop(at)
            windows[w].append(n)
            insort(room, (left - sizes[n], w))
    return windows


def pack(sizes: list[int], capacity: int, rounds: int = 3, slack: float = 1 / 256) -> list[list[int]]:
    """Windows of indices into ``sizes``; no window exceeds ``capacity``, no size may."""
    least = capacity - max(1, int(capacity * slack))
    kept: list[list[int]] = []
    pool = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    for _ in range(rounds):
        total = sum(sizes[i] for i in pool)
        if total <= capacity:
            break
        windows = [[pool[i] for i in w] for w in differencing([sizes[i] for i in pool], math.ceil(total / capacity))]
        full = [least <= sum(sizes[i] for i in w) <= capacity for w in windows]
        kept += [w for w, ok in zip(windows, full, strict=True) if ok]
        pool = sorted((i for w, ok in zip(windows, full, strict=True) if not ok for i in w), key=lambda i: (-sizes[i], i))
        if not any(full):
            break
    return kept + best_fit(sizes, pool, capacity)


def balance(sizes: list[int], capacity: int, step: float = 1 / 256) -> list[list[int]]:
    """Differencing alone: near-equal windows, more and more of them until none exceeds ``capacity``."""
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k = min(len(sizes), k + max(1, int(k * step)))


def _block_packer(packer: Callable[[list[int], int], list[list[int]]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack_block(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["tokens", "doc_id"], ascending=[False, True], ignore_index=True)
        sizes = [int(s) for s in block["tokens"]]
        names = [""] * len(sizes)
        prefix = f"b{block['block'].iloc[0]}-"
        for n, items in enumerate(packer(sizes, int(block["capacity"].iloc[0]))):
            for i in items:
                names[i] = prefix + str(n)
        return pd.DataFrame({"plan_id": block["plan_id"], "doc_id": block["doc_id"], "piece": block["piece"], "token_start": block["token_start"], "tokens": block["tokens"], "container": names})

    return pack_block


@settled("packed")
def pack_documents(
    documents: DataFrame, plans: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, block_items: int = 20_000, max_plans: int = 1000, fit: bool = True
) -> DataFrame:
    """(plan_id, doc_id, piece, token_start, tokens, container) of every document or piece under every plan.

    Plans are a stated, short list (``max_plans`` is checked); sizes alone are shuffled, not texts.
    Without ``fit`` all windows come from differencing (:func:`balance`), with it slack ones are placed anew (:func:`pack`).
    """
    sizes = materialise(token_sizes(documents, tokenizer, pattern), "sizes")
    listed = [(r[0], r[1]) for r in plans.where("plan_id is not null and capacity_tokens > 0").select("plan_id", "capacity_tokens").distinct().limit(max_plans + 1).collect()]
    if len(listed) > max_plans:
        raise ValueError(f"more than {max_plans} plans")
    schema = "plan_id int, doc_id bigint, piece int, token_start bigint, tokens bigint, container string"
    if not listed:
        return documents.sparkSession.createDataFrame([], schema)
    blocks = max(1, math.ceil(sizes.count() / block_items))
    each = F.explode(F.array(*[F.struct(F.lit(p).cast("int").alias("plan_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in sorted(listed)])).alias("plan")
    sized = sizes.select("doc_id", "tokens", each).select("doc_id", "tokens", "plan.*")
    sized = sized.withColumn("whole", F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("bigint"))
    pieces = (
        sized.where("whole > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))))
        .select("plan_id", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("tokens"), F.concat_ws("-", F.lit("d"), "doc_id", "piece").alias("container"))
    )
    rest = F.col("tokens") - F.col("whole") * F.col("capacity")
    rests = sized.where((F.col("whole") == 0) | (rest > 0)).select(
        "plan_id", "capacity", "doc_id", F.col("whole").cast("int").alias("piece"), (F.col("whole") * F.col("capacity")).alias("token_start"), rest.alias("tokens"),
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"),
    )
    return rests.groupBy("plan_id", "block").applyInPandas(_block_packer(pack if fit else balance), schema).unionByName(pieces)


def fill_report(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, n_containers, n_pieces, tokens, unused_tokens, over_full) per plan."""
    used = packed.groupBy("plan_id", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("n"))
    caps = plans.select("plan_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    return used.join(caps, "plan_id").groupBy("plan_id").agg(
        F.count("*").alias("n_containers"),
        F.sum("n").alias("n_pieces"),
        F.sum("used").alias("tokens"),
        F.sum(F.col("capacity") - F.col("used")).alias("unused_tokens"),
        F.count_if(F.col("used") > F.col("capacity")).alias("over_full"),
    )
