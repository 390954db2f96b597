"""Sentences of a page and of its translation paired up by optimal transport.

Every sentence is split into words once; from then on words are 64-bit hashes. A
bilingual lexicon is learned from all pages (sentences near each other, and
sentences that share code or numbers, count how often their words meet; a second
round counts the sentences the first one linked). It stays a table: each page is
joined with the entries of its own words, so neither the driver nor a task ever
holds the lexicon, and no entry is left out. It turns a source sentence into
a sparse vector over the words of the other language, which is compared with the
vectors of the translation's sentences. Per page an entropic transport plan
between the two sides is found by Sinkhorn scaling; each side has a null mass, so
that omitted and inserted sentences need no partner. Cells of the plan that carry
enough of a sentence's mass are the links: one to one, joins, divisions and moves
fall out of the same plan.

Pages are handled in windows of ``window`` source sentences against the part of
the translation around them, so a page of any length is spread over tasks. A
translation much longer than its source makes more windows, so neither side of
one grows with the page. Windows reach Python in batches of ``_BATCH_BYTES`` and
are unpacked a few at a time, with the lexicon's entries in flat arrays.
Sentences without a link get a second chance anywhere on their page: first those
that share rare code or numbers, then all, in blocks of ``window`` by their vectors.

Defined results for odd input
-----------------------------
* null ids, sides or texts, blank texts: ignored; a page with one side only: no rows.
* repeated (pair, side, number): one sentence, the greater text.
* null or oddly spelled language: told from the translation itself.
* empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlake.session import materialise, settled

_CODE = re.compile(r"`+([^`]+)`+")
_NUMBER = re.compile(r"\d+(?:[.,   '’]\d{3})+(?!\d)|\d+(?:[.,]\d+)*")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]+")
#: Frequent words of a language, to tell it from others (fixed values).
_STOPWORDS = {
    "de": frozenset("der die das und ist nicht den dem ein eine für mit auf von zu im wird nach bei sich".split()),
    "es": frozenset("el la los las y es no un una para con de en que se por del al lo su".split()),
    "fr": frozenset("le la les et est ne pas un une pour avec de dans que se par du au ce sa".split()),
}


def words(text: str) -> list[str]:
    """Comparable units of a sentence: code and numbers as they are, words in lower case, CJK runs as character pairs."""
    out: list[str] = []

    def take(mark: str) -> Callable[[re.Match], str]:
        return lambda m: out.append(mark + re.sub(r"[\s.,'’  ]", "", m[m.lastindex or 0]) if mark == "#" else mark + m[1].strip()) or " "

    text = _CODE.sub(take("`"), text)
    text = _NUMBER.sub(take("#"), text)
    for m in _LETTERS.finditer(text.lower()):
        run = m[0]
        if _CJK.search(run):
            for c in _CJK.findall(run):
                out += [c[n : n + 2] for n in range(len(c) - 1)] or [c]
            out += _LETTERS.findall(_CJK.sub(" ", run))
        else:
            out.append(run)
    return out


#: Kinds of words, in the lowest bits of their hash; long ones name one sentence.
WORD, NUMBER, LONG_NUMBER, LONGER_NUMBER, CODE, LONG_CODE = range(6)
_KIND = 7


def hashed(ws: list[str]) -> list[int]:
    """Words as signed 64-bit hashes with their kind in the lowest bits."""
    out = []
    for w in ws:
        kind = WORD
        if w[0] == "`":
            kind = LONG_CODE if len(w) > 3 else CODE
        elif w[0] == "#":
            kind = LONGER_NUMBER if len(w) > 4 else LONG_NUMBER if len(w) > 3 else NUMBER
        h = xxhash.xxh3_64_intdigest(w)
        out.append(((h & ~_KIND) | kind) - (1 << 63))
    return out


def _evidence(text: str, ws: list[str]) -> list[int]:
    """What a sentence says about its language: characters, CJK runs, frequent words of each known language."""
    return [len(text), len(_CJK.findall(text)), *(sum(w in stop for w in ws) for stop in _STOPWORDS.values())]


def language(tag: str | None, evidence: list[int]) -> str:
    """Two or three letters of the translation's language; where the tag says nothing, the sum of all its sentences' evidence decides."""
    head = re.match(r"[A-Za-z]{2,3}", tag or "")
    if head:
        return head[0].lower()
    size, cjk, *stops = evidence
    if cjk > 0.02 * size:
        return "zh"
    return max(zip(stops, _STOPWORDS, strict=True), key=lambda x: x[0])[1] if any(stops) else "und"


@dataclass
class Model:
    """What the lexicon knows of one page's words."""

    #: Per source word its translations and how sure they are.
    forward: dict[int, list[tuple[int, float]]]
    source_df: dict[int, int]
    target_df: dict[int, int]
    sentences: int
    #: Words of a source sentence per word of a target sentence.
    ratio: float


class _Side:
    """The sentences of one side as an incidence matrix over their distinct words."""

    def __init__(self, sentences: list[np.ndarray]):
        sizes = [len(x) for x in sentences]
        flat = np.concatenate(sentences) if sentences else np.zeros(0, np.int64)
        self.words, at = np.unique(flat.astype(np.int64), return_inverse=True)
        self.has = np.zeros((len(sentences), len(self.words)))
        self.has[np.repeat(np.arange(len(sentences)), sizes), at] = 1.0
        self.sizes = np.array(sizes, float)
        self.kind = self.words & _KIND

    def weights(self, df: dict[int, int], sentences: int) -> np.ndarray:
        # Code and numbers name one sentence; other words weigh by how rare they are.
        seen = np.array([df.get(w, 1) for w in self.words.tolist()], float)
        rare = np.clip(np.log(max(2, sentences) / np.maximum(seen, 1)) / 2, 0.05, 3.0)
        return np.where(self.kind >= CODE, 3.0, np.where(self.kind >= NUMBER, 2.0, rare))


def _blocks(rows: int, wide: int, cells: int = 4_000_000) -> list[slice]:
    """Slices of ``rows`` with at most ``cells`` cells each, one row at least."""
    step = max(1, cells // max(1, wide))
    return [slice(k, k + step) for k in range(0, rows, step)]


def similarity(source: _Side, target: _Side, model: Model) -> np.ndarray:
    """How far the vectors of two sentences cover each other, mostly by the better covered one."""
    place = {w: k for k, w in enumerate(target.words.tolist())}
    found = []
    for k, (w, kind) in enumerate(zip(source.words.tolist(), source.kind.tolist(), strict=True)):
        for b, q in [(w, 1.0)] if kind else model.forward.get(w, ()):
            if b in place:
                found.append((k, place[b], q))
    if not found:
        return np.zeros((len(source.sizes), len(target.sizes)))
    a, b, q = (np.array(x) for x in zip(*found, strict=True))
    s_weight, t_weight = source.weights(model.source_df, model.sentences), target.weights(model.target_df, model.sentences)
    # The best translation of every source word in each target sentence, and the other way round.
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    weighed = source.has[:, a[starts]] * s_weight[a[starts]]
    s_cover = np.concatenate([weighed @ np.maximum.reduceat(target.has[rows][:, b] * q, starts, axis=1).T for rows in _blocks(len(target.sizes), len(b))], axis=1)
    order = np.argsort(b, kind="stable")
    a, b, q = a[order], b[order], q[order]
    starts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    weighed = (target.has[:, b[starts]] * t_weight[b[starts]]).T
    t_cover = np.concatenate([np.maximum.reduceat(source.has[rows][:, a] * q, starts, axis=1) @ weighed for rows in _blocks(len(source.sizes), len(a))])
    s_part = s_cover / (1e-9 + source.has @ s_weight)[:, None]
    t_part = t_cover / (1e-9 + target.has @ t_weight)[None, :]
    return 0.65 * np.maximum(s_part, t_part) + 0.35 * np.minimum(s_part, t_part)


def transport(similar: np.ndarray, a: np.ndarray, b: np.ndarray, null_cost: float = 0.29, eps: float = 0.04, rounds: int = 60) -> np.ndarray:
    """Entropic plan between masses ``a`` and ``b`` with a null mass on each side; the real cells of it."""
    n, m = similar.shape
    cost = np.zeros((n + 1, m + 1))
    cost[:n, :m] = 1 - similar
    cost[:n, m] = cost[n, :m] = null_cost
    rows, cols = np.append(a, b.sum()), np.append(b, a.sum())
    kernel = np.exp(-cost / eps)
    v = np.ones(m + 1)
    for _ in range(rounds):
        u = rows / np.maximum(kernel @ v, 1e-300)
        v = cols / np.maximum(kernel.T @ u, 1e-300)
    return (u[:, None] * kernel * v)[:n, :m]


def align(source: _Side, target: _Side, model: Model, s_at: np.ndarray, t_at: np.ndarray, share: float = 0.3, least: float = 0.34) -> list[tuple[int, int, float]]:
    """(source index, target index, similarity) of the linked sentences. ``s_at``, ``t_at``: places from 0 to 1."""
    if not len(source.sizes) or not len(target.sizes):
        return []
    similar = similarity(source, target, model)
    near = 0.03 * np.exp(-np.abs(s_at[:, None] - t_at[None, :]) * 8)
    a, b = np.maximum(1.0, source.sizes), np.maximum(1.0, target.sizes) * model.ratio
    plan = transport(np.minimum(1.0, similar + near * (similar > 0.2)), a, b)
    linked = (plan >= share * np.minimum(a[:, None], b[None, :])) & (similar >= least)
    return [(int(i), int(j), float(similar[i, j])) for i, j in zip(*np.nonzero(linked), strict=True)]


def meetings(source: _Side, target: _Side, s_at: np.ndarray, t_at: np.ndarray) -> np.ndarray:
    """How likely two sentences belong together before a lexicon is known: by words that name one sentence, else by place."""
    naming = np.isin(source.kind, (LONG_NUMBER, LONGER_NUMBER, LONG_CODE)) & (source.has.sum(0) == 1)
    common, s_k, t_k = np.intersect1d(source.words[naming], target.words, return_indices=True)
    sure = (source.has[:, naming][:, s_k] @ target.has[:, t_k].T > 0).astype(float)
    near = 0.4 * (np.abs(s_at[:, None] - t_at[None, :]) <= 2.6 / max(1, len(s_at)))
    return np.where(sure.any(0)[None, :], sure, near)


# --- Spark --------------------------------------------------------------------------------------

#: Bytes that reach a Python worker at once, and windows that are unpacked at once.
_BATCH_BYTES, _UNPACKED = 8 << 20, 16


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``_BATCH_BYTES`` for what runs inside; less where the session says less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    given = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(key, str(min(given, _BATCH_BYTES) if given > 0 else _BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _written(df: DataFrame, name: str) -> DataFrame:
    with _small_batches(df.sparkSession):
        return materialise(df, name)


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator:
    """Rows one after the other; only a few are Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, _UNPACKED):
            yield from batch.slice(k, _UNPACKED).to_pandas().itertuples(index=False)


_SENTENCE = "pair_id bigint, side string, sent_no int, words array<bigint>, evidence array<int>"


def _split_sentences(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        split = [words(t) for t in batch["text"]]
        said = [_evidence(t.lower(), ws) if side == "translation" else [] for t, ws, side in zip(batch["text"], split, batch["side"], strict=True)]
        yield pd.DataFrame({"pair_id": batch["pair_id"], "side": batch["side"], "sent_no": batch["sent_no"], "words": [np.array(hashed(ws), np.int64) for ws in split], "evidence": said})


def _languages(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"pair_id": batch["pair_id"], "lang": [language(tag, list(e)) for tag, e in zip(batch["lang"], batch["e"], strict=True)]})


def units(pairs: DataFrame, pair_sentences: DataFrame, window: int = 200) -> DataFrame:
    """Pages cut into windows: ``window`` source sentences and the translation's sentences around the same place.

    The windows of a page overlap on the translation's side by half a window on either side.
    """
    one = (
        pair_sentences.where("pair_id is not null and sent_no is not null and side in ('source', 'translation') and trim(text) <> ''")
        .groupBy(F.col("pair_id").cast("bigint").alias("pair_id"), "side", F.col("sent_no").cast("int").alias("sent_no")).agg(F.max("text").alias("text"))
    )
    one = _written(one.mapInPandas(_split_sentences, _SENTENCE), "sentences")
    sizes = one.groupBy("pair_id").agg(
        F.count_if(F.col("side") == "source").alias("n_s"),
        F.count_if(F.col("side") == "translation").alias("n_t"),
        F.array(*[F.coalesce(F.sum(F.get("evidence", F.lit(k))), F.lit(0)) for k in range(2 + len(_STOPWORDS))]).alias("e"),
    ).where("n_s > 0 and n_t > 0")
    known = pairs.where("pair_id is not null").groupBy("pair_id").agg(F.max("lang").alias("lang"))
    sizes = sizes.join(known, "pair_id")
    sizes = sizes.drop("e", "lang").join(sizes.select("pair_id", "lang", "e").mapInPandas(_languages, "pair_id bigint, lang string"), "pair_id")
    placed = one.drop("evidence").join(sizes, "pair_id")
    source = F.col("side") == "source"
    # Places count sentences, not their numbers: gaps in the numbers would fill some windows and leave others empty.
    at = (F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("sent_no")) - 0.5) / F.when(source, F.col("n_s")).otherwise(F.col("n_t"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_s") / F.lit(window)).cast("int"), F.ceil(F.col("n_t") / F.lit(2 * window)).cast("int"))
    placed = placed.withColumns({"at": at, "parts": parts})
    home = F.least(F.floor(F.col("at") * F.col("parts")).cast("int"), F.col("parts") - 1)
    first = F.greatest(F.lit(0), F.floor(F.col("at") * F.col("parts") - 0.5).cast("int"))
    last = F.least(F.col("parts") - 1, F.floor(F.col("at") * F.col("parts") + 0.5).cast("int"))
    cut = placed.withColumn("part", F.explode(F.when(source, F.array(home)).otherwise(F.sequence(first, last))))
    row = F.struct("sent_no", "words", "at")
    grouped = cut.groupBy("pair_id", "lang", F.col("part").cast("bigint").alias("part")).agg(
        F.sort_array(F.collect_list(F.when(source, row))).alias("s"), F.sort_array(F.collect_list(F.when(~source, row))).alias("t")
    )
    pick = lambda side, name: F.transform(F.col(side), lambda x: x[name]).alias(f"{side}_{ {'sent_no': 'no'}.get(name, name) }")
    return grouped.select("pair_id", "lang", "part", *[pick(side, name) for side in "st" for name in ("sent_no", "words", "at")])


def _sides(r) -> tuple[_Side, _Side, np.ndarray, np.ndarray]:
    return _Side(list(r.s_words)), _Side(list(r.t_words)), np.asarray(r.s_at, float), np.asarray(r.t_at, float)


def _model(r) -> Model:
    to, at = list(zip(r.to_b.tolist(), r.to_q.tolist(), strict=True)), np.cumsum(r.s_to).tolist()
    forward = {w: to[end - k : end] for w, k, end in zip(r.s_known.tolist(), r.s_to.tolist(), at, strict=True) if k}
    s_df, t_df = (dict(zip(w.tolist(), n.tolist(), strict=True)) for w, n in ((r.s_known, r.s_n), (r.t_known, r.t_n)))
    return Model(forward, s_df, t_df, int(r.sentences), float(r.ratio))


_COUNT = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.float64())])


class _Counts:
    """Sums of (language, kind, a, b), folded whenever enough of them are waiting."""

    def __init__(self, room: int = 300_000):
        self.room, self.held = room, 0
        self.parts: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def add(self, lang: str, kind: str, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        if len(n):
            self.parts.setdefault((lang, kind), []).append((a, b, n))
            self.held += len(n)

    def full(self) -> bool:
        return self.held >= self.room

    def take(self) -> pd.DataFrame:
        parts, self.parts, self.held = self.parts, {}, 0
        out = []
        for (lang, kind), held in parts.items():
            first, second, count = (np.concatenate(x) for x in zip(*held, strict=True))
            a, a_at = np.unique(first, return_inverse=True)
            b, b_at = np.unique(second, return_inverse=True)
            pair, at = np.unique(a_at.astype(np.int64) * len(b) + b_at, return_inverse=True)
            out.append(pd.DataFrame({"lang": lang, "kind": kind, "a": a[pair // len(b)], "b": b[pair % len(b)], "n": np.bincount(at, count)}))
        return pd.concat(out) if out else pd.DataFrame({"lang": pd.Series(dtype=str), "kind": pd.Series(dtype=str), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "n": pd.Series(dtype=float)})


def _counter(trained: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        none = np.zeros(1, np.int64)
        taken = lambda: pa.RecordBatch.from_pandas(counts.take(), _COUNT, preserve_index=False)
        for r in _unpacked(batches):
            source, target, s_at, t_at = _sides(r)
            if not len(s_at) or not len(t_at):
                continue
            if trained:
                met = np.zeros((len(s_at), len(t_at)))
                for i, j, q in align(source, target, _model(r), s_at, t_at):
                    met[i, j] = q
            else:
                met = meetings(source, target, s_at, t_at)
            plain_s, plain_t = source.kind == WORD, target.kind == WORD
            s_has, t_has = source.has[:, plain_s], target.has[:, plain_t]
            s_words, t_words = source.words[plain_s], target.words[plain_t]
            for part in _blocks(len(s_words), len(t_words)):
                both = s_has[:, part].T @ met @ t_has
                i, j = np.nonzero(both)
                counts.add(r.lang, "b", s_words[part][i], t_words[j], both[i, j])
                if counts.full():
                    yield taken()
            zero_s, zero_t = np.zeros(len(s_words), np.int64), np.zeros(len(t_words), np.int64)
            counts.add(r.lang, "s", s_words, zero_s, s_has.T @ met.sum(1))
            counts.add(r.lang, "t", zero_t, t_words, t_has.T @ met.sum(0))
            counts.add(r.lang, "S", s_words, zero_s, s_has.sum(0))
            counts.add(r.lang, "T", t_words, zero_t, t_has.sum(0))
            counts.add(r.lang, "N", none, none, np.array([float(len(s_at))]))
            counts.add(r.lang, "n", none, none, np.array([float(len(t_at))]))
        yield taken()

    return count


def learn_lexicon(page_units: DataFrame, trained: bool, fan_out: int = 6) -> tuple[DataFrame, DataFrame]:
    """Association of words from all pages, as Dice coefficients of weighted meetings: two tables.

    ``entries`` (lang, side, w, n, to): every word with the sentences it stands in and its best ``fan_out``
    translations; ``languages`` (lang, sentences, ratio). Counting is a partial aggregation over all sentences.
    """
    counts = page_units.mapInArrow(_counter(trained), "lang string, kind string, a bigint, b bigint, n double")
    counts = _written(counts.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n")), "lexicon")
    s = counts.where("kind = 's'").select("lang", "a", F.col("n").alias("n_a"))
    t = counts.where("kind = 't'").select("lang", "b", F.col("n").alias("n_b"))
    met = counts.where("kind = 'b' and n >= 1.2").select("lang", "a", "b", "n").join(s, ["lang", "a"]).join(t, ["lang", "b"])  # one meeting proves nothing
    scored = met.withColumn("dice", 2 * F.col("n") / (F.col("n_a") + F.col("n_b"))).where("dice >= 0.05")
    top_a, top_b = (scored.groupBy("lang", c).agg(F.max("dice").alias(f"top_{c}")) for c in "ab")
    scored = scored.join(top_a, ["lang", "a"]).join(top_b, ["lang", "b"])
    scored = scored.withColumn("q", F.sqrt(F.col("dice") / F.col("top_a") * F.col("dice") / F.col("top_b"))).where("q >= 0.35")
    rank = F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("q"), "b"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= fan_out).groupBy("lang", F.col("a").alias("w")).agg(F.collect_list(F.struct("b", "q")).alias("to"))
    sides = counts.where("kind in ('S', 'T')").select("lang", F.lower("kind").alias("side"), F.col("a").alias("w"), F.col("n").cast("bigint").alias("n"))
    entries = sides.join(best.withColumn("side", F.lit("s")), ["lang", "side", "w"], "left")
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")))
    means = counts.where("kind in ('S', 'T', 'N', 'n')").groupBy("lang").agg(total("n").alias("sentences"), (total("S") / total("N")).alias("s_mean"), (total("T") / total("n")).alias("t_mean"))
    # Means, because windows repeat target sentences.
    ratio = F.coalesce(F.when((F.col("s_mean") > 0) & (F.col("t_mean") > 0), F.col("s_mean") / F.col("t_mean")), F.lit(1.0))
    return materialise(entries, "entries"), means.select("lang", F.col("sentences").cast("bigint").alias("sentences"), ratio.alias("ratio"))


def with_model(page_units: DataFrame, lexicon: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Units with the lexicon's entries of their own words, spread evenly over the tasks."""
    entries, languages = lexicon
    distinct = lambda c, side: F.transform(F.array_distinct(F.flatten(c)), lambda w: F.struct(F.lit(side).alias("side"), w.alias("w")))
    used = page_units.select("pair_id", "part", "lang", F.explode(F.concat(distinct("s_words", "s"), distinct("t_words", "t"))).alias("x")).select("pair_id", "part", "lang", "x.*")
    of = lambda side: F.coalesce(F.collect_list(F.when(F.col("side") == side, F.struct("w", "n", "to"))), F.array())
    known = used.join(entries.hint("merge"), ["lang", "side", "w"]).groupBy("pair_id", "part").agg(of("s").alias("ms"), of("t").alias("mt"))
    out = page_units.join(known.hint("merge"), ["pair_id", "part"], "left").join(languages, "lang", "left").na.fill({"sentences": 2, "ratio": 1.0})
    # Flat arrays: an entry as an object of its own would take many times its bytes in Python.
    to = F.flatten(F.transform("ms", lambda m: F.coalesce(m["to"], F.array())))
    flat = {"s_known": F.transform("ms", lambda m: m["w"]), "s_n": F.transform("ms", lambda m: m["n"]), "s_to": F.transform("ms", lambda m: F.coalesce(F.size(m["to"]), F.lit(0)))}
    flat |= {"to_b": F.transform(to, lambda x: x["b"]), "to_q": F.transform(to, lambda x: x["q"]), "t_known": F.transform("mt", lambda m: m["w"]), "t_n": F.transform("mt", lambda m: m["n"])}
    out = out.withColumns({name: F.coalesce(c, F.array()) for name, c in flat.items()}).drop("ms", "mt")
    spark = page_units.sparkSession
    # A stated number of partitions is kept: adaptive execution would pack the windows of long pages into one task.
    return out.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "pair_id", "part")


def _align_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("pair_id", pa.int64()), ("source_no", pa.int32()), ("translation_no", pa.int32()), ("similarity", pa.float64())])
    rows: list[tuple[int, int, int, float]] = []
    taken = lambda: pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=schema.names), schema, preserve_index=False)
    for r in _unpacked(batches):
        source, target, s_at, t_at = _sides(r)
        rows += [(r.pair_id, int(r.s_no[i]), int(r.t_no[j]), q) for i, j, q in align(source, target, _model(r), s_at, t_at)]
        if len(rows) >= 10_000:
            yield taken()
            rows.clear()
    yield taken()


_LINKS = "pair_id bigint, source_no int, translation_no int, similarity double"


@settled("aligned")
def align_pairs(pairs: DataFrame, pair_sentences: DataFrame, window: int = 200, rounds: int = 2) -> DataFrame:
    """(pair_id, source_no, translation_no, similarity) of all linked sentences."""
    pages = materialise(units(pairs, pair_sentences, window), "bitext")
    lexicon = learn_lexicon(pages, False)
    for _ in range(rounds - 1):
        lexicon = learn_lexicon(with_model(pages, lexicon), True)
    links = with_model(pages, lexicon).mapInArrow(_align_batches, _LINKS)
    links = _written(links, "links").groupBy("pair_id", "source_no", "translation_no").agg(F.max("similarity").alias("similarity"))
    several = pages.groupBy("pair_id").count().where("count > 1").select("pair_id")
    if several.isEmpty():  # every page was one window: nothing lies outside it
        return links
    cut = materialise(pages.join(several, "pair_id", "left_semi"), "long")
    links = materialise(links.unionByName(_far_moves(cut, links)), "far")
    rest = _written(with_model(materialise(_rest_blocks(cut, links, window), "rest"), lexicon).mapInArrow(_align_batches, _LINKS), "rest-links")
    # A sentence may be in several blocks' links; those about as good as its best one stay.
    top_s, top_t = (F.max("similarity").over(Window.partitionBy("pair_id", number)) for number in ("source_no", "translation_no"))
    rest = rest.withColumns({"top_s": top_s, "top_t": top_t}).where("similarity >= 0.8 * greatest(top_s, top_t)")
    return links.unionByName(rest.drop("top_s", "top_t"))


def _sentences_of(pages: DataFrame, side: str, number: str) -> DataFrame:
    rows = pages.select("pair_id", "lang", F.explode(F.arrays_zip(F.col(f"{side}_no"), F.col(f"{side}_words"))).alias("x"))
    return rows.select("pair_id", "lang", F.col("x")[f"{side}_no"].alias(number), F.col("x")[f"{side}_words"].alias("words")).dropDuplicates(["pair_id", number])


def _rest_blocks(pages: DataFrame, links: DataFrame, window: int) -> DataFrame:
    """Units of the sentences without a link on pages with several windows: every block of one side with every block of the other."""

    def blocks(side: str, number: str) -> DataFrame:
        free = _sentences_of(pages, side, number).join(links.select("pair_id", number).distinct(), ["pair_id", number], "left_anti")
        place = F.row_number().over(Window.partitionBy("pair_id").orderBy(number)) - 1
        grouped = free.withColumn("block", F.floor(place / window)).groupBy("pair_id", "lang", "block").agg(F.sort_array(F.collect_list(F.struct(number, "words"))).alias("rows"))
        pick = lambda value, name: F.transform("rows", value).alias(f"{side}_{name}")
        return grouped.select("pair_id", "lang", F.col("block").alias(f"{side}_block"), pick(lambda x: x[number], "no"), pick(lambda x: x["words"], "words"), pick(lambda x: F.lit(0.0), "at"))

    both = blocks("s", "source_no").join(blocks("t", "translation_no").drop("lang"), "pair_id")
    return both.withColumn("part", F.shiftleft(F.col("s_block").cast("bigint"), 31) + F.col("t_block")).drop("s_block", "t_block")


def _far_moves(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Unlinked sentences of pages with several windows that share code or a long number found once on each side."""
    def marked(side: str, number: str) -> DataFrame:
        free = _sentences_of(pages, side, number).join(links.select("pair_id", number).distinct(), ["pair_id", number], "left_anti")
        marks = F.array_distinct(F.filter("words", lambda w: w.bitwiseAND(F.lit(_KIND).cast("bigint")) >= LONGER_NUMBER))
        rare = free.select("pair_id", number, F.explode(marks).alias("mark")).groupBy("pair_id", "mark").agg(F.count("*").alias("n"), F.min(number).alias(number))
        return rare.where("n = 1").drop("n")

    both = marked("s", "source_no").join(marked("t", "translation_no"), ["pair_id", "mark"])
    return both.select("pair_id", "source_no", "translation_no", F.lit(1.0).alias("similarity")).distinct()


def link_types(links: DataFrame) -> DataFrame:
    """Links with the kind of their group: ``one``, ``merge`` (several source sentences in one), ``split`` (one in several), ``many``."""
    of_s = Window.partitionBy("pair_id", "source_no")
    of_t = Window.partitionBy("pair_id", "translation_no")
    n_t, n_s = F.count("*").over(of_s), F.count("*").over(of_t)
    kind = F.when((n_t == 1) & (n_s == 1), "one").when(n_t == 1, "merge").when(n_s == 1, "split").otherwise("many")
    return links.withColumn("kind", kind)
