"""Pages and their translations: detection, gaps, and drift of structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("zh", "de", "es", "fr", "ja", "ko", "pt", "ru", "it")


def same_language(link: Column) -> Column:
    """A link without what names its language: ``-zh``, ``.zh`` or ``_zh`` before the extension, a language directory."""
    langs = "|".join(("en", *LANGUAGES))
    return F.regexp_replace(F.regexp_replace(link, f"[-._](?:{langs})(?=[.][A-Za-z]+(?:#|$))", ""), f"(^|/)(?:{langs})/", "$1")


def comparable_links(pairs: DataFrame, digests: DataFrame) -> DataFrame:
    """``digests`` with links as both sides of a pair may share them: the switch to the other language and language parts left out."""
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    mates = pairs.select(F.col("source").alias("path"), base(F.col("translation")).alias("m")).unionByName(pairs.select(F.col("translation").alias("path"), base(F.col("source")).alias("m")))
    mates = mates.groupBy("path").agg(F.collect_set("m").alias("mates"))
    known = digests.join(mates, "path", "left").withColumn("mates", F.coalesce("mates", F.array().cast("array<string>")))
    kept = F.filter("links", lambda x: ~F.array_contains("mates", base(F.regexp_replace(x, "#.*$", ""))))
    return known.withColumn("links", F.array_distinct(F.transform(kept, same_language))).drop("mates")


def detect(paths: DataFrame, languages: tuple[str, ...] = LANGUAGES, suffixes: tuple[str, ...] = ("-{lang}", ".{lang}", "_{lang}"), explicit: DataFrame | None = None) -> DataFrame:
    """(source, translation, lang): pairs by file name or language directory; a translation has one source.

    ``explicit``: source, translation, lang of pairs that are given; they win.

    ``paths``: path. Candidates are exploded from the source side and matched by equality; the earlier rule wins.
    """
    known = paths.select("path").where("path is not null").distinct()
    lang = F.explode(F.array(*[F.lit(x) for x in languages])).alias("lang")
    each = known.select(F.col("path").alias("source"), lang)
    stem, ext = F.regexp_replace("source", "[.][^./]*$", ""), F.regexp_extract("source", "([.][^./]*)$", 1)
    rules = [F.struct(F.lit(n).alias("prio"), F.concat(stem, *[F.lit(s.split("{lang}")[0]), F.col("lang"), F.lit(s.split("{lang}")[1])], ext).alias("translation")) for n, s in enumerate(suffixes)]
    english = F.col("source").rlike("(?:^|/)en/")
    rules.append(F.struct(F.lit(len(suffixes)).alias("prio"), F.when(english, F.regexp_replace("source", "(^|/)en/", F.concat(F.lit("$1"), F.col("lang"), F.lit("/")))).alias("translation")))
    wanted = each.select("source", "lang", F.explode(F.array(*rules)).alias("r")).select("source", "lang", "r.*").where("translation is not null and translation <> source")
    hits = wanted.join(known.withColumnRenamed("path", "translation"), "translation")
    if explicit is not None:
        given = explicit.select("translation", "source", "lang", F.lit(-1).alias("prio"))
        hits = hits.select("translation", "source", "lang", "prio").unionByName(given.join(known.withColumnRenamed("path", "translation"), "translation", "left_semi"))
    first = F.row_number().over(Window.partitionBy("translation").orderBy("prio", "source"))
    return hits.withColumn("n", first).where("n = 1").select("source", "translation", "lang")


def gaps(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rule, path, counterpart): pages of a translated tree without a translation (``pair-missing``) or without a source (``pair-orphan``).

    A tree is a directory and a language with at least one pair.
    """
    trees = pairs.where(F.col("source").rlike("(?:^|/)en/")).select(F.regexp_extract("source", "^(.*?)(?:^|/)?en/", 1).alias("prefix"), "lang").distinct()
    pages = paths.select("path").distinct()
    where = F.concat(F.when(F.col("prefix") == "", F.lit("")).otherwise(F.concat(F.col("prefix"), F.lit("/"))))
    joined = pages.join(trees, F.startswith(F.col("path"), F.concat(where, F.lit("en/"))) | F.startswith(F.col("path"), F.concat(where, F.col("lang"), F.lit("/"))))
    is_source = F.startswith(F.col("path"), F.concat(where, F.lit("en/")))
    rest = F.regexp_replace(F.expr("substring(path, length(prefix) + 1)"), "^/?[a-z]+/", "")
    named = joined.select(
        F.when(is_source, "pair-missing").otherwise("pair-orphan").alias("rule"), "path", F.concat(where, F.when(is_source, F.col("lang")).otherwise(F.lit("en")), F.lit("/"), rest).alias("counterpart")
    )
    return named.join(pages.withColumnRenamed("path", "counterpart"), "counterpart", "left_anti").select("rule", "path", "counterpart").distinct()


def first_mismatch(pairs: DataFrame, digests: DataFrame, part: str, rule: str, every: bool = False) -> DataFrame:
    """(source, translation, rule, at, was, found): ordered parts compared place by place.

    A differing count is one finding at ``count``; otherwise the first place that differs (all of them with ``every``).
    """
    s = digests.select(F.col("path").alias("source"), F.col(part).alias("a"))
    t = digests.select(F.col("path").alias("translation"), F.col(part).alias("b"))
    both = pairs.select("source", "translation").join(s, "source").join(t, "translation")
    counts = both.where("size(a) <> size(b)").select("source", "translation", F.lit(rule).alias("rule"), F.lit("count").alias("at"), F.size("a").cast("string").alias("was"), F.size("b").cast("string").alias("found"))
    zipped = both.where("size(a) = size(b)").select("source", "translation", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "x")).where("x.a <> x.b")
    if not every:
        zipped = zipped.withColumn("n", F.row_number().over(Window.partitionBy("source", "translation").orderBy("pos"))).where("n = 1")
    places = zipped.select("source", "translation", F.lit(rule).alias("rule"), F.concat(F.lit("#"), F.col("pos") + 1).alias("at"), F.col("x.a").cast("string").alias("was"), F.col("x.b").cast("string").alias("found"))
    return counts.unionByName(places)


def set_differences(pairs: DataFrame, digests: DataFrame, part: str, rule: str, key: Column | None = None, most: int | None = 10) -> DataFrame:
    """(source, translation, rule, side, missing): what only one side has, at most ``most`` listed (all without it)."""
    s = digests.select(F.col("path").alias("source"), F.col(part).alias("a"))
    t = digests.select(F.col("path").alias("translation"), F.col(part).alias("b"))
    both = pairs.select("source", "translation").join(s, "source").join(t, "translation")
    sides = F.explode(
        F.array(
            F.struct(F.lit("source").alias("side"), F.array_sort(F.array_except("a", "b")).alias("missing")),
            F.struct(F.lit("translation").alias("side"), F.array_sort(F.array_except("b", "a")).alias("missing")),
        )
    ).alias("d")
    return both.select("source", "translation", sides).select("source", "translation", F.lit(rule).alias("rule"), "d.side", (F.col("d.missing") if most is None else F.slice("d.missing", 1, most)).alias("missing")).where("size(missing) > 0")


def lag(pairs: DataFrame, commits: DataFrame, most: int = 5) -> DataFrame:
    """(source, translation, n_newer, subjects): commits of a source after its translation's last one.

    ``commits``: file, hash, ts, subject. The last time per file is a partial aggregation; only later commits are kept.
    """
    last = commits.groupBy(F.col("file").alias("translation")).agg(F.max("ts").alias("last_ts"))
    newer = (
        pairs.select("source", "translation").join(last, "translation")
        .join(commits.select(F.col("file").alias("source"), "hash", "ts", "subject"), "source").where("ts > last_ts")
    )
    by_time = F.sort_array(F.collect_set(F.struct("ts", "hash", "subject")), asc=False)
    grouped = newer.groupBy("source", "translation").agg(F.count_distinct("hash").alias("n_newer"), by_time.alias("l"))
    return grouped.select("source", "translation", "n_newer", F.transform(F.slice("l", 1, most), lambda x: x["subject"]).alias("subjects"))


def compare(pairs: DataFrame, digests: DataFrame) -> DataFrame:
    """(rule, path, detail): all structural findings, on the translation, in the order of the rules."""
    ordered = [
        first_mismatch(pairs, digests, "levels", "pair-heading").select("rule", F.col("translation").alias("path"), F.concat_ws(" ", "at", "was", "found").alias("detail")),
        first_mismatch(pairs, digests, "codes", "pair-code", every=True).select("rule", F.col("translation").alias("path"), F.concat_ws(" ", "at", "was", "found").alias("detail")),
        set_differences(pairs, comparable_links(pairs, digests), "links", "pair-link", most=None).select("rule", F.col("translation").alias("path"), F.concat_ws(" ", "side", F.array_join("missing", ",")).alias("detail")),
        first_mismatch(pairs, digests, "tables", "pair-table").select("rule", F.col("translation").alias("path"), F.concat_ws(" ", "at", "was", "found").alias("detail")),
        set_differences(pairs, digests, "numbers", "pair-number", most=None).select("rule", F.col("translation").alias("path"), F.concat_ws(" ", "side", F.array_join("missing", ",")).alias("detail")),
    ]
    out = ordered[0]
    for more in ordered[1:]:
        out = out.unionByName(more)
    return out
