"""Claims against facts: one join plan per kind, misses as findings.

``dims`` is a dict of fact tables: ``files`` (rel, is_dir), ``symbol_keys`` (key, full), ``facts`` (see
:mod:`claimlake.sources.facts`), ``anchors`` (path, slug), ``config_keys`` (key), and if known ``renames`` (old, new),
``external`` (path, name) and ``probed`` (url, status). ``project`` is the dict of
:func:`claimlake.sources.repo.project`. Every resolver gives (claim columns, status, rule, message, suggestion)
with status ok, missing or skipped; a kind whose facts the repository does not have at all is skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions import text as T
from claimlake.operators import similar as S

VERDICT = ("path", "line", "col", "kind", "text", "norm", "confidence", "status", "rule", "message", "suggestion", "level")


def _verdicts(df: DataFrame, ok: Column, rule: str, message: str, suggestion: Column | None = None, skipped: Column | None = None, level: Column | None = None) -> DataFrame:
    """Verdict rows; ``level`` is a severity of its own, null for the rule's usual one."""
    hit = F.coalesce(ok, F.lit(False))
    status = F.when(hit, "ok") if skipped is None else F.when(hit, "ok").when(F.coalesce(skipped, F.lit(False)), "skipped")
    return df.select(
        "path", "line", "col", "kind", "text", "norm", "confidence", status.otherwise("missing").alias("status"), F.lit(rule).alias("rule"),
        F.format_string(message, F.col("text")).alias("message"), (suggestion if suggestion is not None else F.lit(None).cast("string")).alias("suggestion"),
        (level if level is not None else F.lit(None).cast("string")).alias("level"),
    )


def _one_each(guess: DataFrame) -> DataFrame:
    """(norm, candidate) by norm, so that a plan which doesn't read the suggestions needs no join with them."""
    return guess.groupBy("norm").agg(F.min("candidate").alias("candidate"))


def _globs(claims: DataFrame, files: DataFrame) -> DataFrame:
    """(path, norm): claimed patterns that some file matches, seen from the root or the document's directory.

    The directories before the first wild part are an equal key; only what lies below them is matched.
    """
    asked = claims.where(F.col("norm").rlike("[*?]")).select("path", "norm").distinct()
    tried = asked.select("path", "norm", F.explode(F.array_distinct(F.array("norm", T.clean_path(F.concat_ws("/", F.nullif(T.dir_name("path"), F.lit(".")), "norm"))))).alias("glob"))
    tried = tried.withColumn("top", F.regexp_replace(F.regexp_extract("glob", "^([^*?]*)", 1), "/?[^/]*$", ""))
    tops = tried.select("top").distinct()
    below = files.select("rel", F.explode(F.transform(T.ancestors("rel"), lambda d: F.when(d == ".", F.lit("")).otherwise(d))).alias("top")).join(tops, "top")
    return tried.join(below.hint("merge"), "top").where(F.regexp(F.col("rel"), T.glob_pattern("glob"))).select("path", "norm").distinct()


def paths(claims: DataFrame, files: DataFrame, renames: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Document directory, root and every ancestor are tried in order; patterns match any file; a renamed file is suggested first.

    ``renames``: old, new, chains already followed. ``excluded``: rel, what exists but is not looked into; claims of it are skipped.
    """
    mine = claims.where("kind in ('path', 'command')")
    known = files.select("rel").distinct()
    bases = F.concat(F.array(F.lit("")), F.transform(T.ancestors("path"), lambda d: F.when(d == ".", F.lit("")).otherwise(d)))
    tried = F.array_distinct(F.transform(bases, lambda b: T.clean_path(F.concat_ws("/", b, "norm"))))
    candidates = mine.select("path", "norm", F.explode(tried).alias("rel")).distinct()
    hits = candidates.join(known.hint("merge"), "rel", "left_semi").select("path", "norm").unionByName(_globs(mine, files)).distinct().withColumn("hit", F.lit(True))
    resolved = mine.join(hits, ["path", "norm"], "left")
    unseen = F.lit(False)
    if excluded is not None:
        beyond = candidates.join(excluded.select("rel").distinct(), "rel", "left_semi").select("path", "norm").distinct().withColumn("beyond", F.lit(True))
        resolved, unseen = resolved.join(beyond, ["path", "norm"], "left"), F.col("beyond")
    misses = resolved.where("hit is null").select(F.col("norm").alias("miss")).distinct()
    guess = S.similar_paths(misses, files.where("not is_dir"), "miss", "rel", n=1).select(F.col("path").alias("norm"), "candidate")
    if renames is not None:
        moved = renames.join(known.withColumnRenamed("rel", "new"), "new", "left_semi").select(F.col("old").alias("norm"), F.col("new").alias("candidate"))
        guess = moved.unionByName(guess.join(moved.select("norm"), "norm", "left_anti"))
    rule = F.when(F.col("kind") == "command", "missing-command").otherwise("missing-path")
    return _verdicts(resolved.join(_one_each(guess), "norm", "left"), F.col("hit"), "missing-path", "%s does not exist", F.col("candidate"), unseen).withColumn("rule", rule)


def symbols(claims: DataFrame, keys: DataFrame, literals: DataFrame, config_keys: DataFrame, external: DataFrame | None = None, opaque: DataFrame | None = None) -> DataFrame:
    """Symbol keys, then literals and configuration keys; names under an unknown namespace are external.

    So are names that the document's own examples import from elsewhere (``external``: path, name), and members
    of types whose members cannot be listed (``opaque``: name).
    """
    mine = claims.where("kind = 'symbol'")
    known = keys.select(F.col("key").alias("norm")).distinct().unionByName(literals.select(F.col("name").alias("norm"))).unionByName(config_keys.select(F.col("key").alias("norm"))).distinct().withColumn("hit", F.lit(True))
    heads = keys.select(F.regexp_extract("full", "^([A-Za-z_]\\w*)", 1).alias("head")).unionByName(keys.select(F.regexp_extract("key", "^([A-Za-z_]\\w*)", 1).alias("head"))).distinct().withColumn("own", F.lit(True))
    joined = mine.join(known, "norm", "left").withColumn("head", F.regexp_extract("norm", "^([A-Za-z_]\\w*)", 1)).join(heads, "head", "left")
    foreign = F.col("own").isNull() & F.col("norm").rlike("[.:]")
    if external is not None:
        joined = joined.join(external.select("path", F.col("name").alias("head"), F.lit(True).alias("ext")).distinct(), ["path", "head"], "left")
        foreign = foreign | F.col("ext")
    if opaque is not None:
        owner = F.regexp_extract(F.regexp_replace("norm", "\\(.*$", ""), "([A-Za-z_]\\w*)(?:[.]|::)[A-Za-z_]\\w*$", 1)
        joined = joined.withColumn("owner", owner).join(opaque.select(F.col("name").alias("owner"), F.lit(True).alias("hidden")).distinct(), "owner", "left")
        foreign = foreign | F.col("hidden")
    misses = joined.where("hit is null and own").where(~F.coalesce(foreign, F.lit(False))).select(F.col("norm").alias("name"))
    guess = S.similar_symbols(misses, keys.select(F.col("key").alias("full_name"), "exported"), n=1).select(F.col("name").alias("norm"), "candidate")
    return _verdicts(joined.join(guess, "norm", "left"), F.col("hit"), "missing-symbol", "%s is not declared anywhere", F.col("candidate"), foreign)


def _by_name(claims: DataFrame, kind: str, names: DataFrame, literals: DataFrame, rule: str, message: str, key: Column | None = None) -> DataFrame:
    mine = claims.where(F.col("kind") == kind)
    declared = names.select((key if key is not None else F.col("name")).alias("norm")).where("norm <> ''").distinct()
    said = literals.select(F.regexp_replace("name", "^-+", "").alias("norm")).distinct()
    known = declared.unionByName(said).distinct().withColumn("hit", F.lit(True))
    some = declared.limit(1).select(F.lit(True).alias("some"))
    joined = mine.join(known, "norm", "left").join(F.broadcast(some), how="left")  # one row at most
    misses = joined.where("hit is null and some").select("norm")
    guess = S.ranked(misses, declared, "norm", "norm", n=1, limit=S.narrow_limit(F.col("query"))).select(F.col("query").alias("norm"), "candidate")
    return _verdicts(joined.join(guess, "norm", "left"), F.col("hit"), rule, message, F.col("candidate"), F.col("some").isNull())


def flags(claims: DataFrame, facts: DataFrame) -> DataFrame:
    return _by_name(claims, "flag", facts.where("kind = 'flag'"), facts.where("kind = 'literal'"), "unknown-flag", "flag %s is not defined", T.flag_key("name"))


#: Prefixes of environment names that systems and runners own (fixed values).
EXTERNAL_ENV = "^(?:PATH|HOME|USER|SHELL|LANG|LC_|TZ|TMP|PWD|TERM|NO_COLOR|CI|GITHUB_|GITLAB_|AWS_|GOOGLE_|AZURE_|DOCKER_|KUBE|GO|CGO_|PYTHON|PIP_|NODE_|NPM_|CARGO_|RUST|JAVA_|LD_|XDG_|SSH_|HTTP_PROXY|HTTPS_PROXY)"


def envs(claims: DataFrame, facts: DataFrame) -> DataFrame:
    out = _by_name(claims, "env", facts.where("kind = 'env'"), facts.where("kind in ('literal', 'const', 'macro')"), "unknown-env", "environment variable %s is not read")
    return out.withColumn("status", F.when((F.col("status") == "missing") & F.col("norm").rlike(EXTERNAL_ENV), "skipped").otherwise(F.col("status")))


def config_keys(claims: DataFrame, keys: DataFrame, literals: DataFrame) -> DataFrame:
    """Keys of examples among sample and tag keys and literals, without case and list positions."""
    plain = lambda c: F.lower(F.regexp_replace(c, "\\[[0-9]+\\]", ""))
    mine = claims.where("kind = 'config'").withColumn("plain", plain(F.col("norm")))
    known = keys.select(plain(F.col("key")).alias("plain")).unionByName(literals.select(plain(F.col("name")).alias("plain"))).distinct().withColumn("hit", F.lit(True))
    joined = mine.join(known.hint("merge"), "plain", "left")
    guess = S.ranked(joined.where("hit is null"), keys, "norm", "key", n=1).select(F.col("query").alias("norm"), "candidate")
    return _verdicts(joined.join(_one_each(guess), "norm", "left"), F.col("hit"), "unknown-config-key", "configuration key %s is not known", F.col("candidate"))


def anchors(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Slugs with ``-`` and ``_`` alike; a page that is not a document is skipped."""
    mine = claims.where("kind = 'anchor'").withColumns({"page": F.substring_index("norm", "#", 1), "slug": F.lower(F.substring_index("norm", "#", -1))})
    loose = lambda c: F.translate(F.lower(c), "_", "-")
    slugs = known.select(F.col("path").alias("page"), loose(F.col("slug")).alias("key")).distinct().withColumn("hit", F.lit(True))
    pages = known.select(F.col("path").alias("page")).distinct().withColumn("doc", F.lit(True))
    labels = known.where("slug is not null").select(loose(F.col("slug")).alias("key")).distinct().withColumn("label", F.lit(True))
    joined = mine.withColumn("key", loose(F.col("slug"))).join(slugs, ["page", "key"], "left").join(pages, "page", "left")
    joined = joined.join(labels, "key", "left").withColumn("ok", F.col("hit") | (F.col("label") & F.col("path").rlike("[.](?:rst|adoc)$")))
    pool = known.where("slug is not null").select(F.concat_ws("#", "path", F.lower("slug")).alias("anchor"))
    here = lambda c: F.substring_index(c, "#", 1)
    guess = S.ranked(joined.where("ok is null and doc").select(F.concat_ws("#", "page", "slug").alias("asked")), pool, "asked", "anchor", n=5, limit=F.lit(2)).where(here(F.col("query")) == here(F.col("candidate")))
    guess = guess.groupBy(F.col("query").alias("asked")).agg(F.min_by("candidate", "rank").alias("candidate"))
    joined = joined.withColumn("asked", F.concat_ws("#", "page", "slug")).join(guess, "asked", "left")
    return _verdicts(joined, F.col("ok"), "broken-anchor", "anchor %s does not exist", F.concat(F.lit("#"), F.substring_index("candidate", "#", -1)), F.col("doc").isNull())


def _mask(segments: Column) -> Column:
    """One letter per segment: 1 for a parameter, 0 for a word."""
    return F.array_join(F.transform(segments, lambda s: F.when(s.isin("{}", "**"), "1").otherwise("0")), "")


def match_routes(asked: DataFrame, known: DataFrame, names: bool = False) -> DataFrame:
    """(segs, method, mounted): registered routes that an asked path meets, as it is or (``mounted``) as its tail; with ``names`` their ``reg``.

    ``asked``: segs. ``known``: reg, method. A path and a route meet where the words that are words on both sides are
    equal: the two places of parameters make a shape, each pair of shapes one equal key. Only shapes, never
    routes, are compared with each other.
    """
    plain = lambda c: F.filter(c, lambda s: s != "{$}")
    stop = F.array_position("reg", "**")
    # A route that ends with the exact-match mark is no tail of another path.
    ends = F.coalesce(F.get("reg", F.size("reg") - 1) == "{$}", F.lit(False))
    r = known.select(F.col("reg").alias("given"), plain(F.col("reg")).alias("reg"), "method", ends.alias("whole_only")).distinct().withColumn("open", stop > 0).withColumn("reg", F.when(stop > 0, F.slice("reg", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("reg")))
    r = r.withColumn("r_mask", _mask(F.col("reg")))
    c = asked.select("segs").distinct().withColumn("whole", plain(F.col("segs")))
    c = c.select("segs", "whole", F.explode(F.sequence(F.lit(0), F.greatest(F.size("whole") - 1, F.lit(0)))).alias("off"))
    c = c.withColumn("sub", F.slice("whole", F.col("off") + 1, F.greatest(F.size("whole"), F.lit(1)))).withColumn("c_mask", _mask(F.col("sub")))
    shapes = c.select("c_mask", (F.col("off") > 0).alias("tail")).distinct().join(
        r.select("r_mask", "open", "whole_only").distinct(),
        (F.length("c_mask") == F.length("r_mask")) & (~(F.col("open") | F.col("whole_only")) | ~F.col("tail")) | (F.col("open") & ~F.col("tail") & (F.length("c_mask") >= F.length("r_mask"))),
    ).where("length(r_mask) > 0 or not tail")

    def key(segments: str) -> Column:
        free = lambda n: (F.substring("c_mask", n, F.lit(1)) == "1") | (F.substring("r_mask", n, F.lit(1)) == "1")
        places = F.when(F.length("r_mask") > 0, F.sequence(F.lit(1), F.length("r_mask"))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, lambda n: F.when(free(n), "{}").otherwise(F.get(F.col(segments), n - 1))), "/")

    left = c.withColumn("tail", F.col("off") > 0).join(shapes, ["c_mask", "tail"]).withColumn("key", key("sub"))
    right = r.join(shapes.select("c_mask", "r_mask", "open", "whole_only").distinct(), ["r_mask", "open", "whole_only"]).withColumn("key", key("reg"))
    by = ["c_mask", "r_mask", "open", "whole_only", "key"]
    met = left.join(right.select(*by, "method", "given"), by)
    return met.select("segs", "method", F.col("tail").alias("mounted"), *([F.col("given").alias("reg")] if names else [])).distinct()


def routes(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Method and path: a path that is registered for other methods only is missing, and so is one that no route has or ends with."""
    split = lambda c: F.regexp_replace(c, "^[A-Z]+ ", "")
    verb = lambda c: F.nullif(F.regexp_extract(c, "^([A-Z]+) ", 1), F.lit(""))
    mine = claims.where("kind = 'route'").withColumns({"segs": T.route_segments(split(F.col("norm"))), "said": verb(F.col("norm"))})
    served = F.coalesce(verb(F.col("name")), F.nullif(F.regexp_extract("value", "^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$", 1), F.lit("")) if "value" in facts.columns else F.lit(None).cast("string"))
    known = facts.where("kind = 'route'").select(T.route_segments(split(F.col("name"))).alias("reg"), served.alias("method")).distinct()
    met = mine.select("segs", "said").distinct().join(match_routes(mine, known), "segs")
    fits = F.col("said").isNull() | F.col("method").isNull() | (F.col("said") == F.col("method"))
    judged = met.groupBy("segs", "said").agg(
        F.bool_or(~F.col("mounted") & fits).alias("exact"), F.bool_or(F.col("mounted") & fits).alias("tail"),
        F.array_sort(F.collect_set(F.when(~F.col("mounted"), F.col("method")))).alias("others"),
    )
    judged = judged.select("segs", F.coalesce("said", F.lit("")).alias("verb"), (F.col("exact") | (F.col("tail") & (F.size("others") == 0))).alias("hit"), F.array_join("others", ", ").alias("others"))
    some = known.limit(1).select(F.lit(True).alias("some"))
    joined = mine.withColumn("verb", F.coalesce("said", F.lit(""))).join(judged, ["segs", "verb"], "left").join(F.broadcast(some), how="left")
    shown = lambda c: F.concat(F.lit("/"), F.array_join(c, "/"))
    misses = joined.where("hit is null or (not hit and others = '')").where("some").select(shown(F.col("segs")).alias("shown"))
    guess = S.ranked(misses, known.select(shown(F.col("reg")).alias("display")), "shown", "display", n=1, limit=F.greatest(F.lit(2), F.floor(F.length("query") / 5)).cast("int"))
    joined = joined.withColumn("shown", shown(F.col("segs"))).join(guess.select(F.col("query").alias("shown"), "candidate"), "shown", "left")
    out = _verdicts(joined.withColumn("fix", F.when(F.col("others") != "", F.concat_ws(" ", "others", split(F.col("norm")))).otherwise(F.col("candidate"))), F.col("hit"), "missing-route", "route %s is not registered", F.col("fix"), F.col("some").isNull())
    return out


def imports(claims: DataFrame, files: DataFrame, project: dict) -> DataFrame:
    """Go packages under the module, headers by any suffix, relative scripts with their extensions; others are external."""
    mine = claims.where("kind = 'import'").withColumns({"lang": F.substring_index("norm", ":", 1), "name": F.expr("substring(norm, instr(norm, ':') + 1)")})
    module = project.get("module") or "\u0000"
    inside = F.when(F.col("lang") == "go", F.when(F.col("name") == module, F.lit(".")).when(F.startswith(F.col("name"), F.lit(module + "/")), F.expr(f"substring(name, {len(module) + 2})")))
    tails = F.when(F.col("lang") == "c", F.array("name")).when(F.col("name").rlike("^[.]{1,2}/"), F.transform(F.array(*[F.lit(x) for x in ("", ".js", ".ts", ".tsx", ".jsx", ".mjs", "/index.js", "/index.ts")]), lambda x: F.concat(T.join_relative(T.dir_name("path"), "name"), x)))
    own, offered = project.get("names", {}).get("npm") or "\u0000", project.get("exports") or []
    # A part of the own package: what its manifest exports, or a file where it exports nothing by name.
    part = F.when((F.col("lang") == "js") & (F.col("name") == own), F.lit("")).when((F.col("lang") == "js") & F.startswith(F.col("name"), F.lit(own + "/")), F.expr(f"substring(name, {len(own) + 2})"))
    offers = F.lit(False)
    for entry in offered:
        offers = offers | F.concat(F.lit("./"), part).rlike(T.glob_regex(entry.replace("*", "**"))) | (F.lit(entry == ".") & (part == ""))
    named = F.when(part.isNotNull() & F.lit(bool(offered)), F.when(offers, F.array(F.lit("."))).otherwise(F.array(F.lit("\u0000"))))
    named = F.coalesce(named, F.when(part.isNotNull() & (part != ""), F.transform(F.array(*[F.lit(x) for x in ("", ".js", ".ts", ".mjs", "/index.js", "/index.ts")]), lambda x: F.concat(part, x))))
    wanted = F.coalesce(F.when(inside.isNotNull(), F.array(inside)), tails, named, F.array().cast("array<string>"))
    known = files.select("rel", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("rel", "/"))), lambda n: F.array_join(F.slice(F.split("rel", "/"), F.size(F.split("rel", "/")) - n + 1, n), "/"))).alias("tail")).select("tail").distinct()
    asked = mine.withColumn("wanted", wanted)
    hit = asked.select("path", "norm", F.explode("wanted").alias("tail")).join(known.unionByName(known.sparkSession.createDataFrame([(".",)], "tail string")), "tail", "left_semi").select("path", "norm").distinct().withColumn("hit", F.lit(True))
    return _verdicts(asked.join(hit, ["path", "norm"], "left"), F.col("hit"), "missing-import", "import %s does not exist", None, F.size("wanted") == 0)


def project_claims(claims: DataFrame, project: dict, facts: DataFrame) -> DataFrame:
    """Targets, installs, toolchains and defaults against manifests and declared values (one repository's worth: literals in the plan)."""
    spark = claims.sparkSession
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    targets = frame([(f"{t}:{n}", t) for t, names in project["targets"].items() for n in names], "norm string, tool string")
    by_rule = F.lit(False)
    for name in project["targets"].get("make", ()):
        if "%" in name:  # a pattern rule makes every name of its form
            by_rule = by_rule | F.col("norm").rlike("^make:" + T.glob_regex(name.replace("%", "?*"))[1:])
    tools = targets.select(F.col("tool").alias("t")).distinct().withColumn("known", F.lit(True))
    t = claims.where("kind = 'target'").join(targets.select("norm").distinct().withColumn("hit", F.lit(True)), "norm", "left").withColumn("t", F.substring_index("norm", ":", 1)).join(F.broadcast(tools), "t", "left")
    out = _verdicts(t, F.coalesce(F.col("hit"), F.lit(False)) | by_rule, "missing-target", "target of %s is not defined", None, F.col("known").isNull())

    names = frame(list(project["names"].items()), "tool string, own string")
    i = claims.where("kind = 'install'").withColumns({"tool": F.regexp_replace(F.substring_index("norm", ":", 1), "^pip3$", "pip"), "package": F.regexp_replace(F.expr("substring(norm, instr(norm, ':') + 1)"), "@[^/]*$", "")}).join(F.broadcast(names), "tool", "left")
    distance = F.levenshtein("package", "own")
    near = (F.length("own") >= 4) & distance.between(1, 2)
    out = out.unionByName(_verdicts(i, ~F.coalesce(near, F.lit(False)), "install-mismatch", "%s installs another name than this project's", F.col("own")))

    versions = frame(list(project["versions"].items()), "tool string, spec string").withColumn("v", T.version_floor("spec"))
    c = claims.where("kind = 'toolchain'").withColumns({"tool": F.substring_index("norm", ":", 1), "said": T.version_floor(F.substring_index("norm", ":", -1))}).join(F.broadcast(versions), "tool", "left")
    # Less than required misleads a reader; more than required is only worth a note.
    direction = F.when(F.col("said") < F.col("v"), "warning").otherwise("info")
    out = out.unionByName(_verdicts(c, F.col("said") == F.col("v"), "toolchain-mismatch", "%s is not what the manifest requires", F.concat_ws(":", "tool", "spec"), F.col("v").isNull() | F.col("said").isNull(), direction))

    declared = facts.where("kind in ('flag', 'env') and value is not null").select(F.concat_ws(":", "kind", F.when(F.col("kind") == "flag", T.flag_key("name")).otherwise(F.col("name"))).alias("subject"), "value", "file", "line")
    declared = declared.groupBy("subject").agg(F.min_by("value", F.struct("file", "line")).alias("value"))
    d = claims.where("kind = 'default'").withColumns({"subject": F.substring_index("norm", "=", 1), "said": F.substring_index("norm", "=", -1)}).join(declared, "subject", "left")
    return out.unionByName(_verdicts(d, T.same_default("said", "value"), "default-mismatch", "%s states another default than the code", F.col("value"), F.col("value").isNull()))


def urls(claims: DataFrame, probed: DataFrame | None = None) -> DataFrame:
    """Web links against the answers of a probe (url, status); without one, or for addresses that were not asked, they are skipped."""
    mine = claims.where("kind = 'url'")
    if probed is None:
        return _verdicts(mine, F.lit(False), "broken-url", "%s was not probed", None, F.lit(True))
    joined = mine.join(probed.select(F.col("url").alias("norm"), F.col("status").alias("answer")), "norm", "left")
    fine = F.col("answer").between(1, 399)
    return _verdicts(joined, fine, "broken-url", "%s does not answer", None, F.col("answer").isNull(), F.lit("warning"))


def resolve(claims: DataFrame, dims: dict[str, DataFrame], project: dict, min_confidence: int = 1) -> DataFrame:
    """Verdicts of all claims at or above ``min_confidence``."""
    c = claims.where(F.col("confidence") >= min_confidence)
    facts = dims["facts"]
    literals = facts.where("kind = 'literal'")
    parts = [
        paths(c, dims["files"], dims.get("renames"), dims.get("excluded")), symbols(c, dims["symbol_keys"], literals, dims["config_keys"], dims.get("external"), facts.where("kind = 'opaque'")), flags(c, facts), envs(c, facts), config_keys(c, dims["config_keys"], literals), anchors(c, dims["anchors"]), routes(c, facts), imports(c, dims["files"], project), project_claims(c, project, facts),
        urls(c, dims.get("probed")),
    ]
    return reduce(DataFrame.unionByName, parts)


def findings(verdicts: DataFrame) -> DataFrame:
    """Missing claims as findings: severity by confidence with the rules' own levels, position-free fingerprint."""
    severity = F.when(F.col("rule").isin("unknown-flag", "unknown-env", "unknown-config-key"), F.when(F.col("confidence") >= 3, "warning").otherwise("info")).when(F.col("rule").isin("default-mismatch", "install-mismatch", "toolchain-mismatch"), "warning").otherwise(T.severity_of("confidence"))
    return verdicts.where("status = 'missing'").select(
        "rule", F.coalesce("level", severity).alias("severity"), "message", F.col("path").alias("file"), "line", "col", "kind", "text", "norm", "suggestion",
        T.fingerprint("rule", "path", "kind", "norm").alias("fingerprint"), F.lit(False).alias("baselined"),
    )
