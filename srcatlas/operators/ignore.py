"""Ignore rules and tracked paths.

An entry is judged by the rules of all directories above it: the deepest
directory wins, inside one file the last line wins. An entry is left out when
it or any directory above it is judged ignored; a later ``!`` rule cannot bring
back what lies below an ignored directory.

All rules that hold in a directory are a rule set. Sets are told by a hash of what they say, so that
directories and repositories with the same rules share one, and a directory carries the set's hash and the
directory of its deepest rules. A set is compiled once: plain names and endings stand in tables in order of
rank, where the first hit is the one that counts; rules over paths are kept by the first component that they need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import names
from srcatlas.functions.globs import ignore_regex
from srcatlas.functions.text import decoded, lines
from srcatlas.operators.skew import spread_join
from srcatlas.operators.stats import directories

IGNORE_FILES = (".gitignore",)
# Rules of a repository that aren't part of it; they stand at its root.
REPOSITORY_FILES = (".git/info/exclude",)


def read_ignore_rules(
    files: DataFrame, file_names: Sequence[str] = IGNORE_FILES, repository_files: Sequence[str] = REPOSITORY_FILES
) -> DataFrame:
    """Rules of all ignore files, one row per usable line.

    (repo, base_dir, source, line, pattern, negated, dir_only, anchored,
    regex, kind, literal). A later name in ``file_names`` outranks an earlier
    one, whatever the directory; the files at the paths ``repository_files`` hold from the root and are outranked by all.
    Plain names and ``*.ext`` patterns are marked in ``kind`` so that they
    can be tested without a regular expression; unusable patterns are dropped.
    """
    path = F.col("path")
    name = names.base_name(path)
    at_root = path.isin(list(repository_files))
    ordered = [*repository_files, *file_names]
    source = F.array_position(F.array(*[F.lit(n) for n in ordered]), F.when(at_root, path).otherwise(name))
    raw = (
        files.where((name.isin(list(file_names)) | at_root) & F.col("content").isNotNull())
        .select(
            "repo",
            F.when(at_root, F.lit("")).otherwise(names.parent_path(path)).alias("base_dir"),
            source.cast("int").alias("source"),
            F.posexplode(lines(decoded(F.col("content")))).alias("pos", "raw"),
        )
        .withColumn("raw", F.regexp_replace("raw", r"(?<!\\)[ \t]+$", ""))
        .where((F.col("raw") != "") & ~F.startswith("raw", F.lit("#")))
    )
    negated = F.startswith("raw", F.lit("!"))
    positive = F.regexp_replace(F.regexp_replace("raw", r"^!", ""), r"^\\([!#])", "$1")
    bare = F.regexp_replace("body", r"/$", "")
    pattern = F.col("pattern")
    kind = (
        F.when(F.col("anchored"), F.lit("path"))
        .when(pattern.rlike(r"^[^*?\[\\]+$"), F.lit("name"))
        .when(pattern.rlike(r"^\*[^*?\[\\]+$"), F.lit("suffix"))
        .otherwise(F.lit("path"))
    )
    return (
        raw.select(
            "repo",
            "base_dir",
            "source",
            (F.col("pos") + 1).alias("line"),
            negated.alias("negated"),
            positive.alias("body"),
        )
        .withColumn("dir_only", F.endswith("body", F.lit("/")))
        .withColumn("anchored", F.contains(bare, F.lit("/")))
        .withColumn("pattern", F.regexp_replace(bare, r"^/", ""))
        .where(pattern != "")
        .withColumn("kind", kind)
        .withColumn("literal", F.when(F.col("kind") == "suffix", F.substring(pattern, 2, 1 << 30)).otherwise(pattern))
        .withColumn("regex", ignore_regex(pattern, F.col("anchored")))
        .where(F.col("regex").isNotNull())
        .drop("body")
    )


def all_entries(files: DataFrame) -> DataFrame:
    """(repo, path, is_dir): files and every directory."""
    plain = files.where(~F.coalesce(F.col("is_dir"), F.lit(False)))
    return plain.select("repo", "path", F.lit(False).alias("is_dir")).unionByName(
        directories(files).select("repo", "path", F.lit(True).alias("is_dir"))
    )


# The end of a name from its last dot.
_ENDING = r"^\.[^.]+$"


def rule_sets(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, base_dir, set) of every directory with rules of its own, and the compiled sets.

    A set holds the directory's rules and those of all directories above. Compiled it is (set, tables, levels): in ``tables``
    the plain names and endings by falling rank, for files and for directories; in ``levels`` the other rules, for each directory
    that has some, with how far up it lies. Only directories with rules are spelled out into their ancestors.
    """
    rank = (((F.col("source").cast("bigint") * 4096 + 4095 - F.col("up")) * (1 << 32) + F.col("line")) * 2 + (~F.col("negated")).cast("bigint")).alias("rank")
    path = F.col("base_dir")
    scopes = rules.select("repo", "base_dir").distinct()
    spelled = scopes.select(
        "repo", F.col("base_dir").alias("scope"), names.path_depth(path).alias("depth"), F.explode(F.concat(names.ancestors(path), F.array(path))).alias("base_dir")
    ).withColumn("up", F.col("depth") - names.path_depth(path))
    first = F.when(F.col("anchored") & ~F.substring_index("pattern", "/", 1).rlike(r"[*?\[\\]"), F.substring_index("pattern", "/", 1))
    held = F.struct(rank, "up", "kind", "literal", "dir_only", first.alias("first"), "regex")
    by_rank = F.sort_array(F.collect_list(held), asc=False)
    met = spelled.join(rules, ["repo", "base_dir"]).groupBy("repo", "scope").agg(by_rank.alias("rules"))
    told = met.select("repo", F.col("scope").alias("base_dir"), F.unhex(F.sha2(F.to_json("rules"), 256)).alias("set"), "rules")
    content = told.groupBy("set").agg(F.first("rules").alias("rules"))

    def where(test) -> Column:
        return F.filter("rules", test)

    def table(kind: str, dirs: bool, *more) -> list[Column]:
        own = where(lambda r: (r["kind"] == kind) & (F.lit(True) if dirs else ~r["dir_only"]) & (more[0](r["literal"]) if more else F.lit(True)))
        label = f"{'dir' if dirs else 'file'}_{kind}"
        return [own.getField("literal").alias(label), own.getField("rank").alias(f"{label}_rank")]

    def ending(literal: Column) -> Column:
        return literal.rlike(_ENDING)

    tails = where(lambda r: (r["kind"] == "suffix") & ~ending(r["literal"]))
    paths = where(lambda r: r["kind"] == "path")

    def level(up: Column) -> Column:
        own = F.filter(paths, lambda r: r["up"] == up)
        return F.struct(up.alias("up"), F.array_join(own.getField("regex"), "|").alias("gate"), own.alias("rules"))

    tables = [c for dirs in (False, True) for c in (*table("name", dirs), *table("suffix", dirs, ending))]
    compiled = content.select(
        "set", F.struct(*tables, tails.alias("tails")).alias("tables"), F.transform(F.array_distinct(paths.getField("up")), level).alias("levels")
    )
    return told.select("repo", "base_dir", "set"), compiled


def directory_sets(dirs: DataFrame, scopes: DataFrame) -> DataFrame:
    """(repo, path, scope, set, above, above_set): the rules that judge a directory's entries, and those that judge itself.

    Directories without rules are left out. Only directories are spelled out into their ancestors, never files.
    """
    path, depth = F.col("path"), names.path_depth(F.col("base_dir"))
    spelled = dirs.select("repo", "path", F.explode(F.concat(names.ancestors(path), F.array(path))).alias("base_dir"))
    found = F.struct(F.col("base_dir").alias("scope"), "set")
    deepest = F.max_by(found, depth)
    above = F.max_by(F.when(F.col("base_dir") != path, found), F.when(F.col("base_dir") != path, depth))
    return (
        spelled.join(scopes, ["repo", "base_dir"])
        .groupBy("repo", "path")
        .agg(deepest.alias("own"), above.alias("up"))
        .select("repo", "path", "own.scope", "own.set", F.col("up.scope").alias("above"), F.col("up.set").alias("above_set"))
    )


def _is_ignored(path: Column, is_dir: bool, scope: Column) -> Column:
    """Whether the rule of highest rank that hits an entry leaves it out; the set's ``tables`` and ``levels`` stand in the row."""
    name = names.base_name(path)
    kind = "dir" if is_dir else "file"
    tables, levels = F.col("tables"), F.col("levels")

    def looked_up(label: str, key: Column) -> Column:
        at = F.array_position(tables[label], key)
        return F.when(at > 0, F.get(tables[f"{label}_rank"], (at - 1).cast("int")))

    def fits(rule: Column) -> Column:
        return F.lit(True) if is_dir else ~rule["dir_only"]

    def hits(level: Column) -> Column:
        start = F.length(F.call_function("substring_index", path, F.lit("/"), names.path_depth(scope) - level["up"]))
        rel = F.when(start == 0, path).otherwise(F.substring(path, start + 2, F.length(path)))
        head = F.substring_index(rel, "/", 1)

        def found(rule: Column) -> Column:
            return fits(rule) & F.coalesce(rule["first"] == head, F.lit(True)) & F.regexp_like(rel, rule["regex"])

        return F.when(F.regexp_like(rel, level["gate"]), F.get(F.filter(level["rules"], found), F.lit(0))["rank"])

    tail = F.get(F.filter(tables["tails"], lambda r: fits(r) & F.endswith(name, r["literal"])), F.lit(0))["rank"]
    ending = F.concat(F.lit("."), F.substring_index(name, ".", -1))
    by_path = F.array_max(F.transform(levels, hits))
    # A null is passed over unless all are null.
    last = F.greatest(looked_up(f"{kind}_name", name), F.when(F.contains(name, F.lit(".")), looked_up(f"{kind}_suffix", ending)), tail, by_path)
    return F.coalesce(last % 2 == 1, F.lit(False))


def _with_set(rows: DataFrame, sets: DataFrame, key: Column) -> DataFrame:
    """The rows with their compiled set; rows without one are dealt evenly."""
    spare = F.unhex(F.hex(F.xxhash64("repo", "path")))
    return rows.withColumn("set", F.coalesce(key, spare)).join(sets, "set", "left")


def included(files: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of files, directories (repo, path)) that no rule leaves out.

    Verdicts are handed down among directories first; a file then needs one join, on its parent, for
    its rules' hash and for whether that directory is lost, and one with the compiled sets.
    """
    path = F.col("path")
    dirs = directories(files)
    every = dirs.unionByName(files.select("repo").distinct().select("repo", F.lit("").alias("path")))
    scopes, sets = rule_sets(rules)
    ruled = directory_sets(every, scopes)
    judged = _with_set(ruled.where((path != "") & F.col("above_set").isNotNull()).drop("set"), sets, F.col("above_set"))
    ignored = judged.where(_is_ignored(path, True, F.col("above"))).select("repo", path.alias("up"))
    chains = dirs.select("repo", "path", F.explode(F.concat(names.ancestors(path, False), F.array(path))).alias("up"))
    lost = chains.join(ignored, ["repo", "up"]).select("repo", "path").distinct()
    state = ruled.select("repo", "path", "scope", "set").join(lost.withColumn("lost", F.lit(True)), ["repo", "path"], "full")
    plain = files.where(~F.coalesce(F.col("is_dir"), F.lit(False))).withColumn("parent", names.parent_path(path))
    met = spread_join(plain, state.withColumnRenamed("path", "parent"), ["repo", "parent"], ["path"], "left").where(F.col("lost").isNull())
    kept = _with_set(met, sets, F.col("set")).where(~_is_ignored(path, False, F.col("scope")))
    return kept.select(files.columns), dirs.join(lost, ["repo", "path"], "left_anti")


def included_entries(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, path, is_dir) of the entries that no rule leaves out."""
    plain, dirs = included(files, rules)
    return plain.select("repo", "path", F.lit(False).alias("is_dir")).unionByName(
        dirs.select("repo", "path", F.lit(True).alias("is_dir"))
    )


def with_ancestor_dirs(paths: DataFrame) -> DataFrame:
    """(repo, path) of the root and all directories above the given files."""
    path = F.col("path")
    parents = paths.select("repo", names.parent_path(path).alias("path")).distinct()
    up = parents.select("repo", F.explode(names.ancestors(path)).alias("path"))
    return parents.unionByName(up).distinct()


def tracked_paths(index: DataFrame, status: DataFrame) -> DataFrame:
    """Index paths and paths with a status that is neither new nor ignored."""
    changed = status.where(~F.col("is_new") & ~F.col("is_ignored")).select("repo", "path")
    return index.select("repo", "path").unionByName(changed).distinct()


def tracked_files(files: DataFrame, tracked: DataFrame) -> DataFrame:
    return files.join(tracked.select("repo", "path"), ["repo", "path"], "left_semi")


def tracked_dirs(dirs: DataFrame, tracked: DataFrame) -> DataFrame:
    """Directories that hold a tracked file somewhere below."""
    return dirs.join(with_ancestor_dirs(tracked), ["repo", "path"], "left_semi")
