"""States of repositories by content: texts, folders and facts stand once under their hashes, whoever has them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import astfacts, patches
from quarrylens.operators.symbols import module_of
from quarrylens.session import cut

#: The tables of a store, each a folder of Parquet that only grows: texts; entries of folders (a folder's hash is that of its
#: entries); commits, which name the hash of their top folder.
TABLES = {"texts": "hash string, text string", "folders": "folder string, name string, is_dir boolean, hash string", "commits": "episode_id string, step int, parent int, root string, message string"}


def parts(spark: SparkSession, folder: str) -> list[str]:
    """The parts of a table that have been written whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [x.getPath() for x in fs.listStatus(at) if x.isDirectory()]
    return sorted(x.toString() for x in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def append(rows: DataFrame, folder: str) -> None:
    """Adds rows as a part of their own; one that is broken off is never read."""
    rows.write.parquet(f"{folder}/{uuid.uuid4().hex}")


def held(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of a store as it is now; before the first commit it is empty. Its parts are named one by one: Spark takes two reads
    of one folder for the same, though a part came between, and would use the rows of the first for both."""
    paths = parts(spark, f"{store}/{name}")
    return spark.read.schema(TABLES[name]).parquet(*paths) if paths else spark.createDataFrame([], TABLES[name])


def folder_hashes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """episode_id, root; and the entries of all folders (folder, name, is_dir, hash), of files (episode_id, path, hash).

    Level by level from the deepest: a folder's hash is that of the sorted names, kinds and hashes of its entries, so equal
    folders are one, wherever they stand. A file and a folder with one name in one folder are two entries.
    """
    parts = F.split("path", "/")
    level = cut(files.select("episode_id", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("up"), F.element_at(parts, -1).alias("name"), F.lit(False).alias("is_dir"), "hash"))
    depth, entries = level.agg(F.max(F.size("up"))).first()[0] or 0, []
    for d in range(depth, -1, -1):
        here = level.where(F.size("up") == d)
        listed = F.array_sort(F.collect_list(F.struct("name", "is_dir", "hash")))  # the entries of one folder
        each = cut(here.groupBy("episode_id", "up").agg(listed.alias("e")).withColumn("folder", F.sha2(F.to_json("e"), 256)))
        entries.append(each.select("folder", F.inline("e")))
        if d:
            ups = each.select("episode_id", F.slice("up", 1, d - 1).alias("up"), F.element_at("up", -1).alias("name"), F.lit(True).alias("is_dir"), F.col("folder").alias("hash"))
            level = level.where(F.size("up") < d).unionByName(ups)
    return each.select("episode_id", F.col("folder").alias("root")), reduce(DataFrame.unionByName, entries).distinct()


def commit(store: str, files: DataFrame, step: int, message: str | None = None) -> DataFrame:
    """Commits a state (episode_id, path, text) of each episode and gives the commits that were made (episode_id, step, root).

    An episode whose top folder is that of its last commit gets none, and nothing of it is written. Of the rest, texts and
    folders that the store has aren't written again. Commits are written last, so that one that can be seen is whole; a commit that
    was broken off can be made again. A null text counts as empty; an episode has a file once.
    """
    spark = files.sparkSession
    hashed = cut(files.select(F.col("episode_id").cast("string").alias("episode_id"), "path", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.sha2("text", 256)))
    roots, entries = folder_hashes(hashed)
    last = held(spark, store, "commits").groupBy("episode_id").agg(F.max_by(F.struct("root", "step"), "step").alias("last"))
    new = cut(roots.join(last, "episode_id", "left").where("last IS NULL OR last.root <> root"))
    if new.isEmpty():
        return new.select("episode_id", F.lit(step).alias("step"), "root")
    texts = hashed.join(new.select("episode_id"), "episode_id", "left_semi").select("hash", "text").dropDuplicates(["hash"])
    append(texts.join(held(spark, store, "texts").select("hash"), "hash", "left_anti"), f"{store}/texts")
    own = entries.join(_below(new.select(F.col("root").alias("folder")), entries), "folder", "left_semi")
    append(own.join(held(spark, store, "folders").select("folder").distinct(), "folder", "left_anti"), f"{store}/folders")
    made = new.select("episode_id", F.lit(step).cast("int").alias("step"), F.col("last.step").cast("int").alias("parent"), "root", F.lit(message or f"step {step}").alias("message"))
    append(made, f"{store}/commits")
    return made.select("episode_id", "step", "root")


def _below(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """folder: roots and all folders in them."""
    found = frontier = cut(roots.distinct())
    while not frontier.isEmpty():
        inner = entries.where("is_dir").join(frontier, "folder", "left_semi").select(F.col("hash").alias("folder")).distinct()
        frontier = cut(inner.join(found, "folder", "left_anti"))
        found = found.unionByName(frontier)
    return found


def _under(prefix: Column, name: Column) -> Column:
    return F.when(prefix == "", name).otherwise(F.concat(prefix, F.lit("/"), name))


def files_at(spark: SparkSession, store: str, step: int) -> DataFrame:
    """episode_id, path, text of each episode's last commit up to a step."""
    commits = held(spark, store, "commits").where(F.col("step") <= step).groupBy("episode_id").agg(F.max_by("root", "step").alias("folder"))
    frontier, folders, found = cut(commits.select("episode_id", F.lit("").alias("prefix"), "folder")), held(spark, store, "folders"), []
    while not frontier.isEmpty():
        inner = cut(frontier.join(folders, "folder").select("episode_id", _under(F.col("prefix"), F.col("name")).alias("prefix"), "is_dir", "hash"))
        found.append(inner.where("NOT is_dir").select("episode_id", F.col("prefix").alias("path"), "hash"))
        frontier = inner.where("is_dir").select("episode_id", "prefix", F.col("hash").alias("folder"))
    paths = reduce(DataFrame.unionByName, found) if found else commits.select("episode_id", F.lit("").alias("path"), F.lit("").alias("hash")).limit(0)
    return paths.join(held(spark, store, "texts"), "hash").select("episode_id", "path", "text")


def changed_entries(spark: SparkSession, store: str, before: int, after: int, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """episode_id, path, old, new (hashes of files) that differ between each episode's last commits up to two steps; and the folders
    that were opened for it (episode_id, prefix). Both trees are walked together, and only where their hashes differ.

    only: paths or folders beyond which nothing is looked at. A commit that is missing is an empty tree.
    """
    commits, folders = held(spark, store, "commits"), held(spark, store, "folders")
    root = lambda step, name: commits.where(F.col("step") <= step).groupBy("episode_id").agg(F.max_by("root", "step").alias(name))
    frontier = cut(root(before, "old").join(root(after, "new"), "episode_id", "full").where("NOT old <=> new").withColumn("prefix", F.lit("")))
    changed, opened = [], []
    while not frontier.isEmpty():
        opened.append(frontier.select("episode_id", "prefix"))
        side = lambda c: frontier.join(folders, frontier[c] == folders["folder"]).select("episode_id", _under(F.col("prefix"), F.col("name")).alias("path"), "is_dir", F.col("hash").alias(c))
        both = side("old").join(side("new"), ["episode_id", "path", "is_dir"], "full").where("NOT old <=> new")
        if only:
            near = F.lit(False)
            for x in only:
                near |= (F.col("path") == x) | F.col("path").startswith(f"{x}/") | F.lit(x).startswith(F.concat("path", F.lit("/")))
            both = both.where(near)
        both = cut(both)
        changed.append(both.where("NOT is_dir").select("episode_id", "path", "old", "new"))
        frontier = both.where("is_dir").select("episode_id", F.col("path").alias("prefix"), "old", "new")
    none = commits.select("episode_id", F.lit("").alias("path"), F.lit("").alias("old"), F.lit("").alias("new"), F.lit("").alias("prefix")).limit(0)
    files = reduce(DataFrame.unionByName, changed) if changed else none.drop("prefix")
    return files, reduce(DataFrame.unionByName, opened) if opened else none.select("episode_id", "prefix")


def commit_diff(spark: SparkSession, store: str, before: int, after: int, only: list[str] | None = None) -> DataFrame:
    """episode_id, path, change (added, removed, edited), added, removed (lines: what --stat counts), diff (hunks); see changed_entries."""
    files, texts = changed_entries(spark, store, before, after, only)[0], held(spark, store, "texts")
    text = lambda name, value: texts.select(F.col("hash").alias(name), F.col("text").alias(value))
    both = files.join(text("old", "old_text"), "old", "left").join(text("new", "new_text"), "new", "left")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("edited")
    return both.withColumn("l", patches.line_changes("old_text", "new_text")).select("episode_id", "path", change.alias("change"), "l.added", "l.removed", "l.diff")


def known_nodes(files: DataFrame, store: str) -> DataFrame:
    """The node table of files (path, text), of which only texts that store has not seen are parsed.

    store is a folder in which facts stand under the sha256 of their text, without a path. Texts that are new, each once, are
    parsed and written there first; then all facts are read from it and get the paths of their files. An empty file and one
    whose text is null are the same text.
    """
    spark = files.sparkSession
    own = files.select(F.col("path").cast("string").alias("at"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("hash", F.sha2("text", 256))
    new = own.select(F.col("hash").alias("path"), "text").dropDuplicates(["path"])
    if have := parts(spark, store):
        new = new.join(spark.read.schema("path string").parquet(*have).distinct(), "path", "left_anti")
    append(astfacts.ast_nodes(new), store)
    facts = spark.read.schema(astfacts.SCHEMA).parquet(*parts(spark, store)).withColumnRenamed("path", "hash")
    named = facts.join(own.select("at", "hash"), "hash")
    named = named.withColumns({c: F.concat(module_of(F.col("at")), F.substring(c, 65, 1 << 30)) for c in ("scope", "caller")})  # behind the 64 digits
    return named.withColumnRenamed("at", "path").select(*astfacts.COLUMNS)
