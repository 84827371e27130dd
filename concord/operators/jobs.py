"""Grouping of text items by header signature, item selection, and flattening
(I1-I3), re-aimed from job files to any text table."""

from __future__ import annotations

import os
import re
import unicodedata
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import ranked, stored


def lines(text: Column) -> Column:
    return F.split(text, "\n")


IGNORED_KEYS = ("--job-name", "--output")


def header_options(text: Column, marker: str = "#SBATCH", ignored: tuple = IGNORED_KEYS) -> Column:
    """The (key, value) options of all header lines, in order; lines that name
    an ignored key do not count."""
    def counts(line):
        c = line.startswith(marker)
        for k in ignored:
            c = c & ~line.contains(k)
        return c
    return F.transform(F.filter(lines(text), counts), lambda line: F.struct(
        F.regexp_replace(line, "^.*?--(.*?)=.*$", "$1").alias("key"), F.regexp_replace(line, "^.*--.*=(.*)$", "$1").alias("value")))


def header_signature(text: Column, marker: str = "#SBATCH", ignored: tuple = IGNORED_KEYS) -> Column:
    """The options as one string: items with equal ones can share a batch."""
    return F.array_join(F.transform(header_options(text, marker, ignored), lambda o: F.concat(o["key"], F.lit("="), o["value"])), "\n")


def header_groups(df: DataFrame, key: str, signature: Column) -> DataFrame:
    """(signature, key) rows with the group's size; members stay rows, so a
    group may have any number of them."""
    rows = df.select(key, signature.alias("signature"))
    sizes = rows.groupBy("signature").agg(F.count("*").alias("n_items"))
    return rows.join(sizes, "signature")


def glob_pattern(glob: str) -> str:
    """A file glob as a regular expression: ** any folders, * and ? within one, [..] classes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]-" or c.isalnum() else "\\" + c
        i += 1
    return "^" + out + "$"


def select_items(df: DataFrame, path_col: str, globs: list | None = None, suffix: str | None = None, regex: str | None = None) -> DataFrame:
    """Items whose path matches any of the globs, has the suffix and matches
    the regex from the start; an item that several globs match comes once per
    glob, all in path order."""
    c = F.lit(True)
    if suffix:
        c = c & F.col(path_col).endswith(suffix)
    if regex:
        c = c & F.col(path_col).rlike("^(?:" + regex + ")")
    out = df.filter(c)
    if globs:
        hits = F.array_compact(F.array(*[F.when(F.col(path_col).rlike(glob_pattern(g)), F.lit(k)) for k, g in enumerate(globs)]))
        out = out.withColumn("glob", F.explode(hits))
    return out.orderBy(path_col)


def _tasks(spark: SparkSession) -> int:
    """Tasks for work that counts by file, not by byte."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _qualified(spark: SparkSession, path: str):
    """The store that ``path`` lies in and the path with the store's name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, store.makeQualified(at)


def folder_name(name: str, value: str | None) -> str:
    """``name=value`` as Spark names the folders of partitioned tables."""
    value = "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or c < " " else c for c in value or "")
    return f"{name}={value or '__HIVE_DEFAULT_PARTITION__'}"


def _write_files(rows, base: str, folders: list) -> None:
    """One task's rows, sorted by folder, as files: each is put in place when it is whole, so a second attempt replaces it."""
    name = f"part-{TaskContext.get().partitionId():05d}.txt"
    for values, some in groupby(rows, lambda r: tuple(r)[:-1]):
        folder = os.path.join(base, *map(folder_name, folders, values))
        os.makedirs(folder, exist_ok=True)
        part = os.path.join(folder, f".{name}-{TaskContext.get().taskAttemptId()}")
        with open(part, "w", encoding="utf-8", newline="") as out:
            out.writelines((r[-1] or "") + "\n" for r in some)
        os.replace(part, os.path.join(folder, name))


def write_items(df: DataFrame, path: str, folders: list, text: str) -> None:
    """One text file per row, in a folder for each value of ``folders``.

    Rows are dealt by folder, so all tasks have as many files to write; rows of one folder share a file.
    In a folder that all machines share as a file system (``file:``) the tasks write files themselves:
    Spark's writer starts a process for the permissions of every file and folder there, some 20 ms a file."""
    spark = df.sparkSession
    named = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in folders]       # both have one folder
    dealt = df.select(*named, text).repartition(_tasks(spark), *folders)
    store, at = _qualified(spark, path)
    if store.getScheme() != "file":
        dealt.write.mode("overwrite").partitionBy(*folders).text(path)
        return
    dealt.where("false").write.mode("overwrite").partitionBy(*folders).text(path)
    base = at.toUri().getPath()
    dealt.sortWithinPartitions(*folders).foreachPartition(lambda rows: _write_files(rows, base, folders))


def file_glob(glob: str) -> str:
    """A glob of Hadoop's as a regular expression for a file, or for any file below a folder that it
    names: * and ? within one folder, [..] and [^..] classes, {..,..} alternatives, \\ before a literal."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1:end]
            out += ("[^/" if body[0] in "!^" else "[") + "".join("\\" + x if x in "[\\&^" else x for x in body[body[0] in "!^":]) + "]"
            i = end
        elif c in "{}":
            out, depth = out + ("(?:" if c == "{" else ")"), depth + (1 if c == "{" else -1)
        elif c == "," and depth:
            out += "|"
        elif c in "*?":
            out += "[^/]*" if c == "*" else "[^/]"
        else:
            if c == "\\":
                i, c = i + 1, glob[i + 1]
            out += c if c.isalnum() or c == "/" else "\\" + c
        i += 1
    return out + "(?:/.*)?$"


def _rooted(spark: SparkSession, glob: str) -> tuple[str, str]:
    """The folder above the first part of ``glob`` that holds a pattern, and the files' expression; both with the store's name."""
    parts = glob.split("/")
    k = next((k for k, x in enumerate(parts) if any(c in "{}[]*?\\" for c in x)), len(parts))
    root = _qualified(spark, "/".join(parts[:k]) or ("/" if glob.startswith("/") else "."))[1].toString()
    store, below = re.fullmatch(r"([^/]*:(?://[^/]*)?)?(.*)", root.rstrip("/")).groups()
    literal = "".join(c if c.isalnum() or c == "/" else "\\" + c for c in below)
    rest = file_glob("/" + "/".join(parts[k:])) if k < len(parts) else "(?:/.*)?$"
    return root, "^" + re.escape(store or "") + "(?://)?" + literal + rest


def _hidden(name: str) -> bool:
    """Files and folders that Spark's listing leaves out."""
    return (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))
            or name.startswith(".") or name.endswith("._COPYING_"))


def _escaped(path: str) -> str:
    """A local path as the URI that Spark's ``_metadata.file_path`` has for it."""
    def one(c):
        plain = c.isalnum() or c in "_-!.~'()*:@&=+$,;/" if c < "\x80" else c > "\x9f" and unicodedata.category(c)[0] != "Z"
        return c if plain else "".join(f"%{x:02X}" for x in c.encode())
    return "file:" + "".join(map(one, path))


def _in_batches(rows, names: list, types: list, most: int = 10_000):
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), types)], names)


FOUND = "at string, folder boolean"


def _list_folders(batches):
    """What lies in the folders ``at``; a file is its own and only entry.  Empty files hold no item."""
    def entries(at):
        if not os.path.isdir(at):
            return [(os.path.basename(at), at, False, os.path.getsize(at))]
        with os.scandir(at) as found:
            return [(e.name, e.path, e.is_dir(), 0 if e.is_dir() else e.stat().st_size) for e in found if e.is_dir() or os.path.exists(e.path)]
    rows = ((at, folder) for batch in batches for top in batch["at"].to_pylist() for name, at, folder, size in entries(top)
            if not _hidden(name) and (folder or size and not (name.startswith("_") and "=" not in name)))
    yield from _in_batches(rows, ["at", "folder"], [pa.string(), pa.bool_()])


def _read_files(batches):
    """(path, content) of the files ``at``, a few MB at a time."""
    path, content, size = [], [], 0
    for batch in batches:
        for uri, at in zip(batch["path"].to_pylist(), batch["at"].to_pylist()):
            with open(at, "rb") as f:
                path.append(uri)
                content.append(f.read())
            size += len(content[-1])
            if size > 4 << 20 or len(path) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(content, pa.binary())], ["path", "content"])
                path, content, size = [], [], 0
    if path:
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(content, pa.binary())], ["path", "content"])


def _packed(spark: SparkSession) -> tuple:
    """Ends of the names of files that Spark's readers unpack."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop
    return tuple(jvm.util.ReflectionUtils.newInstance(c, conf).getDefaultExtension() for c in jvm.io.compress.CompressionCodecFactory.getCodecClasses(conf))


def _escape_globs(path: str) -> str:
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


SPARKS_FILES = 10_000              # files of one scan of Spark's, whose list the driver holds


def _shared_files(spark: SparkSession, roots: list, chosen) -> DataFrame:
    """(path, text) of the files below ``roots``, folders that all machines share, of which ``chosen`` keeps the paths.

    Folders are listed by tasks, level by level, and files are read by tasks: the driver
    holds no list of files.  Packed files are left to Spark's reader, some at a time."""
    n, at = _tasks(spark), [_qualified(spark, r)[1].toUri().getPath() for r in roots]
    folders, levels = spark.createDataFrame([(x,) for x in at], "at string"), []
    while folders is not None:
        found = stored(folders.repartition(n).mapInArrow(_list_folders, FOUND), "items-listed")
        levels.append(found.where("not folder").select("at"))
        folders = found.where("folder").select("at")
        folders = folders if folders.head(1) else None
    uri = F.arrow_udf(lambda x: pa.array(map(_escaped, x.to_pylist()), pa.string()), "string")
    files = stored(chosen(reduce(DataFrame.union, levels).select("at", uri("at").alias("path"))), "items-chosen")
    packed = reduce(lambda c, x: c | F.col("path").endswith(x), _packed(spark), F.lit(False))
    read = files.where(~packed).repartition(n).mapInArrow(_read_files, "path string, content binary")
    parts = [stored(read.select("path", F.col("content").cast("string").alias("text")), "items-read")]
    rows = files.where(packed).toLocalIterator()
    while some := [_escape_globs(r["at"]) for r in islice(rows, SPARKS_FILES)]:
        own = spark.read.text(some, wholetext=True)
        parts.append(stored(own.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), "items-unpacked"))
    return reduce(DataFrame.union, parts)


def read_items(spark: SparkSession, globs: list, suffix: str | None = None, regex: str | None = None) -> DataFrame:
    """(place, path, text) of the files that any of the globs names, each once,
    in path order; optionally only paths with a suffix, or that a regex matches from the start.

    Files are read whole, one row each; globs may overlap. What lies below the globs' plain
    beginnings is listed once, by tasks, and the globs are then matched with the paths, so
    a glob may name no file (its plain beginning must exist); as elsewhere in Spark, files
    and folders below it whose names begin with _ or . are left out. Files are read once, and stored.
    In a folder that all machines share as a file system (``file:``) tasks read the files
    themselves; elsewhere Spark's scan does, whose list of files the driver holds."""
    rooted = sorted({_rooted(spark, g) for g in globs})
    roots = []
    for root, _ in rooted:
        if not any(root == r or root.startswith(r.rstrip("/") + "/") for r in roots):
            roots.append(root)

    def chosen(files):
        path = F.col("path")
        plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))          # paths have escapes
        files = files.where(plain.rlike("|".join(x for _, x in rooted)))
        if suffix:
            files = files.where(path.endswith(suffix))
        return files.where(path.rlike("^(?:" + regex + ")")) if regex else files

    stores = [_qualified(spark, r) for r in roots]
    if all(store.getScheme() == "file" and store.exists(at) for store, at in stores):
        files = _shared_files(spark, roots, chosen)
    else:
        files = spark.read.option("recursiveFileLookup", "true").text(roots, wholetext=True)
        files = chosen(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
        files = stored(files.coalesce(_tasks(spark)), "items-read")
    return ranked(files, [F.col("path")], "place", "items").select("place", "path", "text")


def flatten(text: Column) -> Column:
    """Drop comment ('#') and blank lines, join with '; ', remove tabs
    and line continuations ('\\; ')."""
    kept = F.filter(lines(text), lambda l: ~l.startswith("#") & (l != ""))
    s = F.array_join(kept, "; ")
    return F.replace(F.replace(s, F.lit("\t"), F.lit("")), F.lit("\\; "), F.lit(""))
