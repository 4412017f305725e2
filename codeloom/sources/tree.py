"""Source trees: scan, filter, language routing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import glob_to_regex

# What is left out unless included, and which extensions mean which language.
SKIPPED_DIRS = (".git", ".hg", ".svn", "node_modules", "vendor", "bower_components", "dist", "build", "out", "target", "coverage", ".next", ".nuxt", ".svelte-kit", ".output", "testdata")
SKIPPED_FILES = ("**/*.min.js", "**/*.min.css")
EXTENSIONS = {"go": ("go",), "python": ("py", "pyi"), "php": ("php", "phtml"), "tsjs": ("ts", "tsx", "js", "jsx", "mjs", "cjs")}


@dataclass
class Filter:
    """Which paths are indexed: what include matches always, else what no default and no exclude matches. Patterns without wildcards are path prefixes."""

    exclude: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    skipped_dirs: tuple[str, ...] = SKIPPED_DIRS

    @staticmethod
    def matches(path: Column, patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            p = p.removeprefix("./").rstrip("/")
            if any(c in p for c in "*?"):
                # a pattern that names a directory takes what is below it
                out = out | path.rlike(glob_to_regex(p)) | path.rlike(glob_to_regex(p)[:-1] + "/.*$")
            else:
                out = out | (path == p) | path.startswith(p + "/")
        return out

    def keeps(self, path: Column) -> Column:
        dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
        default = F.arrays_overlap(dirs, F.array(*map(F.lit, self.skipped_dirs))) | self.matches(path, list(SKIPPED_FILES))
        return self.matches(path, self.include) | ~(default | self.matches(path, self.exclude))


def sniffed(head: Column) -> Column:
    """A language that the first bytes (as text) tell, or null: PHP's opening tag, or a #! line; what holds a NUL is binary."""
    start = F.regexp_replace(head, "^﻿?[ \t\r\n]*", "")
    first = F.regexp_extract(start, r"^(#![^\n]*)", 1)
    tag = F.when(start.startswith("<?php") | start.startswith("<?="), "php").when(first.contains("php"), "php").when(first.contains("python"), "python").when(first.rlike("node|deno|bun"), "tsjs")
    return F.when(~head.contains("\u0000"), tag)


def language(path: Column, head: Column, associations: dict[str, str] | None = None) -> Column:
    """By association globs (in their order; of the base name if they have no slash), then extension, then, whatever the name, content."""
    out, name = F.when(F.lit(False), ""), F.element_at(F.split(path, "/"), -1)
    for pattern, lang in sorted((associations or {}).items()):
        out = out.when((path if "/" in pattern else name).rlike(glob_to_regex(pattern)), lang)
    for lang, endings in EXTENSIONS.items():
        out = out.when(path.rlike(rf"\.({'|'.join(endings)})$"), lang)
    return out.otherwise(sniffed(head))


def scan(spark: SparkSession, root: str, filter_: Filter | None = None, associations: dict[str, str] | None = None) -> DataFrame:
    """(path, hash, size, mtime, lang, content) of the indexed files below a root, in whatever store Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    at = F.expr(f"substring(path, locate('{base}/', path) + {len(base) + 1})")
    files = raw.select(F.url_decode(F.regexp_replace(at, r"\+", "%2B")).alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime"), "content")
    files = files.filter((filter_ or Filter()).keeps(F.col("path")))
    head = F.decode(F.substring("content", 1, 1024), "UTF-8")
    found = files.withColumn("lang", language(F.col("path"), head, associations)).filter("lang is not null")
    return found.select("path", F.sha2("content", 256).alias("hash"), "size", "mtime", "lang", F.decode("content", "UTF-8").alias("content"))


def lines(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")
