"""Source files derived from the ``documents`` table.

Every document becomes one file: its sentences, all of them and whole, turn into
lines of code, comments, imports and task markers by the line patterns of a language;
where a pattern has room for one word only, the sentence follows as a comment.
The patterns are data, so that the same files can be spelled out for Spark
(here) and in SQL (``oracle.py``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.schema import FILES
from srcatlas.session import write_shared

# In a pattern: $x sentence, $w its first word, $i its number, $s the first
# sentence, $l language, $o source, $d document number.
FIELD = re.compile(r"\$([xwisold])")

# How a language notes a sentence that its line pattern has no place for.
NOTES = {"rs": "// $x", "py": "# $x", "ts": "// $x", "js": "// $x", "go": "// $x", "slash": "// $x", "hash": "# $x", "plain": "$x"}

LINE_PATTERNS: dict[str, list[str]] = {
    "rs": [
        "// $x", "pub fn $w_$i(a: u32) -> $w {", "use $w::$x;", "    // TODO: $x", "pub struct $w<T> {",
        "use std::$w;", 'let v = "$x"; // FIXME: $x', "    pub async fn $w$i() {", "/* note : $x */ tail",
        "use crate::{$w, $x};", "pub const $w: u$i = $i;", "\tpub type $w = $w;", "pub enum $w {", "$x",
        "pub trait $w: $x {", "use serde::{$w};", "pub type $w;",
    ],
    "py": [
        "# $x", "def $w_$i(a, b) -> $w:", "import $w", "    # FIXME: $x", "class $w(Base):", "from $w import $x",
        "x = 1  # TODO: $x", "    async def _$w():", "from .$w import y", "import os.path", "    def $w(self):",
        "#TODO: see marker $x", "$x", "async def $w(a) -> $w: pass", "from collections import $w", "class _$w:",
        "from .. import $w",
    ],
    "ts": [
        "// $x", "export function $w$i(a: string): $w {", "import { $w } from '$w';", "/* HACK: $x */",
        "export interface $w {", "export type $w = $w | '$x';", "export * from './$w';", "import fs from 'fs';",
        "  export const $w: $w = 1;", "export abstract class $w extends B {",
        'import type { $w } from "@scope/$w/sub";', "export const enum $w {", "import '$w/x';", " * NOTE: $x", "$x",
        "export { a, $w } from '../$w';",
    ],
    "js": [
        "// $x", "export async function $w(a, b) {", "const $w = require('$w/lib');", "// xxx: `$x`",
        "export class $w {", "export const $w = $i;", 'import $w from "node:$w";', "import('path')", "// BUG: $x",
        "export * from '$w';", "require( 'http' ) ;", "$x", "import a, { b } from 'lodash/$w';", "//NOTE:$x",
    ],
    "go": [
        "// $x", "func $w$i(a int) error {", 'import "$w"', "// TODO: $x", "func (s *S) $w(x int) {", "import (",
        '\t"$w"', '\tm "github.com/$l/$o/$w"', '\t"example.org/$o/internal/$w"', ")", "type $w struct {",
        "const $w = $i", "var $w int", '\t"net/http"', "$x",
    ],
    "slash": [
        "// $x", "// TODO: $x", "int $w$i(void) {", "  * FIXME: $x", "/* BUG: $x", "code(); // HACK: $x",
        "// note: `$x`", "// XXX :$x", "$x", "-- TODO: $x", "//! todo: $x --> tail", "// TODO $x",
    ],
    "hash": [
        "# $x", "# TODO: $x", "$w = $i", "## FIXME: $x */ y", "#! HACK: $x", "$x", "; NOTE: $x", "# Known bug",
        "#BUG: Known bug $x",
    ],
    "plain": ["$x", "TODO: $x", "// TODO: $x", "# $w"],
}



def whole(family: str) -> list[str]:
    """The patterns of a language; one without the sentence is followed by a line with it."""
    return [p if "$x" in p else f"{p}\n{NOTES[family]}" for p in LINE_PATTERNS[family]]


# Extension, its line patterns, and the variants of its header.
KINDS: list[tuple[str, str, list[list[str]]]] = [
    (".rs", "rs", [
        ["//! $s", "//!", "//! Module $d of $o", "", "// plain", "//! tail", "fn main() {"],
        ["#![allow(x)]", "// note", "", "/// $s", "/// item $d", "pub fn main() {"],
        ["/*", " * $s", " *", " ** Block $d", " */", "fn main() {"],
        ["use std::fmt;"],
    ]),
    (".py", "py", [
        ["#!/usr/bin/env python", "# coding: utf-8", '"""$s', "", "  Part $d of $o.", '"""'],
        ["'''$s'''"], ["import sys", '"""late"""'], ['"""unclosed $s'],
    ]),
    (".ts", "ts", [
        ["/**", " * $s", " * /", " * Part $d", " */"], ["// $s", "", "// file $d", "import x from 'y';"],
        ["/* plain */"],
    ]),
    (".js", "js", [["/** $s */"], ["// $s"], ["#!/usr/bin/env node"]]),
    (".go", "go", [
        ["// $s", "//", "// Package $l", "package $l"], ["// dropped", 'import "fmt"', "// $s", "package $o"],
        ["/*", "$s", "*/", "package $l"], ["package $l"],
    ]),
    (".c", "slash", [["/*", " * File: $s", " * Author: $o", " */"], ["// $s", "", "// more $d"], ["int x;"]]),
    (".cpp", "slash", [["// $s"], ["/* $s */", "int a;"]]),
    (".rb", "hash", [
        ["#!/usr/bin/ruby", "# frozen_string_literal: true", "# $s", "# part $d", "", "# late"], ["class Foo"],
    ]),
    (".sh", "hash", [["#!/bin/bash", "", "# $s", "# encoding: $d", "echo"], ["echo"]]),
    (".java", "slash", [["/**", " * $s", " * @author $o", " */"], ["// $s"], ["package a;"]]),
    (".php", "slash", [
        ["<?php", "/**", " * $s", " * @var x", " */"], ["<?php", "# $s", "// two $d", "#[Attr]", "# no"], ["<? "],
    ]),
    (".cs", "slash", [
        ["/// <summary>", "/// $s", "/// </summary>", "class A"], ["using System;", "[Attr]", "// $s", "class B"],
        ["/* $s */", "class C"],
    ]),
    (".kt", "slash", [["/** $s */"], ["// $s", "// $d"]]),
    (".swift", "slash", [["// $s"], ["import A"]]),
    (".md", "plain", [["$s"]]),
    (".txt", "plain", [["$s"]]),
    (".PY", "py", [['""" $s """']]),
    (".tsx", "ts", [["// $s", "// $d"]]),
    (".xyz", "plain", [["// $s"]]),
    ("", "plain", [["$s"]]),
]

FIRST_HOUR = 1704067200  # 2024-01-01 00:00:00 UTC


def _fill(pattern: str, fields: dict[str, Column]) -> Column:
    pieces = FIELD.split(pattern)
    cols = [fields[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p]
    return F.concat(*cols) if cols else F.lit("")


def _choose(index: Column, options: list[Column]) -> Column:
    out = F.when(index == 0, options[0])
    for k, option in enumerate(options[1:], 1):
        out = out.when(index == k, option)
    return out


def _content(kind: tuple[str, str, list[list[str]]]) -> Column:
    _, family, headers = kind
    fields = {
        "s": F.coalesce(F.get("sentences", F.lit(0)), F.lit("")),
        "l": F.col("lang"),
        "o": F.col("source"),
        "d": F.col("doc_id").cast("string"),
    }
    variants = [F.array(*[_fill(p, fields) for p in lines]) for lines in headers]
    variant = (F.floor(F.col("doc_id") / 20) % len(headers)).cast("int")
    patterns = whole(family)

    def line(x: Column, i: Column) -> Column:
        own = {**fields, "x": x, "w": F.substring_index(x, " ", 1), "i": i.cast("string")}
        return _choose(i % len(patterns), [_fill(p, own) for p in patterns])

    return F.concat(_choose(variant, variants), F.transform("sentences", line))


def _files(spark: SparkSession, sf_dir: str, kind_of: Column, kinds: list[int]) -> DataFrame:
    # Dealt over all tasks, as the given table may be a single file with a single row group.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(tasks, "doc_id")
    return files_of(docs, kind_of, kinds)


def files_of(docs: DataFrame, kind_of: Column, kinds: list[int]) -> DataFrame:
    """The ``files`` table of a batch or stream of documents."""
    pieces = F.split(F.replace(F.col("text"), F.lit("."), F.lit("\n")), "\n")
    sentences = F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")
    base = docs.select("doc_id", "lang", "source", sentences.alias("sentences"), kind_of.alias("kind"))
    rows = _choose(
        F.col("kind"), [_content(KINDS[k]) if k in kinds else F.lit(None).cast("array<string>") for k in range(len(KINDS))]
    ) if len(kinds) > 1 else _content(KINDS[kinds[0]])
    ext = _choose(F.col("kind"), [F.lit(k[0]) for k in KINDS])
    end = F.when(F.col("doc_id") % 11 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    last = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(end)
    folder = F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(
        F.concat(F.lit("m"), (F.col("doc_id") % 5).cast("string"), F.lit("/"))
    )
    path = F.concat(
        F.col("lang"), F.lit("/d"), (F.col("doc_id") % 13).cast("string"), F.lit("/"), folder,
        F.lit("doc_"), F.col("doc_id").cast("string"), ext,
    )
    return base.select(
        "doc_id",
        F.col("source").alias("repo"),
        path.alias("path"),
        F.timestamp_seconds(F.lit(FIRST_HOUR) + F.col("doc_id") * 3600).alias("mtime"),
        F.array_join(rows, "\n").alias("joined"),
        end.alias("end"),
        last.alias("last"),
    ).select(
        "doc_id",
        "repo",
        "path",
        "mtime",
        F.lit(False).alias("is_symlink"),
        F.lit(False).alias("is_dir"),
        F.encode(F.concat(F.replace("joined", F.lit("\n"), F.col("end")), F.col("last")), "UTF-8").alias("content"),
    ).select(
        "repo", "path", F.octet_length("content").cast("bigint").alias("size_bytes"), "mtime", "is_symlink", "is_dir",
        "content",
    )


def kind_column() -> Column:
    """Kind of a document, so that every source holds all kinds."""
    return ((F.col("doc_id") + F.floor(F.col("doc_id") / 20)) % len(KINDS)).cast("int")


_WRITTEN: dict[tuple[str, str, tuple[str, ...]], str] = {}


def _written(spark: SparkSession, sf_dir: str, exts: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """The derived corpus as a written table, made once per session.

    Queries then scan it like any corpus: only the columns they use. It is made
    again when the folder's owner has cleared it.
    """
    key = (spark.sparkContext.applicationId, sf_dir, exts)
    if key in _WRITTEN:
        try:
            return spark.read.schema(FILES).parquet(_WRITTEN[key])
        except AnalysisException:
            pass
    _WRITTEN[key] = write_shared(make(), "corpus")
    return spark.read.schema(FILES).parquet(_WRITTEN[key])


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one file; the extension follows from its number."""
    return _written(spark, sf_dir, (), lambda: _files(spark, sf_dir, kind_column(), list(range(len(KINDS)))))


def language_files(spark: SparkSession, sf_dir: str, *exts: str) -> DataFrame:
    """Every document as a file of the given languages, in turn."""
    kinds = [k for k, kind in enumerate(KINDS) if kind[0] in exts]
    turn = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % len(kinds)).cast("int"))
    return _written(spark, sf_dir, exts, lambda: _files(spark, sf_dir, turn, kinds))


# Ignore files of the derived repositories: at the root of every source, and
# in the language folder of every source and language.
ROOT_RULES = ["# generated", "*.xyz", "!doc_*8.xyz", "/de/d3/", "m2/", "**/d5/*.py", "", "doc_1?.kt", "trailing  "]
NESTED_RULES = ["/d7/m1", "*.md", "!/d4/*.md", "d1/**/doc_*[02468].swift"]


def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code files with hidden folders, ``.git`` entries and links, plus ignore files."""
    code = code_files(spark, sf_dir)
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint")
    place = (
        F.when(number % 29 == 7, F.concat(F.lit(".git/objects/"), F.col("path")))
        .when(number % 23 == 5, F.concat(F.lit(".github/"), F.col("path")))
        .otherwise(F.col("path"))
    )
    placed = code.withColumn("is_symlink", number % 31 == 3).withColumn("path", place)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def rule_files(groups: DataFrame, path: Column, rules: list[str]) -> DataFrame:
        text = "\n".join(rules) + "\n"
        return groups.select(
            F.col("source").alias("repo"),
            path.alias("path"),
            F.lit(len(text)).cast("bigint").alias("size_bytes"),
            F.timestamp_seconds(F.lit(FIRST_HOUR)).alias("mtime"),
            F.lit(False).alias("is_symlink"),
            F.lit(False).alias("is_dir"),
            F.encode(F.lit(text), "UTF-8").alias("content"),
        )

    root = rule_files(docs.select("source").distinct(), F.lit(".gitignore"), ROOT_RULES)
    nested = rule_files(
        docs.select("source", "lang").distinct(), F.concat("lang", F.lit("/.gitignore")), NESTED_RULES
    )
    return placed.unionByName(root).unionByName(nested)


def url_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the host is the repository, the rest of the address the path.

    A page at the root of its host is called ``index``.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    host = F.substring_index("bare", "/", 1)
    rest = F.regexp_replace(F.regexp_replace("bare", r"^[^/]*/?", ""), r"/+$", "")
    content = F.encode("html", "UTF-8")
    return pages.select(bare.alias("bare"), content.alias("content")).select(
        host.alias("repo"),
        F.when(rest == "", F.lit("index")).otherwise(rest).alias("path"),
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.lit(None).cast("timestamp").alias("mtime"),
        F.lit(False).alias("is_symlink"),
        F.lit(False).alias("is_dir"),
        "content",
    )
