"""Random files made of awkward lines: the operators against SQL on another engine."""

from __future__ import annotations

import random

import pytest

from srcatlas.operators import metadata as md, tree
from srcatlas.operators.comments import extract_comments
from srcatlas.operators.imports import extract_imports
from srcatlas.operators.signatures import extract_signatures
from srcatlas.operators.todos import extract_todos
from srcatlas.plans import oracle, oracle_base

duckdb = pytest.importorskip("duckdb")

COMMON = ["", "", "  ", "\t", "x", "code();", "// a", "//", "///", "/// b", "//! c", "//!", "  // d  ", "/*", "*/", "/* e */", "/** f */", "/**", " * g", " */",
          " * @tag", " ** h", "* /", "/", "/* */", "/**/", "# i", "#", "#!x", "#![allow(y)]", "#[attr]", "using z;", "using ", "[Attr]", "package p", "package ",
          "<?php", "<?", "<? // q", "/// <summary>", "/// a>", "/// <b", '"""', "'''", '"""j"""', "'''k'''", '"""l', "m'''", "# coding: u", "# encoding: v",
          "# frozen_string_literal: true", "@n", "// TODO: t1", "# fixme : t2", "/* HACK: t3 */ x", "-- xxx: t4 --> u", "; BUG:t5", "*NOTE: t6", "// TODO t7",
          "//!TODO:!", "// ! TODO: t8", "//  !  todo  :  t9 ", "(* TODO: no", "//// TODO: `q`", "# NOTE: a Marker b", "// BUG: Known bugs", "// TODO: */", "// TODO: --> z", "### TODO: é日",
          "* TODO: */ tail", "/* TODO: a --> b */ c"]
SIGNED = ["pub fn a() {", "pub  async  fn b<T>(x: T);", "pub struct C;", "pub struct D{", "pub enum E {", "pub trait F: G {", "pub type H;", "pub type I = J;", "pub type K",
          "pub const L: u8 = 1;", "pub const M:= 2", "pub const fn n() {", "pub(crate) fn o()", "  pub fn p() -> Q {;", "pub fnr()", "pub fn é1()", "pub  mod x;",
          "export function a() {", "export async function b(c: D): E {", "export default function f() {", "export interface G extends H {", "export type I = { j: k };",
          "export type L<M> = N;", "export type O", "export class P {", "export abstract class Q {", "export const r: S = 1;", "export const t = 2;", "export const enum U {",
          "export enum V{", "export const enum: W = 3", "export function x (", "export const y", "export const z=", "  export class A1 {", "export  class  B1{",
          "def a():", "def b(c, d) -> E:", "def f(", "def _g():", "def  _h():", "async def i() -> J: pass", "async  def k(l):", "async def _m():", "class N:", "class O(P):", "class _Q:",
          "class R", "    def s(self) -> 'T':", "\tdef u(v)->w :", "def x(y) -> ", "class  _Z(A):", "deffoo()", "class:",
          "func A() {", "func b() {", "func (c *D) E(f int) (g, error) {", "func (h) i() {", "func J[K any](l K) {", "func M (n) o", "type P struct {", "type q int", "type R", "type S = T", "const U = 1",
          "const V int = 2 == 3", "const w = 4", "const X", "var Y int", "var Z = 5", "var Ü int", "func Aé(x) {", "const (", "var Q  *R"]
IMPORTED = ["use a::b;", "use std::c;", "use core::{d, e};", "use crate::f;", "use self::g::h;", "use super::i;", "use {j, k};", "use l ::m;", "pub use n::o;", "use p::q", "use  r ;", "use  ;", "use ;",
            "use std;", "use alloc::s; // t", "use stdx::u;", "use a::{b", "use std ::{x};",
            "import a from 'b';", 'import {c} from "d/e";', "import 'f';", "import g, * as h from '@i/j/k'", "import('l')", "import from 'm'", "import  from 'n'", "import   from 'o'", "import x from 'p\" y",
            "import '' import 'q'", "x = import 'r'; import 's'", "import t from u from 'v'", "importx from 'w'", "import a 'b'", "import a from'b'", "import a from   'b'", "import\tc from\t'd'", "import 'a' from 'b'",
            "const a = require('b'), c = require('d')", "require ( \"./e\" )", "require('')", "require(f)", "export * from 'g';", "export {h} from '../i';", "export { j }; export * from 'k'", "export * as l from 'm'",
            "export { n } from '@o'", "export {p} from 'node:q'", "export { a } x export { b } from 'c'", "export { export { d } from 'e'", "export { export * from 'f' } from 'g'", "export {h from 'i'", "export  *  from  \"fs\"",
            "export { export * from 'j' export { k } from 'l'", "import 'node:fs'; require('path/posix')", "import a from './'",
            "import os", "import a, b", "import c.d as e", "import  sys", "from f import g", "from .h import i", "from . import j", "from .. import k", "from ...l.m import n", "from os.path import o", "from", "from ",
            "from é import x", "import _p", "  import json", "from 'x'", "importlib.x()", "import importlib", "from .", "# import no", "frominside x",
            "import (", "import (  // note", "import \"fmt\"", "import\t\"os\"", "import x \"io\"", ")", "  )  ", ") // no", "\"a/b\"", "\t\"net/http\" // x", "  z \"github.com/c/d/e/f\"", "_ \"g.h/internal/i\"", ". \"internal/j\"",
            "\"fmt\"", "import \"k/l\"", "import ()", "import(", "var x = \"y\"", "\"\"", "x y \"z\""]
EXTS = [".rs", ".py", ".js", ".ts", ".go", ".c", ".cpp", ".cs", ".java", ".kt", ".swift", ".php", ".rb", ".sh", ".lua", ".txt", ".PYI", ".tsx"]
FILES = 1500


@pytest.fixture(scope="module")
def corpora(spark, make_files):
    rng = random.Random(20240607)
    entries = []
    for i in range(FILES):
        pool = rng.choice([COMMON, COMMON, SIGNED, IMPORTED, COMMON + SIGNED + IMPORTED])
        end = rng.choice(["\n", "\n", "\n", "\r\n"])
        text = end.join(rng.choice(pool) for _ in range(rng.randint(0, 25))) + rng.choice(["", end])
        entries.append((f"r{i % 3}", f"d{i % 7}/f{i}{EXTS[i % len(EXTS)]}", text))
    con = duckdb.connect()
    con.execute("CREATE TABLE code_files (repo VARCHAR, path VARCHAR, size_bytes BIGINT, content VARCHAR)")
    con.executemany("INSERT INTO code_files VALUES (?, ?, ?, ?)", [(r, p, len(t.encode()), t) for r, p, t in entries])
    return make_files(entries).cache(), con


META = [oracle.COMMENTS, oracle.SIGS, oracle.IMPORTS, oracle.WIDE, oracle.TODOS, oracle.META, oracle.FLAGS]
CASES = {
    "comments": ([oracle.COMMENTS], "SELECT * FROM comments", extract_comments),
    "todos": ([oracle.TODOS], "SELECT * FROM todos", extract_todos),
    "signatures": ([oracle.SIGS], "SELECT * FROM sigs", extract_signatures),
    "imports": ([oracle.IMPORTS], "SELECT * FROM imports", extract_imports),
    "metadata": (META, "SELECT * FROM meta", lambda f: md.metadata_lines(f, md.Sections(True, True, True, True))),
    "layout": (
        [*META, oracle.layout_sql("CAST(12 AS BIGINT)")],
        "SELECT repo, path, seq, text, indent FROM blocks",
        lambda f: md.block_table(
            md.with_layout(md.with_section_lines(md.file_sections(f, md.Sections(True, True, True, True))), True, width=12)
        ),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_same_rows(corpora, name):
    files, con = corpora
    ctes, select, operator = CASES[name]
    sql = oracle.with_(oracle_base.lines_sql().strip(), *[c.strip() for c in ctes]) + select
    want = con.execute(sql)
    order = sorted(c[0] for c in want.description)
    frame = want.fetchall()
    places = [[c[0] for c in want.description].index(c) for c in order]
    expected = {tuple(r[i] for i in places) for r in frame}
    got = {tuple(r) for r in operator(files).select(*order).collect()}
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got - expected, key=key)[:3] == sorted(expected - got, key=key)[:3] == []
    assert len(expected) > 100
