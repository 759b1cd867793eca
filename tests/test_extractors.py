"""Exact outputs of the four extractors on small inputs."""

from __future__ import annotations

import pytest

from srcatlas.operators.comments import extract_comments
from srcatlas.operators.imports import extract_imports, file_imports
from srcatlas.operators.signatures import extract_signatures
from srcatlas.operators.todos import extract_todos

COMMENTS = [
    # Rust: module lines first, else the first run of item lines, else a block
    ("rs", "//! Reads tide tables.\n\nmod gauge;", "Reads tide tables."),
    ("rs", "//! Moon\n//!\n// aside\n\n//! Sun\nmod sky;\n//! below code", "Moon\n\nSun"),
    ("rs", "/// Height over datum\npub fn height() {}", "Height over datum"),
    ("rs", "#![deny(warnings)]\n// aside\n\n/// Ebb\n/// Flow\n\n/// Slack\nfn tide() {}", "Ebb\nFlow"),
    ("rs", "/* Harbour list */\nmod ports;", "Harbour list"),
    ("rs", "//!\nmod empty;", None),
    ("rs", "/**\n * Stars at the left\n * are dropped\n */\nmod a;", "Stars at the left\nare dropped"),
    ("rs", "//! ends without a line feed", "ends without a line feed"),
    ("rs", " //! wide 　 gap \r\n//! 🌊 wave\r\nmod a;", "wide 　 gap\n🌊 wave"),
    # Python: the docstring, below shebang, coding line and comments
    ("py", '"""\nWeighs parcels.\n\nIn grams.\n"""\n', "Weighs parcels.\n\nIn grams."),
    ("py", '#!/bin/env python3\n# coding: latin-1\n"""Below two marks."""\n', "Below two marks."),
    ("py", "'''Three single marks.'''\nweight = 3", "Three single marks."),
    ("py", '"""never closed', None),
    ("py", '""""""\n"""second"""', None),
    ("py", 'import scales\n"""too late"""', None),
    ("pyi", '\n  # aside\n\n  """ a stub """', "a stub"),
    # JavaScript and TypeScript: a documentation block or the leading run
    ("js", "/**\n * Draws the map legend\n */\nlegend();\n", "Draws the map legend"),
    ("js", "// Colour scales\n\nexport const red = 1;", "Colour scales"),
    ("ts", "// north\n\n// south\nturn()\n// west", "north\nsouth"),
    ("js", "/* no second star */\nturn()", None),
    # Go: what stands right above the package clause
    ("go", "// upper\nimport \"sort\"\n// lower\npackage reef", "lower"),
    ("go", "/* coral */\n/* sponge */\npackage reef", "coral"),
    ("go", "/* never closed\npackage reef", None),
    ("go", "// above a gap\n\npackage reef\n// below", "above a gap"),
    ("go", "// x /* inner */ y\n/* z */\npackage reef", "inner"),
    ("go", "// stays\n/* */\npackage reef", "stays"),
    # C family
    ("c", "/*\n * Unit: knots\n * Since: spring\n */\nint knots;", "Unit: knots\nSince: spring"),
    ("h", "// port\n//\n// starboard\nint side;", "port\n\nstarboard"),
    ("cpp", "\n\n/* after gaps */", "after gaps"),
    # Ruby and shell: magic lines are skipped, in Ruby also coding lines
    ("rb", "# encoding: ascii\n# frozen_string_literal: true\n# Brews tea\nmodule Tea; end", "Brews tea"),
    ("rb", "# leaf\n#!odd\n# coding: q\n# water\n\n# late", "leaf\nwater"),
    ("sh", "#!/bin/sh\n# Fills the kettle\n# and heats it\nboil", "Fills the kettle\nand heats it"),
    ("bash", "#!/bin/bash\n\n# encoding: stays here\n", "encoding: stays here"),
    # Java family: tag lines go
    ("java", "/**\n * Books a berth\n * @since spring\n */\nclass Berth {}", "Books a berth"),
    ("kt", "// one line\nclass Berth", "one line"),
    ("swift", "/** @tag alone */\n// x", None),
    ("php", "<?php\n/**\n * Signs the log book\n */\nclass Log {}", "Signs the log book"),
    ("php", "<?\n# rope\n// knot\n#[Hook]\n# sail", "rope\nknot"),
    ("cs", "/// <summary>\n/// Rings the bell\n/// </summary>\nclass Bell {}", "Rings the bell"),
    ("cs", "using Harbour;\n[Loud]\n// at noon\nclass Bell", "at noon"),
    ("cs", "/* brass */ class Bell", "brass"),
    # nothing to find
    ("rs", "", None),
    ("go", "var depth = 3", None),
    ("js", "/**/\nturn()", None),
    ("rs", "/*/\nmod a;", None),
    ("lua", "-- a language without a rule", None),
    ("xyz", "// no language", None),
]


def test_comments(make_files):
    files = make_files({f"c{i}.{ext}": text for i, (ext, text, _) in enumerate(COMMENTS)})
    got = {r.path: r.comment for r in extract_comments(files).collect()}
    for i, (ext, text, want) in enumerate(COMMENTS):
        assert got.get(f"c{i}.{ext}") == want, (ext, text)


def test_long_headers_do_not_overflow(make_files):
    body = "".join(f"//! line {i}\n" for i in range(40_000))
    files = make_files(
        {
            "a.rs": body,
            "b.go": "// x\n" * 100_000 + "package p\n",
            "c.sh": "# y\n" * 100_000,
            "d.py": "# z\n" * 100_000 + '"""doc"""',
            "e.cs": "using a;\n" * 50_000 + "// c#",
        }
    )
    got = {r.path: r.comment for r in extract_comments(files).collect()}
    assert got["a.rs"].count("\n") == 39_999
    assert got["b.go"].count("x") == 100_000 and got["c.sh"].count("y") == 100_000
    assert got["d.py"] == "doc" and got["e.cs"] == "c#"


SIGNATURES = [
    ("rs", "pub fn moor(line: u8) -> bool {\n}\npub async fn cast_off() {}\nfn drift() {}",
     [("pub fn moor(line: u8) -> bool", "moor", 0), ("pub async fn cast_off()", "cast_off", 0)]),
    ("rs", "pub struct Berth {\npub struct Crate<T> {\nstruct Bilge;\npub trait Floats {\npub enum Tide {\n",
     [("pub struct Berth", "Berth", 0), ("pub struct Crate<T>", "Crate", 0), ("pub trait Floats", "Floats", 0), ("pub enum Tide", "Tide", 0)]),
    ("rs", "    pub const DRAUGHT: f32 = 2.5;\n\tpub type Log = Vec<Tide>;\n/// pub fn quoted()",
     [("pub const DRAUGHT: f32", "DRAUGHT", 4), ("pub type Log = Vec<Tide>", "Log", 4)]),
    ("ts", "export interface Buoy {\nexport type Bearing = number;\nexport async function sound(b: Bearing): Promise<Buoy> {\n"
           "export function anchor() {\nfunction inner() {}\nexport const CHANNEL: number = 16;",
     [("export interface Buoy", "Buoy", 0), ("export type Bearing = number", "Bearing", 0),
      ("export async function sound(b: Bearing): Promise<Buoy>", "sound", 0), ("export function anchor()", "anchor", 0),
      ("export const CHANNEL: number", "CHANNEL", 0)]),
    ("tsx", "export class Chart {\nexport abstract class Layer {\nexport const enum Depth {\nexport enum Light {",
     [("export class Chart", "Chart", 0), ("export abstract class Layer", "Layer", 0), ("export const enum Depth", "Depth", 0), ("export enum Light", "Light", 0)]),
    ("js", "export function plot(lat, lon) {\nexport async function signal(flag) {\nexport class Mast {\nexport const RIG = 'sloop';\nfunction inner() {}",
     [("export function plot(lat, lon)", "plot", 0), ("export async function signal(flag)", "signal", 0), ("export class Mast", "Mast", 0),
      ("export const RIG", "RIG", 0)]),
    ("py", "def weigh(box: Box) -> float:\ndef stack(boxes):\nasync def lift() -> None:\nasync def lower():\ndef _tare():\n"
           "class Crane(Machine):\nclass _Hook:\n    def swing(self):\n# def quoted():",
     [("def weigh(box: Box) -> float", "weigh", 0), ("def stack(boxes)", "stack", 0), ("async def lift() -> None", "lift", 0),
      ("async def lower()", "lower", 0), ("class Crane(Machine)", "Crane", 0), ("def swing(self)", "swing", 4)]),
    ("go", "type Reef struct {\ntype shoal struct {\nfunc Survey() *Reef {\nfunc (r *Reef) Depth() float64 {\nfunc hidden() {}\n"
           "const Fathom = 6\nvar Home Reef",
     [("type Reef struct", "Reef", 0), ("func Survey() *Reef", "Survey", 0), ("func (r *Reef) Depth() float64", "Depth", 0),
      ("const Fathom", "Fathom", 0), ("var Home Reef", "Home", 0)]),
    ("rs", "pub fn tiefe(ß: u8) {", [("pub fn tiefe(ß: u8)", "tiefe", 0)]),
    ("rb", "pub fn elsewhere() {", []),
]


def test_signatures(make_files):
    files = make_files({f"s{i}.{ext}": text for i, (ext, text, _) in enumerate(SIGNATURES)})
    got: dict[str, list] = {}
    for r in extract_signatures(files).orderBy("path", "seq").collect():
        got.setdefault(r.path, []).append((r.signature, r.symbol, r.indent))
    for i, (ext, text, want) in enumerate(SIGNATURES):
        assert got.get(f"s{i}.{ext}", []) == want, (ext, text)


TODOS = [
    ("rs", "\n// TODO: mend the sail\nfn a() {}\n\n// FIXME: pump leaks\nfn b() {}", [(2, "TODO", "mend the sail"), (5, "FIXME", "pump leaks")]),
    ("py", "# NOTE: oars\n# BUG: rudder\n# XXX: keel\n# HACK: mast\n# FIXME: boom\n# TODO: jib\n",
     [(1, "NOTE", "oars"), (2, "BUG", "rudder"), (3, "XXX", "keel"), (4, "HACK", "mast"), (5, "FIXME", "boom"), (6, "TODO", "jib")]),
    ("js", "// fixme: low\n// FixMe: mixed\n// FIXME: high", [(1, "FIXME", "low"), (2, "FIXME", "mixed"), (3, "FIXME", "high")]),
    ("rs", "// BUG no colon\n// NOTE - a dash", []),
    ("c", "/* HACK: inside one block */\n * NOTE: inside a longer one", [(1, "HACK", "inside one block"), (2, "NOTE", "inside a longer one")]),
    ("rs", "// XXX:\n// XXX:    \n", []),
    ("rs", "/// NOTE: say what it does\nfn a() {}", [(1, "NOTE", "say what it does")]),
    ("rs", "\n\n\n// HACK: fourth\r\n\r\n// BUG: sixth", [(4, "HACK", "fourth"), (6, "BUG", "sixth")]),
    ("rs", "// BUG: `quoted`\n// BUG: a marker by name\n// BUG: Known bug in a list", []),
    ("rs", "sail(); // TODO: behind code", []),
    ("lua", "-- HACK : gap before the colon\n; NOTE: until here --> not this\n//! XXX:tight",
     [(1, "HACK", "gap before the colon"), (2, "NOTE", "until here"), (3, "XXX", "tight")]),
    ("txt", "// TODO: prose is no source", []),
]


def test_todos(make_files):
    files = make_files({f"t{i}.{ext}": text for i, (ext, text, _) in enumerate(TODOS)})
    got: dict[str, list] = {}
    for r in extract_todos(files).orderBy("path", "line").collect():
        got.setdefault(r.path, []).append((r.line, r.marker, r.text))
    for i, (ext, text, want) in enumerate(TODOS):
        assert got.get(f"t{i}.{ext}", []) == want, (ext, text)


IMPORTS = [
    ("rs", "use std::net::TcpStream;\nuse core::fmt::{self, Debug};\nuse tokio::task;\nuse rand::{Rng, random};\nuse crate::dock::Pier;\n"
           "use super::quay;\npub use ropes::Knot;\nuse sails::{\n Jib};\nuse tokio::time;",
     (["tokio", "rand", "tokio"], ["net::TcpStream", "fmt::{self, Debug}"], ["dock::Pier", "super::quay"])),
    ("ts", "import Vue from 'vue';\nimport { ref } from \"vue\";\nimport os from 'os';\nimport dock from './dock';\n"
           "import type { Mast } from '@ship/rig/sails';\nimport pick from 'ramda/pick';\nexport * from '../quay';\nexport { join } from 'path';\n"
           "import 'polyfill';\nconst old = require('unseen');",
     (["vue", "@ship/rig", "ramda", "polyfill"], ["os", "path"], ["./dock", "../quay"])),
    ("js", "const zip = require('zlib'); import('later');\nimport url from 'node:url';\nimport from 'bare';\nimport   from 'wide';\n"
           "rig = require( \"winch/drum\" )\nimport '' ; import 'tail'",
     (["wide", "winch", "tail"], ["zlib", "url"], [])),
    ("py", "import json, math\nimport math\nfrom shutil import copy\nfrom itertools import chain\nimport pandas as pd\nfrom . import dock\n"
           "from ..quay import crane\n# import quoted\nimport json\nfrom harbour masters heard",
     (["pandas", "harbour"], ["json", "math", "shutil", "itertools"], [".", "..quay"])),
    ("go", "package reef\nimport \"sort\"\nimport (\n\t\"time\"\n\tb \"encoding/binary\"\n\t\"example.net/tides/tables/moon\"\n"
           "\t\"example.net/tides/internal/sun\"\n)\nvar names = []string{\n\"coral\",\n}\nimport (\n  \"bufio\"\n  import \"x/internal/y\"\n",
     (["encoding/binary", "example.net/tides/tables"], ["sort", "time", "bufio"], ["example.net/tides/internal/sun", "x/internal/y", "x/internal/y"])),
    ("go", "import (\"same\")\n  \"inside\"\n\t)\t\r\n\"outside\"\n", ([], ["inside"], [])),
    ("rb", "import os", None),
]


def test_imports(make_files):
    files = make_files({f"i{i}.{ext}": text for i, (ext, text, _) in enumerate(IMPORTS)})
    got = {r.path: r.imports for r in file_imports(files).collect()}
    for i, (ext, text, want) in enumerate(IMPORTS):
        row = got.get(f"i{i}.{ext}")
        have = None if row is None else (list(row.external), list(row.std), list(row.internal))
        assert have == want, (ext, text)
    long = extract_imports(files).where("path = 'i0.rs'").orderBy("category", "seq").collect()
    assert [(r.category, r.seq, r.module) for r in long][:3] == [
        ("external", 1, "tokio"), ("external", 2, "rand"), ("external", 3, "tokio")]


@pytest.mark.parametrize("line", ["import " * 120_000 + "'", "export {" * 100_000, "// " + " " * 900_000, "use" + " " * 900_000 + "x", "export type " + "a" * 900_000])
def test_one_very_long_line_stays_linear(make_files, line):
    import time

    names = ["a.ts", "b.rs", "c.js", "d.go", "e.py"]
    files = make_files({n: line for n in names})
    start = time.time()
    extract_imports(files).count(), extract_todos(files).count(), extract_signatures(files).count()
    assert time.time() - start < 60


def test_gates(make_files):
    files = make_files(
        {
            "bin.rs": b"\x00\x01\xff\xfe// TODO: x",
            "big.rs": "// TODO: big\n" + "x" * 500_000,
            "UPPER.RS": "// TODO: upper\n",
            "Makefile": "# TODO: none\n",
        }
    )
    assert {r.path for r in extract_todos(files).collect()} == {"big.rs", "UPPER.RS"}
    assert {r.path for r in extract_todos(files, max_file_size=100_000).collect()} == {"UPPER.RS"}


@pytest.mark.parametrize("size", [1_500_000, 6_000_000])
def test_large_files_are_read_by_default(make_files, size):
    from srcatlas.operators import stats

    files = make_files({"large.rs": "//! Large\nuse tokio::task;\n// TODO: here\n" + "x\n" * (size // 2) + "// BUG: last\n"})
    assert [r.marker for r in extract_todos(files).orderBy("line").collect()] == ["TODO", "BUG"]
    assert extract_comments(files).first().comment == "Large" and extract_imports(files).first().module == "tokio"
    assert stats.language_stats(files).first().lines == size // 2 + 4
