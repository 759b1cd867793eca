"""Exported signatures, line by line."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.display import clean_signature
from srcatlas.functions.text import bind, indent_of, raw_lines, trim
from srcatlas.operators.corpus import with_text


@dataclass(frozen=True)
class SignatureRule:
    """Patterns of one language.

    ``openings`` is a cheap test before any pattern. In ``declarations`` the
    alternatives exclude each other, each with one group for the symbol.
    ``constants`` end in ``=``, which is cut off.
    """

    openings: tuple[str, ...]
    declarations: str
    constants: str | None = None
    hidden: tuple[str, ...] = ()


# What counts as an exported declaration, on the trimmed line.
SIGNATURE_RULES = {
    "rs": SignatureRule(
        openings=("pub",),
        declarations=(
            r"(?U)^pub\s+(?:"
            r"(?:(?:async\s+)?fn|struct|enum|trait)\s+(\w+)[^{;]*"
            r"|type\s+(\w+)[^;]+"
            r"|const\s+(\w+):\s*[^=]+)"
        ),
    ),
    "ts": SignatureRule(
        openings=("export",),
        declarations=(
            r"(?U)^export\s+(?:"
            r"(?:(?:async\s+)?function|interface|(?:abstract\s+)?class|(?:const\s+)?enum)\s+(\w+)[^{]*"
            r"|type\s+(\w++)[^=]*=\s*[^;{]+"
            r"|const\s+(\w+):\s*[^=]+)"
        ),
    ),
    "js": SignatureRule(
        openings=("export",),
        declarations=(
            r"(?U)^export\s+(?:"
            r"(?:async\s+)?function\s+(\w+)\s*\([^)]*\)"
            r"|class\s+(\w+)[^{]*)"
        ),
        constants=r"(?U)^export\s+const\s+(\w+)\s*=",
    ),
    "py": SignatureRule(
        openings=("def", "async", "class"),
        declarations=(
            r"(?U)^(?:"
            r"(?:async\s+)?def\s+(\w+)\s*\([^)]*\)(?:\s*->\s*[^:]+)?"
            r"|class\s+(\w+)[^:]*)"
        ),
        hidden=("def _", "async def _", "class _"),
    ),
    "go": SignatureRule(
        openings=("func", "type", "const", "var"),
        declarations=(
            r"(?U)^(?:"
            r"func\s+(?:\([^)]+\)\s*)?([A-Z]\w*)\s*\([^)]*\)[^{]*"
            r"|(?:type|var)\s+([A-Z]\w*)\s+\w+)"
        ),
        constants=r"(?U)^const\s+([A-Z]\w*+)\s*+[^=]*=",
    ),
}


def _starts_with_any(col: Column, heads: tuple[str, ...]) -> Column:
    hit = F.startswith(col, F.lit(heads[0]))
    for head in heads[1:]:
        hit = hit | F.startswith(col, F.lit(head))
    return hit


def _groups(regex: str) -> int:
    return len(re.findall(r"(?<!\\)\((?!\?)", regex))


def _contains_any(col: Column, words: tuple[str, ...]) -> Column:
    hit = F.contains(col, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(col, F.lit(word))
    return hit


def _signature(line: Column, rule: SignatureRule, pos: Column) -> Column:
    def found(signature: Column, symbol: Column) -> Column:
        return F.struct(
            (pos + 1).alias("line"),
            signature.alias("signature"),
            symbol.alias("symbol"),
            indent_of(line).alias("indent"),
        )

    def declaration(match: Column) -> Column:
        # Groups of the alternatives that did not match come back empty.
        groups = range(1, _groups(rule.declarations) + 1)
        symbol = F.concat(*[F.regexp_extract(match, rule.declarations, g) for g in groups])
        return F.when(match != "", found(clean_signature(match), symbol))

    def constant(match: Column) -> Column:
        symbol = F.regexp_extract(match, rule.constants, 1)
        return F.when(match != "", found(trim(F.rtrim(match, F.lit("="))), symbol))

    def tested(t: Column) -> Column:
        gate = _starts_with_any(t, rule.openings)
        if rule.hidden:
            gate = gate & ~_starts_with_any(t, rule.hidden)
        hit = bind(F.regexp_extract(t, rule.declarations, 0), declaration)
        if rule.constants:
            hit = F.coalesce(hit, bind(F.regexp_extract(t, rule.constants, 0), constant))
        return F.when(gate, hit)

    return F.when(_contains_any(line, rule.openings), bind(trim(line), tested))


def signatures_array(lines: Column, canon_ext: Column) -> Column:
    """Array of (line, signature, symbol, indent) for one file, in file order."""

    def hits(rule: SignatureRule) -> Column:
        found = F.transform(lines, lambda line, pos: _signature(line, rule, pos))
        return F.filter(found, lambda s: s.isNotNull())

    out = None
    for ext, rule in SIGNATURE_RULES.items():
        test = canon_ext == ext
        out = F.when(test, hits(rule)) if out is None else out.when(test, hits(rule))
    return out


def extract_signatures(files: DataFrame, **gates: int) -> DataFrame:
    """(repo, path, seq, line, signature, symbol, indent); a narrow stage."""
    return (
        with_text(files, **gates)
        .where(F.col("canon_ext").isin(list(SIGNATURE_RULES)))
        .select("repo", "path", "canon_ext", raw_lines(F.col("text")).alias("lines"))
        .select(
            "repo",
            "path",
            F.posexplode(signatures_array(F.col("lines"), F.col("canon_ext"))).alias("pos", "s"),
        )
        .select("repo", "path", (F.col("pos") + 1).alias("seq"), "s.*")
    )
