"""Name globs and ignore patterns as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_GLOB_TOKEN = re.compile(r"\[!?\]?[^\]]*\]|\*+|\?|.", re.S)


def glob_to_regex(pattern: str) -> str | None:
    """Regular expression for a base-name glob; None for a malformed pattern.

    ``*`` any run, ``?`` one character, ``[abc]``, ``[a-z]``, ``[!x]``; ``**``
    must stand alone or be a whole leading component.
    """
    if pattern in ("**", "**/**"):
        return "(?s)^.*$"
    body = pattern[3:] if pattern.startswith("**/") else pattern
    out = []
    for token in _GLOB_TOKEN.findall(body):
        if token == "*":
            out.append(".*")
        elif token[0] == "*" or token == "[":
            return None
        elif token == "?":
            out.append(".")
        elif token[0] == "[" and len(token) > 2:
            negated = token[1] == "!"
            inside = token[2:-1] if negated else token[1:-1]
            if not inside:
                return None
            inside = re.sub(r"([\\\[\]^&])", r"\\\1", inside)
            out.append(f"[{'^' if negated else ''}{inside}]")
        elif token[0] == "[":
            return None
        else:
            out.append(re.escape(token))
    regex = "(?s)^" + "".join(out) + "$"
    try:
        re.compile(regex)
    except re.error:  # a range that runs backwards matches nothing
        return None
    return regex


def name_matches(name: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """True when the name equals or matches any pattern."""
    hit = name.isin(list(patterns)) if patterns else F.lit(False)
    for regex in filter(None, map(glob_to_regex, patterns)):
        hit = hit | name.rlike(regex)
    return hit


def any_component_matches(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """True when a component matches, so that a matched directory takes its subtree."""
    return F.exists(F.split(path, "/"), lambda c: name_matches(c, patterns))


# Named classes inside brackets and the classes of regular expressions.
_POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}

# Pieces of an ignore pattern, tried in this order.
_IGNORE_TOKEN = (
    r"(?s)\\.|\[[!^]?\]?(?:\[:[a-z]+:\]|[^\]])*\]|^\*\*/|^\*\*$|(?<=/)\*\*/|(?<=/)\*\*$|\*+|\?|."
)


def ignore_regex(pattern: Column, anchored: Column) -> Column:
    """Regular expression over the path below the rule's directory.

    ``pattern`` has no leading or trailing slash and no negation mark. NULL
    for a pattern with an unclosed character class.
    """
    tokens = F.regexp_extract_all(pattern, F.lit(_IGNORE_TOKEN), F.lit(0))
    numbered = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def char_class(t: Column) -> Column:
        core = F.regexp_extract(t, r"(?s)^\[[!^]?(.*)\]$", 1)
        safe = F.regexp_replace(core, r"([\[\]\\&^])", r"\\$1")
        for name, java in _POSIX.items():
            safe = F.replace(safe, F.lit(rf"\[:{name}:\]"), F.lit(rf"\p{{{java}}}"))
        head = F.when(t.rlike(r"^\[[!^]"), F.lit("[^/")).otherwise(F.lit("["))
        return F.concat(head, safe, F.lit("]"))

    def piece(item: Column) -> Column:
        t, i = item["t"], item["i"]
        last = i == F.size(tokens) - 1
        return (
            F.when(t == "**/", F.lit("(?:.*/)?"))
            .when((t == "**") & last & (i == 0), F.lit(".*"))
            .when((t == "**") & last & F.endswith(pattern, F.lit("/**")), F.lit(".+"))
            .when(F.startswith(t, F.lit("*")), F.lit("[^/]*"))
            .when(t == "?", F.lit("[^/]"))
            .when(F.startswith(t, F.lit("[")), char_class(t))
            .when(t.rlike(r"^\\[A-Za-z0-9]"), F.substring(t, 2, 2))
            .when(F.startswith(t, F.lit("\\")) & (F.length(t) > 1), t)
            .otherwise(F.regexp_replace(t, r"([.+^$(){}|\[\]\\&])", r"\\$1"))
        )

    def broken_token(t: Column) -> Column:
        spans = F.when(
            F.startswith(t, F.lit("[")),
            F.regexp_extract_all(t, F.lit(r"(?s)[^\[!^-]-[^\]]"), F.lit(0)),
        )
        backwards = F.exists(spans, lambda r: F.left(r, F.lit(1)) > F.right(r, F.lit(1)))
        return t.isin("[", "[]", "[!]", "[^]") | F.coalesce(backwards, F.lit(False))

    broken = F.exists(tokens, broken_token)
    body = F.array_join(F.transform(numbered, piece), "")
    head = F.when(anchored, F.lit("")).otherwise(F.lit("(?:.*/)?"))
    return F.when(~broken, F.concat(F.lit("(?s)^"), head, body, F.lit("$")))
