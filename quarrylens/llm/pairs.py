"""Functions paired with their documentation.

Recursive patterns capture the comment above a function, its signature and its balanced
body as one match, with strings and comments protected; the newest answer on the
function's location gives the documentation, and trivial documentation is filtered out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.incremental import normal_path
from quarrylens.runtime import pick

MIN_WORDS = 4
#: Letters of a script without word spaces that count as a word.
UNSPACED_WORD = 5
#: Functions of a file are handled together in stretches of so many lines.
CHUNK_LINES = 2000

_QUOTED = r"""(?P<str>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)"""
#: In languages whose single quotes also mark lifetimes they hold one character.
_QUOTED_ONE = r"""(?P<str>"(?:[^"\\]|\\.)*+"|'(?:[^'\\\n]|\\[^\n][^'\n]{0,9}+)')"""
_NOTE = r"(?P<note>//[^\n]*+|/\*(?s:.*?)\*/)"
_INSIDE = r"""(?&str)|(?&note)|/|["'`]"""


def _braced(quoted: str) -> regex.Pattern:
    """Comment, signature and body in languages whose blocks have braces. Every loop is possessive, so a match costs
    no more than the text it looks at."""
    return regex.compile(
        rf"(?P<comment>(?:[ \t]*+(?://[^\n]*+|/\*(?s:.*?)\*/|\#\[[^\n]*+|@\w[^\n]*+)\s*+)*+)"
        rf"(?P<signature>[^\S\n]*+(?=[^\s{{])(?:[^{{}};()\[\]\"'`/]++|(?&round)|(?&square)|{_INSIDE})*+)"
        rf"(?P<body>(?P<curly>\{{(?:[^{{}}\"'`/]++|(?&curly)|{_INSIDE})*+\}})|;?+)"
        rf"(?(DEFINE){quoted}{_NOTE}(?P<round>\((?:[^()\"'`/]++|(?&round)|{_INSIDE})*+\))(?P<square>\[(?:[^\[\]\"'`/]++|(?&square)|{_INSIDE})*+\]))"
    )


BRACED, RUST = _braced(_QUOTED), _braced(_QUOTED_ONE)
#: The same where blocks are indented: the body is what stands deeper than the signature.
INDENTED = regex.compile(
    r"(?P<comment>(?:[ \t]*+(?:#[^\n]*+|@\w[^\n]*+)\n)*+)"
    r"(?P<signature>(?P<indent>[ \t]*+)(?:async[ \t]+)?def[ \t]+\w+[ \t]*(?P<round>\((?:[^()\"'#]++|(?&str)|#[^\n]*+|['\"]|(?&round))*+\))[^:\n]*+:)"
    r"(?P<body>[^\n]*+(?:\n(?:[ \t]*+(?=\n|\Z)|(?P=indent)[ \t]++[^\n]*+|[ \t]*+#[^\n]*+|\"\"\"(?s:.*?)\"\"\"[^\n]*+))*+)"
    rf"(?(DEFINE){_QUOTED})"
)
_ABOVE = re.compile(r"\s*(?://|/\*|\*|\*/|#|@)")
_CLASS = re.compile(r"^\s*(?:(?:export|default|public|private|protected|internal|static|final|abstract|sealed|partial|open|data|inner|pub(?:\([^)]*\))?|declare|@\w+)\s+)*(?:class|interface|struct|enum|trait|impl|namespace|object|record|module|mod|type|union)\b(?!\s*\()")


class Source:
    """The text of a file with one kind of line end and the places of its lines."""

    def __init__(self, content: str):
        self.text = content.replace("\r\n", "\n").replace("\r", "\n")
        self.starts = [0]
        at = self.text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = self.text.find("\n", at + 1)

    def line(self, k: int) -> str:
        """The line k, counted from 0, without its end."""
        return self.text[self.starts[k] : self.end(k)]

    def end(self, k: int) -> int:
        return self.starts[k + 1] - 1 if k + 1 < len(self.starts) else len(self.text)


def capture(source: Source | str, lang: str | None, line: int, last: int | None = None) -> tuple[str, str, str] | None:
    """(comment, signature, body) of the function whose signature starts in the given line, counted from 1.

    Nothing after the line ``last`` is looked at. A function without a body (one that is only
    declared, or whose value follows ``=``) is captured with what its own lines hold.
    """
    source = Source(source) if isinstance(source, str) else source
    if not 0 < line <= len(source.starts):
        return None
    top = line - 1
    while top > 0 and (above := source.line(top - 1)).strip() and _ABOVE.match(above):
        top -= 1
    language = (lang or "").lower()
    python = language == "python"
    pattern = INDENTED if python else RUST if language == "rust" else BRACED
    end = source.end(min(max(last, line), len(source.starts)) - 1) if last else len(source.text)
    for first in dict.fromkeys((top, line - 1)):
        m = pattern.match(source.text, source.starts[first], end)
        if m and source.starts[line - 1] <= m.start("signature") <= source.end(line - 1) and "(" in m["signature"]:
            if not python and not m["curly"] and not (last and m.end() >= end - 1) and m["body"] != ";":
                continue
            return m["comment"].strip(), m["signature"].strip(), m["body"]
    return None


# Lines of documentation that say that there is none, in lower case without marks at the ends.
PLACEHOLDERS = {
    "description of the function goes here", "description goes here", "inherited from parent", "inherited", "non-javadoc", "(non-javadoc)",
    "auto-generated method stub", "auto generated method stub", "missing description", "no description", "_summary_", "_description_",
    "created by the editor template, replace this text", "see above", "see below", "no comment", "none", "n/a", "getter", "setter", "main function",
    "internal use", "internal use only", "for internal use only", "helper", "beschreibung folgt", "à documenter", "a documenter", "por documentar",
    "sin documentar", "mô tả sau", "documentation to follow", "insert description here", "enter description here", "add description here",
    "write documentation here", "place documentation here", "this is a stub", "not documented yet", "undocumented", "to be documented", "same as above",
    "documentation inherited from the parent class", "documentation inherited from parent class", "dokumentation folgt", "sans description", "à compléter", "cần mô tả",
    "todo add documentation", "no documentation available", "documentation missing", "documentation is missing",
}
_PLACEHOLDER_START = re.compile(
    r"^\W*(?:todo|fixme|xxx|tbd|tbc|wip|hack)\b|^\W*(?:to be (?:documented|written|done|described|added|completed))\b|^\W*\{?@inherit"
    r"|^\W*(?:type|write|enter|insert|add|put) (?:a |the |your |some )?(?:description|documentation|summary)\b|^\W*(?:lorem ipsum)\b"
    r"|^\W*(?:(?:see|refer to) (?:the )?(?:super|parent|base)(?: ?class| method| interface)?)\b|^\W*(?:inherit(?:ed|s)? (?:from|the))\b|\breplace this text\b|\bgoes here\W*$", re.I)
_DIRECTIVE = re.compile(
    r"^\W*(?:noqa|nosonar|nolint|nosec|pylint\b|pyright\b|mypy\b|flake8\b|ruff\b|isort\b|fmt:|yapf\b|type:\s*ignore|pragma\b|eslint\b|eslint-|tslint|jshint|jslint|jscs|prettier-ignore"
    r"|ts-ignore|ts-expect-error|ts-nocheck|istanbul\b|c8 ignore|v8 ignore|stylelint|biome-ignore|checkstyle|spotless|noinspection|suppress\w*\b|phpcs|phpstan|psalm|rubocop|clang-format|clang-tidy"
    r"|go:\w+|\+build|sourcery\b|coverage:|codecoverageignore|resharper|region\b|endregion\b|language=|@formatter|vim:|-\*-|webpack\w*:|swiftlint|ktlint|detekt|sonar)", re.I)
_LICENCE = re.compile(r"\bcopyright\b|©|\(c\)\s*\d{4}|all rights reserved|\bspdx-|\b(?:licensed|released|distributed) (?:to|under)\b|^\W*see (?:the )?licen[cs]e|\bLICEN[CS]E(?:\.\w+)?\b for\b|permission is hereby granted", re.I)
_CODE = re.compile(
    r"^\s*(?:return\b[^.]*;|return\s+[\w.$]+|[\w.$\[\]]+(?:\s*:\s*\w+)?\s*(?:[-+*/%|&^]|<<|>>|//|\*\*)?:?=(?!=)\s*\S.*|(?:let|var|const|val|int|long|double|float|auto|final)\s+[\w$]+\s*(?::\s*\w+\s*)?=.*"
    r"|[\w.$]+\([^)]*\)\s*;?|(?:if|for|while|switch|catch|elif)\s*\(.*\)\s*\{?|\}?\s*else\s*\{?|(?:if|for|while|elif|with|def|class)\b.*:|(?:import|from|package|using|use|#include)\s+[\w.*{}:<>/ ]+;?|[{}()\[\];,\s]+|.*[;{}])\s*$")
_MARKERS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|//+!?|#+!?|--+|;+|<!--|\"{3}|'{3}|[rRuU]?\"{3})?\s?|(?:\*+/|-->|\"{3}|'{3})\s*$")
_MARKUP = re.compile(r"<[/!]?[A-Za-z][^<>]*>|\{@\w+[^{}]*\}|&\w+;|```\w*|[`*_~]{1,3}(?=\w)|(?<=\w)[`*_~]{1,3}")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_UNSPACED = regex.compile(r"\p{Thai}|\p{Han}|\p{Hiragana}|\p{Katakana}|\p{Lao}|\p{Khmer}|\p{Myanmar}")
_NAME_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_A-Za-z]+")


def _name_forms(name: str | None) -> set[str]:
    """The words of a name with the endings they take in a sentence."""
    last = re.split(r"[.#:]", name or "")[-1]
    forms = {last.lower(), last.replace("_", "").lower()}
    for part in _NAME_PART.findall(last):
        w = part.lower()
        stem = w.rstrip("e")
        forms |= {w, w + "s", w + "es", w + "ed", w + "d", w + "ing", stem + "ing", stem + "ed", stem + "es", w[:-1] + "ies", w[:-1] + "ied", w + w[-1] + "ing", w + w[-1] + "ed"}
    return forms


def telling_words(documentation: str | None, name: str | None) -> float:
    """Words of a documentation that say something, beyond markers, markup, tags and the function's own name."""
    if not documentation:
        return 0.0
    own = _name_forms(name)
    count = 0.0
    for raw in re.split(r"\r\n|\r|\n", documentation):
        line = raw
        for _ in range(3):
            line = _MARKERS.sub("", line)
        line = line.strip()
        if not line or line[0] in "@:":
            continue
        bare = _MARKUP.sub(" ", line).strip()
        plain = bare.strip(" \t.…!?,;:-–—=*#~<>[]{}|/\\\"'").lower()
        if not plain or plain in PLACEHOLDERS or plain.strip("()") in PLACEHOLDERS:
            continue
        if _PLACEHOLDER_START.search(bare) or _DIRECTIVE.match(bare) or _LICENCE.search(bare) or _CODE.match(bare):
            continue
        if re.fullmatch(r"[\w.$]+\(\)(?:\s+(?:method|function))?\.?", bare):
            continue
        for w in _WORD.findall(bare):
            if _UNSPACED.search(w):
                count += len(w) / UNSPACED_WORD
            elif w.lower() not in own:
                count += 1
    return count


def is_callable(signature: str | None) -> bool:
    """A signature of a function or method; blank ones and those of classes are none."""
    return bool(signature and signature.strip()) and not _CLASS.match(signature)


def latest_answers(why_answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(location, signature, documentation) of the newest answer on each location.

    Ties of answered_at take the greater answer_id, a null time is the oldest. An answer
    without location lies on that of its symbol; without both it answers nothing.
    """
    rows = pick(why_answers, "answer_id", "symbol", "location", "signature", "documentation", "answered_at")
    placed = nodes.select(F.col("uid").alias("symbol"), F.col("location").alias("symbol_location")).dropDuplicates(["symbol"])
    adrift = rows.where("location is null and symbol is not null").join(placed, "symbol").withColumn("location", F.col("symbol_location")).select(rows.columns)
    located = rows.where("location is not null").withColumn("location", normal_path(F.col("location")))
    return (
        located.unionByName(adrift)
        .groupBy("location")
        .agg(F.max(F.struct("answered_at", "answer_id", "signature", "documentation")).alias("r"))
        .select("location", "r.signature", "r.documentation")
    )


def function_pairs(nodes: DataFrame, why_answers: DataFrame, discovered: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each function with a telling documentation.

    Out: uid, name, path, lang, signature, documentation, comment, code, captured. Where the
    recursive pattern captures the function in its file (``captured``), the code is its signature
    and body and the comment what stands above; else (sources that do not parse, lines that no
    longer fit) the code is the lines of the node, null where the file is unknown. Repeated nodes
    are one, the greatest row of a uid; a path found in several repositories takes the content
    modified last. Nodes without path or line, classes, and functions whose newest answer lacks
    a signature or says nothing are left out.
    """
    symbols = pick(nodes, "uid", "kind", "name", "path", "line_start", "line_end", "lang").where(
        "kind = 'Symbol' and uid is not null and path is not null and line_start is not null"
    )
    symbols = symbols.groupBy("uid").agg(F.max(F.struct("path", "line_start", "line_end", "name", "lang")).alias("n")).select("uid", "n.*")
    symbols = symbols.withColumn("path", normal_path(F.col("path")))
    symbols = symbols.withColumn("location", F.concat_ws(":", "path", F.col("line_start").cast("string")))
    answered = symbols.join(latest_answers(why_answers, symbols), "location").where("signature is not null and documentation is not null").drop("location")
    grouped = answered.groupBy("path", F.floor(F.col("line_start") / CHUNK_LINES).alias("chunk")).agg(
        F.collect_list(F.struct("uid", "name", "lang", "line_start", "line_end", "signature", "documentation")).alias("functions")
    )
    sources = pick(discovered, "path", "mtime", "lang", "content").where("path is not null and content is not null")
    sources = sources.groupBy(normal_path(F.col("path")).alias("path")).agg(F.max(F.struct("mtime", "content", "lang")).alias("s"))
    joined = grouped.join(sources, "path", "left").select("path", "functions", F.col("s.content").alias("content"), F.col("s.lang").alias("file_lang"))
    names = ["uid", "name", "path", "lang", "signature", "documentation", "comment", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, functions, content, file_lang in zip(*(c.to_pylist() for c in batch.columns)):
                source = Source(content) if content is not None else None
                for f in functions:
                    if not is_callable(f["signature"]) or telling_words(f["documentation"], f["name"]) < min_words:
                        continue
                    comment = code = match = None
                    if source is not None:
                        match = capture(source, file_lang or f["lang"], f["line_start"], f["line_end"])
                        if match:
                            comment, code = match[0] or None, f"{match[1]} {match[2].rstrip()}" if match[2].startswith("{") else f"{match[1]}{match[2].rstrip()}"
                        else:
                            first, last = max(1, f["line_start"]), min(len(source.starts), max(f["line_start"], f["line_end"] or 0))
                            code = source.text[source.starts[first - 1] : source.end(last - 1)] or None if first <= last else None
                    rows.append((f["uid"], f["name"], path, f["lang"], f["signature"], f["documentation"], comment, code, match is not None))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))), pa.array([r[-1] for r in rows], pa.bool_())], [*names, "captured"])

    return joined.mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", captured boolean")


def captured(nodes: DataFrame, why_answers: DataFrame, discovered: DataFrame) -> DataFrame:
    """For each language of the nodes: documented functions, those the pattern captured, and their share."""
    counted = function_pairs(nodes, why_answers, discovered).groupBy("lang").agg(F.count(F.lit(1)).alias("functions"), F.count_if("captured").alias("captured"))
    return counted.withColumn("captured_share", F.round(F.col("captured") / F.col("functions"), 6))


def found(nodes: DataFrame, why_answers: DataFrame, discovered: DataFrame) -> DataFrame:
    """(uid) of the functions that come out with a telling documentation."""
    return function_pairs(nodes, why_answers, discovered).select("uid")
