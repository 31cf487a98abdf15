"""Extraction: symbols, calls, imports, sections, entities and table access from files."""

from __future__ import annotations

import ast
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import text as T
from quarrylens.runtime import pick

# How declarations begin, by language, for sources read by pattern.
DECLARATIONS = {
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?\s+(?P<a>[\w$]+)|(?:abstract\s+)?class\s+(?P<b>[\w$]+)|(?:const|let|var)\s+(?P<c>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\(|[\w$]+\s*=>|function))",
    "java": r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?:(?:class|interface|enum|record)\s+(?P<a>\w+)|[\w<>\[\], .]+\s+(?P<b>\w+)\s*\([^;]*\)\s*(?:throws [\w, .]+)?\{)",
    "go": r"^\s*(?:func\s+(?:\([^)]*\)\s*)?(?P<a>\w+)|type\s+(?P<b>\w+))",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn\s+(?P<a>\w+)|(?:struct|enum|trait)\s+(?P<b>\w+))",
    "kotlin": r"^\s*(?:\w+\s+)*?(?:fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(?P<a>\w+)|(?:class|interface|object)\s+(?P<b>\w+))",
    "php": r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*(?:function\s+&?(?P<a>\w+)|(?:class|interface|trait|enum)\s+(?P<b>\w+))",
    "ruby": r"^\s*(?:def\s+(?:self\.)?(?P<a>\w+[?!]?)|(?:class|module)\s+(?P<b>[\w:]+))",
    "cpp": r"^\s*(?:(?:class|struct)\s+(?P<a>\w+)|[\w:<>*&\s]+?\s[*&]?(?P<b>[\w:~]+)\s*\([^;]*\)\s*(?:const\s*)?\{)",
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
DECLARATIONS["csharp"] = DECLARATIONS["java"]
_CALL = re.compile(r"\b([A-Za-z_$][\w$]*)\s*\(")
# Words before a bracket that call nothing.
NOT_CALLS = set("if for while switch catch return function def class new match elif with and or not in print super this sizeof typeof await fn func fun".split())


def _python(content: str) -> list[tuple]:
    """(name, kind, start, end, bases, calls, doc) of each declaration."""
    out = []

    def walk(node: ast.AST, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}{child.name}"
                called = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(child) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))})
                bases = [b.id if isinstance(b, ast.Name) else b.attr for b in getattr(child, "bases", []) if isinstance(b, (ast.Name, ast.Attribute))]
                out.append((name, "class" if isinstance(child, ast.ClassDef) else "function", child.lineno, child.end_lineno, bases, called, ast.get_docstring(child)))
                walk(child, f"{name}.")
            else:
                walk(child, prefix)

    walk(ast.parse(content), "")
    return out


def _by_pattern(content: str, lang: str) -> list[tuple]:
    """The same by the first line of declarations; a body ends where its braces close, or before the next declaration."""
    pattern = re.compile(DECLARATIONS.get(lang, r"(?!)"))
    lines = content.splitlines()
    starts = [(i, next(g for g in m.groups() if g)) for i, line in enumerate(lines) if (m := pattern.match(line)) and any(m.groups())]
    out = []
    for k, (i, name) in enumerate(starts):
        depth, end = 0, (starts[k + 1][0] if k + 1 < len(starts) else len(lines)) - 1
        for j in range(i, len(lines)):
            bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|//.*", "", lines[j])
            depth += bare.count("{") - bare.count("}")
            if depth <= 0 and ("}" in bare or bare.rstrip().endswith(";")):
                end = j
                break
        body = "\n".join(lines[i : end + 1])
        kind = "class" if re.search(r"\b(?:class|interface|enum|record|struct|trait|object|module|type)\s+\w", lines[i]) else "function"
        bases = re.findall(r"\b(?:extends|implements)\s+([\w$]+)", lines[i])
        called = sorted(set(_CALL.findall(body)) - NOT_CALLS - {name})
        out.append((name, kind, i + 1, end + 1, bases, called, None))
    return out


def declarations(content: str | None, lang: str | None) -> list[tuple]:
    """Declarations of a file; a Python file that does not parse, and other languages, are read by pattern."""
    if not content:
        return []
    found = None
    if lang == "python":
        try:
            found = _python(content)
        except (SyntaxError, ValueError, RecursionError):
            pass
    found = _by_pattern(content, lang or "") if found is None else found
    seen: dict[str, int] = {}
    out = []
    for name, *rest in found:
        seen[name] = seen.get(name, 0) + 1
        out.append((name if seen[name] == 1 else f"{name}~{seen[name]}", *rest))
    return out


DECLARED = "repo string, path string, lang string, name string, what string, line_start int, line_end int, bases array<string>, calls array<string>, doc string"


def symbols(files: DataFrame) -> DataFrame:
    """The declarations of files (repo, path, lang, content), each name once in its file (``~2`` for a second)."""
    rows = pick(files, "repo", "path", "lang", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.list_(pa.string())] * 2 + [pa.string()]
        names = [c.split()[0] for c in DECLARED.split(", ")]
        for batch in batches:
            out = [(r, p, g, *d) for r, p, g, c in zip(*(x.to_pylist() for x in batch.columns)) for d in declarations(c, g)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], types[k]) for k in range(len(names))], names)

    return rows.mapInArrow(run, DECLARED)


def symbol_uid(path, name):
    return F.concat(F.lit("sym:"), path, F.lit("#"), name)


def references(declared: DataFrame) -> DataFrame:
    """(from_uid, name, path, lang, kind) of what declarations call and inherit."""
    base = declared.select(symbol_uid(F.col("path"), F.col("name")).alias("from_uid"), "path", "lang", "calls", "bases")
    calls = base.select("from_uid", F.explode("calls").alias("name"), "path", "lang", F.lit("CALLS").alias("kind"))
    return calls.unionByName(base.select("from_uid", F.explode("bases").alias("name"), "path", "lang", F.lit("INHERITS").alias("kind")))


def import_lines(files: DataFrame) -> DataFrame:
    """(path, module) of the import statements of files."""
    lines = files.where("content is not null").select("path", F.explode(F.split("content", r"\r?\n")).alias("line")).where(F.col("line").rlike(r"^\s*(import|from|use|using)\b"))
    cleaned = F.regexp_replace(F.trim("line"), r"^(use|using)\s", "import ")
    return lines.select("path", F.explode(T.import_modules(cleaned)).alias("module")).distinct()


def markdown_sections(documents: DataFrame, key: str, body: str) -> DataFrame:
    """(key, slug, title, level, line_no, body): a section for each heading, headings within fences aside.

    Slugs join those of the headings above by dots; a slug met again gets ``~2``. Text
    before the first heading is the section ``section`` of level 0. One document is one
    group: its lines never leave the row they came from.
    """

    def split(text: str | None) -> list[tuple]:
        out: list[list] = []
        trail: list[tuple[int, str]] = []
        fenced, start, buffer, title, level = False, 1, [], "", 0
        counts: dict[str, int] = {}

        def close() -> None:
            joined = "\n".join(buffer).strip()
            if title or joined:
                slug = ".".join(s for _, s in trail) or "section"
                counts[slug] = counts.get(slug, 0) + 1
                out.append([slug if counts[slug] == 1 else f"{slug}~{counts[slug]}", title, level, start, joined])

        for number, line in enumerate((text or "").splitlines(), 1):
            if line.lstrip().startswith(("```", "~~~")):
                fenced = not fenced
            m = None if fenced else re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)
            if m:
                close()
                level, title, start, buffer = len(m[1]), m[2], number, []
                slug = re.sub(r"[^\w]+|_+", "-", title.lower()).strip("-") or "section"
                trail = [t for t in trail if t[0] < level] + [(level, slug)]
            else:
                buffer.append(line)
        close()
        return out

    rows = documents.select(key, body)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, *s) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in split(t)]
            types = [batch.column(0).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], types[i]) for i in range(6)], [key, "slug", "title", "level", "line_no", "body"])

    return rows.mapInArrow(run, f"`{key}` {kind}, slug string, title string, level int, line_no int, body string")


# Field types that only lay out a form.
LAYOUT_FIELDS = {"Section Break", "Column Break", "Tab Break", "HTML", "Button", "Heading", "Fold"}


def entity(content: str | None) -> dict | None:
    """An entity definition in JSON: name, table ``tab<name>`` and its fields (machine name, label) without layout."""
    try:
        data = json.loads(content or "")
    except ValueError:
        return None
    if not isinstance(data, dict) or not isinstance(data.get("fields"), list) or not data.get("name"):
        return None
    fields = [(f["fieldname"], f.get("label") or f["fieldname"]) for f in data["fields"] if isinstance(f, dict) and f.get("fieldname") and f.get("fieldtype") not in LAYOUT_FIELDS]
    return {"name": data["name"], "table": f"tab{data['name']}".lower(), "fields": fields}


def mapping(content: str | None) -> list[dict]:
    """Classes of an object-relational mapping in XML: name, table and (property, column) pairs."""
    try:
        root = ET.fromstring(content or "")
    except ET.ParseError:
        return []
    out = []
    for c in root.iter("class"):
        fields = [(p.get("name"), p.get("column") or p.get("name")) for p in c if p.tag in ("id", "property", "many-to-one", "key-property") and p.get("name")]
        out.append({"name": (c.get("name") or "").rsplit(".", 1)[-1], "table": (c.get("table") or c.get("name") or "").rsplit(".", 1)[-1].lower(), "fields": fields})
    return out


def table_access(files: DataFrame) -> DataFrame:
    """(path, line, table, access) of the SQL in files: whole texts for sql files, single lines elsewhere.

    files: path, lang, content.
    """
    whole = files.where("lang = 'sql' and content is not null").select("path", F.lit(1).alias("line"), F.explode(T.table_refs("content")).alias("r"))
    lines = files.where("lang <> 'sql' and content is not null").select("path", F.posexplode(F.split("content", r"\r?\n")).alias("at", "text")).where(T.looks_like_sql("text"))
    part = lines.select("path", (F.col("at") + 1).alias("line"), F.explode(T.table_refs("text")).alias("r"))
    return whole.unionByName(part).select("path", "line", "r.table", "r.access").distinct()


def file_nodes(files: DataFrame) -> DataFrame:
    """A node for each file; its search text is the path with its signs blanked."""
    return files.select(
        F.concat(F.lit("file:"), "path").alias("uid"), F.lit("File").alias("kind"), F.substring_index("path", "/", -1).alias("name"), "path", "lang", F.translate("path", "/_-.", "    ").alias("search_text")
    ).distinct()


def without_nested(spans: DataFrame) -> DataFrame:
    """(uid, path, line): the lines of each span that lie in no span inside it."""
    lines = spans.select("uid", "path", "line_start", "line_end", F.explode(F.sequence("line_start", "line_end")).alias("line"))
    order = Window.partitionBy("path", "line").orderBy((F.col("line_end") - F.col("line_start")), "uid")
    return lines.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("uid", "path", "line")
