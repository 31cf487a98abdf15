"""Generated, minified, vendored and data files among source files.

A multi-pattern automaton looks for generation notices in the comments that open and
close a file; path rules know vendored folders, lockfiles, minified and generated
suffixes; the shape of the code shows minified scripts, tool-made members and data
dumps; equal content in several repositories shows third-party copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.incremental import normal_path
from quarrylens.runtime import cut, pick, salted_join

# Phrases of generation notices, in lower case.
NOTICES = [
    "@generated", "<auto-generated>", "<autogenerated>", "code generated by", "this code was generated", "this file was generated",
    "this file is generated", "file is automatically generated", "was automatically generated", "was automatically created", "automatically created by",
    "automatically generated by", "auto-generated by", "auto-generated file", "autogenerated file", "autogenerated by", "auto generated by",
    "generated automatically", "generated by the protocol buffer compiler", "generated by the schema compiler", "by the schema compiler",
    "changes will be lost", "changes will be overwritten", "edit the schema instead",
    "machine-made from", "machine generated", "machine-generated", "automatisch erzeugt", "automatisch generiert", "fichier produit par", "fichier généré",
    "généré automatiquement", "generado automáticamente", "gerado automaticamente", "được tạo tự động", "自动生成", "自動生成", "자동 생성",
]
# Phrases that forbid to edit; they are notices where they speak of the file as a whole.
FORBIDDINGS = [
    "do not edit", "do not modify", "don't edit", "nicht von hand bearbeiten", "nicht bearbeiten", "nicht ändern", "ne pas modifier", "ne pas éditer",
    "no modificar", "no editar", "não editar", "não modificar", "không sửa",
]
# Phrases that show that such words are only talked about.
DENIALS = [
    "used to be generated", "no longer generated", "not generated", "kept by hand", "maintained by hand", "edited by hand", "written by hand",
    "method stub", "previously generated", "was once generated", "formerly generated",
]
# Folders of third-party code whose names are also words of other trades.
VENDOR_FOLDERS = ["vendor", "vendors", "vendored", "external", "externals", "extern", "deps", "pods", "carthage", "venv", ".venv", "3rdparty"]
# Those that mean third-party code wherever they stand.
VENDOR_ANYWHERE = [
    "node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "site-packages", "dist-packages", "godeps",
]
# Widely copied libraries.
LIBRARIES = [
    "angular", "asio", "axios", "backbone", "boost", "bootstrap", "bzip2", "catch2", "chartjs", "codemirror", "curl", "d3", "datatables", "doctrine", "dojo", "eigen", "ember", "expat", "ffmpeg",
    "fmt", "fontawesome", "freetype", "glfw", "glm", "googletest", "grpc", "gson", "gtest", "guava", "guzzle", "handlebars", "imgui", "jackson", "jquery", "jquery-ui", "jsoncpp", "junit", "knockout",
    "laravel", "leaflet", "libpng", "libuv", "lodash", "log4j", "lua", "lz4", "mbedtls", "minizip", "moment", "monolog", "mootools", "nlohmann", "openssl", "phpunit", "popper", "protobuf", "prototype",
    "pugixml", "react", "redis", "requests", "requirejs", "rapidjson", "select2", "six", "spdlog", "sqlite", "sqlite3", "stb", "symfony", "three", "tinymce", "tinyxml2", "twig", "underscore",
    "urllib3", "vue", "xxhash", "yaml-cpp", "zlib", "zstd",
]
_VERSIONED = re.compile(r"^[a-z][\w.+]*-v?\d+(?:\.\d+)+$")
# Names of lockfiles.
LOCKFILES = [
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "gemfile.lock", "cargo.lock", "poetry.lock",
    "pipfile.lock", "go.sum", "packages.lock.json", "gradle.lockfile", "mix.lock", "flake.lock", "uv.lock",
]
# Endings of minified, bundled and generated files.
TOOL_SUFFIX = re.compile(
    r"(?:[.\-]min\.(?:js|mjs|cjs|ts|css)|\.bundle\.(?:js|ts)|\.chunk\.js|\.packed\.js|\.pb\.go|_pb2(?:_grpc)?\.py|\.pb\.(?:cc|h)|_grpc\.pb\.go"
    r"|\.g(?:enerated)?\.(?:ts|js|cs|dart|kt|java|go|rs|py|php|sql)|\.designer\.cs|\.gen\.go|_generated\.(?:go|rs|ts|py))$",
    re.I,
)
TOOL_FOLDERS = {"gen", "generated", "autogen", "auto-generated", "__generated__", "stubs", "codegen"}


def _automaton(phrases: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, p)
    a.make_automaton()
    return a


_notices, _denials, _forbiddings = _automaton(NOTICES), _automaton(DENIALS), _automaton(FORBIDDINGS)
#: What may follow a phrase that forbids to edit, and stand before it, where it speaks of the file.
_WHOLE_FILE = re.compile(r"\W*(?:(?:this|the|generated) (?:file|code|source|class|module)|it\b|manually|by hand|directly|or modify|or edit|anything (?:here|in this file)|,|\.|!|$|\*/|-->|;)")
_HASH, _DASH, _SLASH = r"#[^\n]*", r"--[^\n]*", r"//[^\n]*"
_BLOCK = r"/\*(?s:.*?)(?:\*/|\Z)"
_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_LONG = r"\"\"\"(?s:.*?)(?:\"\"\"|\Z)|'''(?s:.*?)(?:'''|\Z)"


def _scanner(comments: list[str], strings: list[str]) -> tuple[re.Pattern, re.Pattern]:
    comment = "|".join(comments)
    return re.compile(f"(?P<c>{comment})|(?P<s>{'|'.join(strings)})"), re.compile(rf"(?:\s|<\?php\b|<\?|\#![^\n]*|{comment})*")


_C_LIKE = _scanner([_SLASH, _BLOCK], [_STRING, r"`(?:[^`\\]|\\.)*`"])
_SCANNERS = {
    "python": _scanner([_HASH], [_LONG, _STRING]),
    "sql": _scanner([_DASH, _BLOCK], [r"'(?:[^']|'')*'", r'"[^"\n]*"']),
    "php": _scanner([_SLASH, _BLOCK, r"#(?!\[)[^\n]*"], [_STRING]),
    "kotlin": _scanner([_SLASH, _BLOCK], [_LONG, _STRING]),
    "java": _C_LIKE, "typescript": _C_LIKE, "javascript": _C_LIKE, "go": _C_LIKE, "csharp": _C_LIKE, "rust": _scanner([_SLASH, _BLOCK], [r'"(?:[^"\\]|\\.)*"']),
}


def split_comments(content: str, lang: str | None) -> tuple[str, str, str]:
    """(opening comments, code without comments, closing comments) of a file."""
    scan, opening = _SCANNERS.get((lang or "").lower(), _C_LIKE)
    head_end = opening.match(content).end()
    code, at, last_code = [], head_end, head_end
    for m in scan.finditer(content, head_end):
        if m.lastgroup == "c":
            code.append(content[at : m.start()])
            at = m.end()
            if code[-1].strip():
                last_code = m.start()
        elif m.lastgroup == "s":
            last_code = m.end()
    code.append(content[at:])
    if code[-1].strip():
        last_code = len(content)
    return content[:head_end], "".join(code), content[last_code:]


def notice(comments: str) -> bool:
    """Whether a line of these comments is a generation notice that no other phrase denies."""
    for line in comments.lower().splitlines():
        told = any(True for _ in _notices.iter(line)) or any(_WHOLE_FILE.match(line, end + 1) for end, _ in _forbiddings.iter(line))
        if told and not any(True for _ in _denials.iter(line)):
            return True
    return False


_BANNER = re.compile(r"\A\W*[\w.@/-]+ v?\d+\.\d+(?:\.\d+)*\W*$", re.M)
_OWNER = re.compile(r"(?:\(c\)|©|copyright)[^\n]{0,80}\b(?:authors|contributors|foundation|project)\b", re.I)
_LICENCE = re.compile(r"\b(?:released|licensed|distributed) under\b|\bSPDX-License-Identifier\b", re.I)


def foreign_banner(comments: str) -> bool:
    """A header that names another project, its version and its authors or licence."""
    return bool(_BANNER.search(comments) and _OWNER.search(comments) and _LICENCE.search(comments))


def _packaged(folders: list[str], name: str, at: int) -> bool:
    """Whether what lies in the folder at ``at`` is a package: at the top of a repository one in folders of its own,
    further down one with the name or version of a library, or whose file is called like its folder."""
    below = folders[at + 1 :]
    if not below:
        return False
    if at == 0 and (len(below) >= 2 or folders[0].startswith("vendor")):
        return True
    return below[0] in LIBRARIES or bool(_VERSIONED.match(below[0])) or below[-1] == name.split(".")[0]


def path_rule(path: str | None) -> str | None:
    """``vendored`` or ``generated`` by place or name alone."""
    if not path:
        return None
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    folders = [p.lower() for p in parts[:-1]]
    if any(f in VENDOR_ANYWHERE for f in folders) or any(_packaged(folders, parts[-1].lower(), k) for k, f in enumerate(folders) if f in VENDOR_FOLDERS):
        return "vendored"
    if parts and (parts[-1].lower() in LOCKFILES or TOOL_SUFFIX.search(parts[-1])):
        return "generated"
    return None


_DIGITS = re.compile(r"\d+")
_WORDY = re.compile(r"\w")
_DATA = re.compile(r"\"[^\"\s]{8,}\"|'[^'\s]{8,}'|[\"']0x[0-9a-fA-F]+[\"']|(?<![\w.])-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)(?![\w.])")
_PUNCTUATION = re.compile(r"[\s,;\[\](){}]+")
MIN_MEMBERS, MIN_DATA = 8, 300


def shape(code: str, lang: str | None, tool_folder: bool = False) -> str | None:
    """``minified``, ``generated`` or ``data`` by the look of the code without comments.

    Minified: scripts of long lines with hardly any blanks between short names. Generated:
    nearly all lines repeat others but for their numbers. Data: nearly all characters lie
    in number lists and strings without blanks.
    """
    lines = [x for x in code.splitlines() if _WORDY.search(x)]
    if not lines:
        return None
    dense = _PUNCTUATION.sub("", code)
    if len(code) >= MIN_DATA and sum(len(_PUNCTUATION.sub("", m)) for m in _DATA.findall(code)) >= 0.7 * max(1, len(dense)):
        return "data"
    if (lang or "").lower() in ("javascript", "typescript", "css"):
        size = sum(map(len, lines))
        if size >= 200 and size / len(lines) >= 110 and sum(map(str.isspace, code)) <= 0.12 * len(code):
            return "minified"
    masked = [_DIGITS.sub("0", x.strip()) for x in lines]
    numbered = sum(a != b.strip() for a, b in zip(masked, lines))
    if len(lines) >= (MIN_MEMBERS // 2 if tool_folder else MIN_MEMBERS) and len(set(masked)) <= 0.4 * len(masked) and numbered >= 0.4 * len(lines):
        return "generated"
    return None


def judge(path: str | None, lang: str | None, content: str | None) -> str | None:
    """Why a file is not hand-written: vendored, generated, minified or data; None if it is, or is without code.

    A null content is judged by its path alone; an empty one, and one of comments only, is
    no case wherever it stands.
    """
    return _looked_at(path, lang, content)[1]


def _looked_at(path: str | None, lang: str | None, content: str | None) -> tuple[bool, str | None]:
    """(whether the file has code, what ``judge`` says)."""
    if content is None:
        return False, path_rule(path)
    head, code, tail = split_comments(content, lang)
    if not _WORDY.search(code):
        return False, None
    if rule := path_rule(path):
        return True, rule
    if notice(head) or notice(tail):
        return True, "generated"
    if foreign_banner(head):
        return True, "vendored"
    folders = set((path or "").replace("\\", "/").lower().split("/")[:-1])
    return True, shape(code, lang, bool(folders & TOOL_FOLDERS))


def _judged(discovered: DataFrame) -> DataFrame:
    rows = pick(discovered, "file_id", "repo", "path", "lang", "hash", "content")
    rows = rows.withColumn("path", normal_path(F.col("path"))).withColumn("text_key", F.sha2(F.regexp_replace("content", "\r\n?", "\n"), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, langs, texts = (batch.column(k).to_pylist() for k in (2, 3, 5))
            coded, kinds = zip(*[_looked_at(p, g, t) for p, g, t in zip(paths, langs, texts)]) if texts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in (0, 1, 2, 3, 4, 6)), pa.array(coded, pa.bool_()), pa.array(kinds, pa.string())],
                ["file_id", "repo", "path", "lang", "hash", "text_key", "coded", "kind"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("file_id", "repo", "path", "lang", "hash", "text_key")) + ", coded boolean, kind string")


def classify(discovered: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, repo, path, lang, kind): every row with its kind, null for hand-written files.

    A file with code whose content or hash also occurs in another repository, among the
    discovered files or in any listing of ``files``, is ``copied`` if nothing else is found.
    """
    judged = cut(_judged(discovered))
    listed = pick(files, "repo", "hash").select("repo", F.lower("hash").alias("key"))
    keys = (
        judged.where("coded")
        .select("repo", F.explode(F.array(F.lower("hash"), "text_key")).alias("key"))
        .unionByName(listed)
        .where("key is not null and repo is not null")
        .groupBy("key")
        .agg(F.min("repo").alias("low"), F.max("repo").alias("high"))
        .where("low <> high")
        .select("key")
    )
    keyed = judged.where("coded and kind is null").select("file_id", F.explode(F.array_distinct(F.array(F.lower("hash"), "text_key"))).alias("key")).where("key is not null")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("__rows")).crossJoin(F.broadcast(keyed.agg(F.count(F.lit(1)).alias("__total"))))
    copied = salted_join(keyed, keys, ["key"], sizes, F.col("__total"), ["file_id"])
    copies = copied.select("file_id").distinct().withColumn("copied", F.lit("copied"))
    return judged.join(copies, "file_id", "left").select(
        "file_id", "repo", "path", "lang", F.coalesce("kind", F.when(F.col("coded"), F.col("copied"))).alias("kind")
    )


def found(discovered: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id) of the files that nobody of their repository wrote by hand."""
    return classify(discovered, files).where("kind is not null and file_id is not null").select("file_id").distinct()
