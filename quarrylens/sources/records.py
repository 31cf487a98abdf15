"""Small text formats: change logs, translations, message bundles, glossaries, results."""

from __future__ import annotations

import csv
import io
import json
import re
import subprocess
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "sha string, authored_ts long, author string, subject string, files array<string>"


def parse_log(text: str) -> list[tuple]:
    """(sha, authored_ts, author, subject, files) from a log framed by NUL.

    A commit is ``sha NUL time NUL author NUL subject`` and then its files, each ended by
    NUL; the next sha follows the last file on its line.
    """
    out: list[tuple] = []
    for part in re.split(r"(?:^|(?<=\x00)|(?<=\n))(?=[0-9a-f]{40}\x00\d+\x00)", text):
        fields = part.split("\x00")
        if len(fields) >= 4 and re.fullmatch(r"[0-9a-f]{40}", fields[0]):
            subject, _, first = fields[3].partition("\n")
            files = [f.strip("\n") for f in [first, *fields[4:]] if f.strip("\n")]
            out.append((fields[0], int(fields[1]), fields[2], subject, files))
    return out


def git_log(spark: SparkSession, root: str, most: int = 20_000) -> DataFrame:
    """Commits of a repository, newest first, as a frame; merges are left out."""
    command = ["git", "-C", root, "log", f"-n{most}", "--no-merges", "--name-only", "-z", "--format=%H%x00%at%x00%an%x00%s"]
    text = subprocess.run(command, capture_output=True, check=True, timeout=60).stdout.decode("utf-8", "replace")
    return spark.createDataFrame(parse_log(text), COMMITS)


def head_sha(root: str) -> str | None:
    run = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, timeout=10)
    return run.stdout.decode().strip() if run.returncode == 0 else None


def translations(text: str | None) -> list[tuple[str, str]]:
    """(source, target) of a header-less CSV: two columns, or the second and third of more; empty and equal pairs dropped."""
    out = []
    for row in csv.reader(io.StringIO(text or "")):
        pair = (row[1], row[2]) if len(row) >= 3 else (row[0], row[1]) if len(row) == 2 else ("", "")
        source, target = pair[0].strip(), pair[1].strip()
        if source and target and source != target:
            out.append((source, target))
    return out


def properties(text: Column) -> Column:
    """Array of struct(key, value) of a properties file: comments dropped, continued lines joined."""
    joined = F.regexp_replace(text, r"\\\r?\n[ \t]*", "")
    lines = F.filter(F.transform(F.split(joined, r"\r?\n"), F.trim), lambda x: (x != "") & ~x.rlike("^[#!]") & x.rlike("[=:]"))
    return F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^=:]*)", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^=:]*[=:](.*)$", 1)).alias("value")))


def glossary(text: str) -> list[dict]:
    """Declared concepts of a glossary: id, labels by language, code and tables."""
    data = tomllib.loads(text)
    return [{"concept": k, "labels": v.get("labels", {}), "code": v.get("code", []), "tables": v.get("tables", [])} for k, v in data.get("concept", data).items() if isinstance(v, dict)]


def render_glossary(concepts: list[dict]) -> str:
    """The text of a glossary that reads back as the same concepts."""
    out = []
    for c in sorted(concepts, key=lambda c: c["concept"]):
        out.append(f"[concept.{json.dumps(c['concept'])}]")
        out.append("labels = { " + ", ".join(f"{json.dumps(k)} = {json.dumps(v, ensure_ascii=False)}" for k, v in sorted(c["labels"].items())) + " }")
        out.append("code = " + json.dumps(sorted(c["code"])))
        out.append("tables = " + json.dumps(sorted(c["tables"])) + "\n")
    return "\n".join(out)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def toon(rows: DataFrame, section: str, most: int = 220) -> str:
    """A bounded section of rows as ``section[N]{columns}:`` and one line of cells for each row."""
    cell = lambda v: re.sub(r"\s+", " ", "" if v is None else str(v)).replace("|", "/")[:most]
    found = rows.collect()
    return "\n".join([f"{section}[{len(found)}]{{{','.join(rows.columns)}}}:", *("  " + "|".join(cell(v) for v in r) for r in found)])


def bodies(root: str, most: int = 20_000, size: int = 600) -> dict[str, str]:
    """Message bodies of the newest commits by sha, up to ``size`` characters; commits without one are left out."""
    run = subprocess.run(["git", "-C", root, "log", f"-n{most}", "--no-merges", "-z", "--format=%H%x01%b"], capture_output=True, check=True, timeout=60)
    pairs = (part.split("\x01", 1) for part in run.stdout.decode("utf-8", "replace").split("\x00") if "\x01" in part)
    return {sha.strip(): body.strip()[:size] for sha, body in pairs if body.strip()}


def line_history(root: str, path: str, start: int, end: int, seconds: float = 1.5) -> list[tuple[str, str]]:
    """(sha, subject) of the commits that touched a range of lines, newest first; none if it takes longer than ``seconds``."""
    command = ["git", "-C", root, "log", f"-L{start},{end}:{path}", "--no-patch", "--format=%H%x00%s"]
    try:
        run = subprocess.run(command, capture_output=True, timeout=seconds)
    except subprocess.TimeoutExpired:
        return []
    lines = run.stdout.decode("utf-8", "replace").splitlines() if run.returncode == 0 else []
    return [tuple(x.split("\x00", 1)) for x in lines if "\x00" in x]


# Three-letter codes of languages by their two-letter codes.
ISO3 = dict(
    pair.split(":")
    for pair in (
        "af:afr ar:ara bg:bul bn:ben bs:bos ca:cat cs:ces cy:cym da:dan de:deu el:ell en:eng eo:epo es:spa et:est eu:eus fa:fas fi:fin fr:fra ga:gle gl:glg gu:guj he:heb hi:hin hr:hrv hu:hun hy:hye id:ind is:isl "
        "it:ita ja:jpn ka:kat kk:kaz km:khm kn:kan ko:kor lo:lao lt:lit lv:lav mk:mkd ml:mal mn:mon mr:mar ms:msa my:mya nb:nob ne:nep nl:nld no:nor pa:pan pl:pol pt:por ro:ron ru:rus si:sin sk:slk sl:slv sq:sqi "
        "sr:srp sv:swe sw:swa ta:tam te:tel th:tha tl:tgl tr:tur uk:ukr ur:urd uz:uzb vi:vie zh:zho"
    ).split()
)


def bundle_locale(path: Column) -> Column:
    """struct(base, lang) of a bundle or translation file: ``messages_de.properties``, ``i18n/vi.csv``; lang is null for the source."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    name = F.substring_index(stem, "/", -1)
    suffix = F.regexp_extract(stem, r"[_\-.]([a-z]{2})(?:[_\-][A-Za-z]{2,4})?$", 1)
    whole = F.regexp_extract(name, r"^([a-z]{2})(?:[_\-][A-Za-z]{2,4})?$", 1)
    code = F.when(whole != "", whole).otherwise(suffix)
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in ISO3.items() for x in pair]), code)
    base = F.when(known.isNull(), stem).when(whole != "", F.regexp_replace(stem, r"/?[^/]*$", "")).otherwise(F.regexp_replace(stem, r"[_\-.][a-z]{2}(?:[_\-][A-Za-z]{2,4})?$", ""))
    return F.struct(base.alias("base"), known.alias("lang"))


def markdown_table(rows: DataFrame, title: str) -> str:
    """A bounded result as a titled table."""
    cell = lambda v: "–" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    body = [f"| {' | '.join(cell(v) for v in r)} |" for r in rows.collect()]
    return "\n".join([f"## {title}", "", f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}", *body, ""])
