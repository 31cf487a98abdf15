"""Rich documents as text with Markdown headings."""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that are decoded.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def html_to_markdown(html: Column) -> Column:
    """Text of a page: no scripts, styles, heads and drawings; ``#`` for headings, line ends for blocks."""
    t = html
    for tag in ("script", "style", "head", "svg"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    for k in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{k}\b[^>]*>\s*", "\n" + "#" * k + " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|tr|ul|ol|table|section|article|h[1-6]|blockquote|pre)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, sign in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attribute(node: ET.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _docx(z: zipfile.ZipFile) -> str:
    out = []
    for p in (n for n in ET.fromstring(z.read("word/document.xml")).iter() if _local(n.tag) == "p"):
        text = "".join(n.text or "" for n in p.iter() if _local(n.tag) == "t")
        style = next((_attribute(n, "val") or "" for n in p.iter() if _local(n.tag) == "pStyle"), "")
        level = re.match(r"(?i)heading\s*(\d)", style)
        out.append(f"{'#' * int(level[1])} {text}" if level and text else text)
    return "\n".join(x for x in out if x)


def _odt(z: zipfile.ZipFile) -> str:
    out = []
    for n in ET.fromstring(z.read("content.xml")).iter():
        if _local(n.tag) in ("h", "p"):
            text = "".join(n.itertext())
            out.append(f"{'#' * int(_attribute(n, 'outline-level') or 1)} {text}" if _local(n.tag) == "h" and text else text)
    return "\n".join(x for x in out if x)


def _xlsx(z: zipfile.ZipFile) -> str:
    shared = ["".join(s.itertext()) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        out.append(f"# {name.rsplit('/', 1)[-1].removesuffix('.xml')}")
        for row in (n for n in ET.fromstring(z.read(name)).iter() if _local(n.tag) == "row"):
            cells = []
            for c in row:
                value = next((v.text or "" for v in c if _local(v.tag) == "v"), "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if any(cells):
                out.append("| " + " | ".join(cells) + " |")
    return "\n".join(out)


def _pptx(z: zipfile.ZipFile) -> str:
    out = []
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0])):
        lines = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in ET.fromstring(z.read(name)).iter() if _local(p.tag) == "p"]
        lines = [x for x in lines if x]
        out += [f"# {lines[0]}", *lines[1:]] if lines else []
    return "\n".join(out)


def packed_to_markdown(content: bytes, kind: str) -> str | None:
    """Text of a docx, odt, xlsx or pptx file; None for broken ones and other kinds."""
    reader = {"docx": _docx, "odt": _odt, "xlsx": _xlsx, "pptx": _pptx}.get(kind)
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return reader(z) if reader else None
    except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError):
        return None


def rtf_to_text(text: str) -> str:
    """Text of a rich-text file without its control words and groups of fonts, colours and styles."""
    t = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), t)
    t = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), t)
    t = re.sub(r"\\(?:par|line|row)\b ?", "\n", t)
    t = re.sub(r"\\tab\b ?", "\t", t)
    t = re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", t)
    return t.strip()
