"""Token streams of source files, for the grammars.

A token is (kinds, after_newline, offset): the terminals it may stand for, whether a line
ends before it, and where it stands. What no rule of a language reads becomes one ERROR.
"""

from __future__ import annotations

import re

import regex

from quarrylens.llm.syntax.engine import ERROR, Grammar

Token = tuple[tuple[str, ...], bool, int]


class Lexer:
    """Blanks and comments, token classes, words and signs of a language, in this order.

    Tokens that only a recursive pattern reads (``nested``, and comments that nest) begin with
    ``trigger``; all others are read by a plain pattern without them.
    """

    ident = r"[^\W\d]\w*"
    blank = r"\s+|//[^\n]*|/\*(?s:.*?)\*/"
    plain_blank = ""
    classes: dict[str, str] = {}
    nested: tuple[str, ...] = ()
    trigger = ""
    define = ""
    fold = False

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.pattern = regex.compile(self._alternatives(self.blank, self.classes) + self.define)
        simple = {k: v for k, v in self.classes.items() if k not in self.nested}
        start = f"(?!{self.trigger})" if self.trigger else ""
        self.plain = re.compile(rf"[ \t]*{start}(?:{self._alternatives(self.plain_blank or self.blank, simple)})")
        self.kinds: dict[str, tuple[str, ...]] = {w: (w,) for w in grammar.reserved} | {w: (w, "IDENT") for w in grammar.soft}
        self.names = {k: (k,) for k in self.classes}
        self.marks: dict[str, tuple[str, ...]] = {}

    def _alternatives(self, blank: str, classes: dict[str, str]) -> str:
        parts = [f"(?P<blank>{blank})", *(f"(?P<{k}>{v})" for k, v in classes.items()), f"(?P<word>{self.ident})", f"(?P<sign>{self.grammar.signs})"]
        return "|".join(parts)

    def word(self, text: str) -> tuple[str, ...]:
        return self.kinds.get(text.lower() if self.fold else text, IDENT)

    def mark(self, text: str) -> tuple[str, ...]:
        return self.marks.setdefault(text, (text,))

    def tokens(self, text: str) -> list[Token]:
        out: list[Token] = []
        at, fresh, size = 0, True, len(text)
        names, kinds, fold, marks = self.names, self.kinds, self.fold, self.marks
        while at < size:
            for m in self.plain.finditer(text, at):
                if m.start() != at:
                    break
                at, kind = m.end(), m.lastgroup
                if kind == "blank":
                    fresh = fresh or "\n" in m[0]
                    continue
                value = m[kind]
                if kind == "word":
                    own = kinds.get(value.lower() if fold else value, IDENT)
                elif kind == "sign":
                    own = marks.get(value) or self.mark(value)
                else:
                    own = names[kind]
                out.append((own, fresh, m.start(kind)))
                fresh = False
            if at >= size:
                break
            m = self.pattern.match(text, at)
            if not m or not m[0]:
                out.append(((ERROR,), fresh, at))
                break
            kind = m.lastgroup
            at = m.end()
            if kind == "blank":
                fresh = fresh or "\n" in m[0]
                continue
            value = m[kind]
            out.append((self.word(value) if kind == "word" else self.mark(value) if kind == "sign" else names[kind], fresh, m.start(kind)))
            fresh = False
        return out


IDENT = ("IDENT",)
_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?|\d[\d_]*\.(?![.\w])(?:[eE][+-]?\d[\d_]*)?|\d[\d_]*(?:[eE][+-]?\d[\d_]*)?)"
_STRING = r'"(?!"")(?:[^"\\\n]|\\.)*"'
_CHAR = r"'(?:[^'\\\n]|\\(?:u\{?[\da-fA-F]+\}?|x[\da-fA-F]+|[0-7]{1,3}|.))'"


class JavaLexer(Lexer):
    ident = r"[^\W\d]\w*|[$_][\w$]*|[^\W\d][\w$]*"
    classes = {"STRING": r'"""[ \t\f]*\r?\n(?s:(?:[^\\]|\\.)*?)"""|' + _STRING, "CHAR": _CHAR, "NUMBER": _NUMBER + r"[lLfFdD]?(?!\w)"}
    ident = r"(?:[^\W\d]|\$)[\w$]*"


class GoLexer(Lexer):
    classes = {"STRING": _STRING + r"|`[^`]*`", "CHAR": r"'(?:[^'\\\n]|\\(?:[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|.))'", "NUMBER": _NUMBER + r"(?:p[+-]?\d+)?i?(?!\w)"}
    ENDS = {"IDENT", "STRING", "CHAR", "NUMBER", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}

    def tokens(self, text: str) -> list[Token]:
        out: list[Token] = []
        for t in super().tokens(text):
            if t[1] and out and out[-1][0][-1] in self.ENDS:
                out.append(((";",), False, t[2]))
            out.append(t)
        if out and out[-1][0][-1] in self.ENDS:
            out.append(((";",), False, len(text)))
        return out


class RustLexer(Lexer):
    blank = r"\s+|//[^\n]*|(?P<nest>/\*(?:[^*/]|\*(?!/)|/(?!\*)|(?&nest))*\*/)"
    plain_blank = r"\s+|//[^\n]*"
    nested, trigger = ("STRING", "CHAR"), r"/\*|[bcr]{0,2}[\"'#]"
    ident = r"(?:r#)?[^\W\d]\w*"
    classes = {
        "STRING": r'(?:b|c)?r(?P<rs>#*)"(?s:.*?)"(?P=rs)|(?:b|c)?"(?s:[^"\\]|\\.)*"',
        "CHAR": r"b?'(?:[^'\\\n]|\\(?:u\{[\da-fA-F_]+\}|x[\da-fA-F]{2}|.))'",
        "LIFETIME": r"'[^\W\d]\w*",
        "NUMBER": r"(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d[\d_]*)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)",
    }
    define = "(?(DEFINE)(?P<unused>.))"

    def tokens(self, text: str) -> list[Token]:
        start = re.match(r"#!(?!\s*\[)[^\n]*", text)
        return super().tokens(text[start.end() :] if start else text)


class CSharpLexer(Lexer):
    blank = r"\s+|//[^\n]*|/\*(?s:.*?)\*/|\#[^\n]*"
    nested, trigger = ("STRING",), r"[$@\"]"
    ident = r"@?[^\W\d]\w*"
    classes = {
        "STRING": r'\$*(?P<q>"{3,})(?s:.*?)(?P=q)(?!")|\$@"(?P<vi>(?:[^"{}]|""|\{\{|\}\}|(?P<hole>\{(?:[^{}"]|"(?:[^"\\\n]|\\.)*"|(?&hole))*\}))*)"|@\$"(?:[^"{}]|""|\{\{|\}\}|(?&hole))*"|@"(?:[^"]|"")*"'
        r'|\$"(?:[^"\\{}\n]|\\.|\{\{|\}\}|(?&hole))*"|' + _STRING + r"(?:u8)?",
        "CHAR": _CHAR,
        "NUMBER": r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*(?:[eE][+-]?\d+)?)(?:[uU][lL]?|[lL][uU]?|[fFdDmM])?(?!\w)",
    }
    define = "(?(DEFINE)(?P<unused>.))"


class KotlinLexer(Lexer):
    blank = r"\s+|//[^\n]*|(?P<nest>/\*(?:[^*/]|\*(?!/)|/(?!\*)|(?&nest))*\*/)"
    plain_blank = r"\s+|//[^\n]*"
    nested, trigger = ("STRING",), r"/\*|\""
    ident = r"[^\W\d]\w*|`[^`\n]+`"
    classes = {
        "STRING": r'"""(?:[^"$]|\$(?!\{)|"(?!"")|\$(?P<hole>\{(?:[^{}"\']|(?&plain)|\'(?:[^\'\\\n]|\\.)+\'|(?&hole))*\}))*"{3,}|(?P<plain>"(?!"")(?:[^"\\\n$]|\\.|\$(?!\{)|\$(?&hole))*")',
        "CHAR": _CHAR,
        "NUMBER": r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*(?:[eE][+-]?\d+)?)(?:[uU]?L|[uUfF])?(?!\w)",
    }
    define = "(?(DEFINE)(?P<unused>.))"

    def tokens(self, text: str) -> list[Token]:
        start = re.match(r"#![^\n]*", text)
        return super().tokens(text[start.end() :] if start else text)


class PhpLexer(Lexer):
    blank = r"\s+|//(?:(?!\?>)[^\n])*|\#(?!\[)(?:(?!\?>)[^\n])*|/\*(?s:.*?)\*/"
    nested, trigger = ("STRING",), r"b?[\"'`]|<<<"
    ident = r"\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*"
    fold = True
    classes = {
        "HTML": r"\?>\n?(?s:.*?)(?:<\?php(?=\s|\Z)|<\?=|\Z)",
        "VAR": r"\$[^\W\d]\w*",
        "STRING": r"""(?:b)?'(?:[^'\\]|\\(?s:.))*'|(?:b)?"(?:[^"\\{]|\\(?s:.)|\{(?!\$)|(?P<hole>\{\$(?:[^{}"']|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\{(?:[^{}]|(?&hole))*\})*\}))*"|<<<[ \t]*(?:"(?P<h1>\w+)"|'(?P<h2>\w+)'|(?P<h3>\w+))\r?\n(?s:.*?)(?:(?<=\n)[ \t]*(?:(?P=h1)|(?P=h2)|(?P=h3))\b)|`(?:[^`\\]|\\.)*`""",
        "CAST": r"\([ \t]*(?i:int|integer|float|double|string|bool|boolean|array|object|unset|binary)[ \t]*\)",
        "NUMBER": r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.(?!\.)(?:\d[\d_]*)?(?:[eE][+-]?\d+)?|\d[\d_]*(?:[eE][+-]?\d+)?)(?!\w)",
    }
    define = "(?(DEFINE)(?P<unused>.))"

    def tokens(self, text: str) -> list[Token]:
        start = re.search(r"<\?php(?=\s|\Z)|<\?=", text)
        if not start:
            return []  # text without an opening tag is output as it stands
        out = [(("ECHO_TAG",), False, start.start())] if start[0] == "<?=" else []
        for kinds, fresh, at in self._inside(text, start.end()):
            if kinds == ("HTML",):
                out.append(((";",), fresh, at))
                if text[at:].find("<?=") >= 0 and regex.match(r"\?>\n?(?s:(?:(?!<\?php|<\?=).)*)<\?=", text, pos=at):
                    out.append((("ECHO_TAG",), fresh, at))
            else:
                out.append((kinds, fresh, at))
        return out

    def _inside(self, text: str, start: int) -> list[Token]:
        return [(k, f, at + start) for k, f, at in super().tokens(text[start:])]


class SqlLexer(Lexer):
    blank = r"\s+|--[^\n]*|/\*(?s:.*?)\*/"
    ident = r"[^\W\d][\w$]*|\"(?:[^\"]|\"\")+\"|`[^`]+`|\[[^\W\d][\w ]*\]"
    fold = True
    classes = {"STRING": r"(?:[EeNnBbXx])?'(?:[^']|'')*'|\$(?P<tag>\w*)\$(?s:.*?)\$(?P=tag)\$", "NUMBER": r"(?:(?:\d+)?\.\d+|\d+\.?)(?:[eE][+-]?\d+)?(?!\w)|0x[\da-fA-F]+", "PARAM": r"[:@$]\w+|\?|%s"}


class ScriptLexer(Lexer):
    """JavaScript and TypeScript: templates and regular expressions depend on what precedes."""

    ident = r"(?:[^\W\d]|[$\\])(?:[\w$]|\\u[\da-fA-F{}]+)*"
    classes = {
        "STRING": r'"(?:[^"\\\n]|\\(?s:.))*"|\'(?:[^\'\\\n]|\\(?s:.))*\'',
        "NUMBER": r"(?:0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?|\d[\d_]*\.(?:[eE][+-]?\d[\d_]*)?|\d[\d_]*(?:[eE][+-]?\d[\d_]*|n)?)(?![\w$])",
        "PRIVATE": r"#[^\W\d][\w$]*",
        "TICK": "`",
    }
    REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
    CHUNK = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*(`|\$\{)")
    VALUES = {"IDENT", "NUMBER", "STRING", "TEMPLATE", "T_CLOSE", "REGEX", "PRIVATE", ")", "]", "this", "super", "null", "true", "false", "++", "--"}

    def __init__(self, grammar: Grammar):
        super().__init__(grammar)
        self.pattern = re.compile(self._alternatives(self.blank, self.classes))

    def tokens(self, text: str) -> list[Token]:
        out: list[Token] = []
        at, fresh, size, match = 0, True, len(text), self.pattern.match
        if text.startswith("#!"):
            at = (text.find("\n") + 1) or size
        braces: list[int] = []
        while at < size:
            m = match(text, at)
            kind = m.lastgroup if m else None
            if kind == "blank":
                fresh = fresh or "\n" in m[0]
                at = m.end()
                continue
            value = m[kind] if m else ""
            if (not m or value[0] == "/") and text[at] == "/" and (not out or out[-1][0][-1] not in self.VALUES):
                r = self.REGEX.match(text, at)
                if r:
                    out.append((("REGEX",), fresh, at))
                    at, fresh = r.end(), False
                    continue
            if not m:
                out.append(((ERROR,), fresh, at))
                break
            if kind == "TICK" or value == "}" and braces and braces[-1] == 0:
                first = kind == "TICK"
                chunk = self.CHUNK.match(text, at + 1)
                if not chunk:
                    out.append(((ERROR,), fresh, at))
                    break
                opens = chunk[1] != "`"
                name = ("T_OPEN" if opens else "TEMPLATE") if first else ("T_MID" if opens else "T_CLOSE")
                if first and opens:
                    braces.append(0)
                if not first and not opens:
                    braces.pop()
                out.append(((name,), fresh, at))
                at, fresh = chunk.end(), False
                continue
            if braces and value in "{}" and kind == "sign":
                braces[-1] += 1 if value == "{" else -1
            if fresh and value in ("++", "--") and out:
                kind = "PLUSPLUS"  # after a line end it belongs to what follows
            out.append((self.word(value) if kind == "word" else (value,) if kind == "sign" else (kind,), fresh, at))
            at, fresh = m.end(), False
        return out


class PythonLexer(Lexer):
    blank = r"[ \t\f]+|\\\r?\n|\#[^\n]*"
    nested, trigger = ("STRING",), r"[A-Za-z]{0,2}[\"']"
    define = (
        r"(?(DEFINE)(?P<quoted>\"\"\"(?s:(?:[^\\]|\\.)*?)\"\"\"|'''(?s:(?:[^\\]|\\.)*?)'''|\"(?:[^\"\\\n{]|\\.|\{\{|(?&hole)|\{)*\"|'(?:[^'\\\n{]|\\.|\{\{|(?&hole)|\{)*')"
        r"(?P<hole>\{(?:[^{}\"']|(?&quoted)|(?&hole))+\}))"
    )
    classes = {
        "STRING": r"(?i:rf|fr|f|rt|tr|t)(?:\"(?!\"\")(?:[^\"\\\n{]|\\(?s:.)|\{\{|(?&hole))*\"|'(?!'')(?:[^'\\\n{]|\\(?s:.)|\{\{|(?&hole))*')|(?i:[rbuft]|br|rb|fr|rf|tr|rt)?(?:\"\"\"(?s:(?:[^\\]|\\.)*?)\"\"\"|'''(?s:(?:[^\\]|\\.)*?)'''|\"(?!\"\")(?:[^\"\\\n]|\\(?s:.))*\"|'(?!'')(?:[^'\\\n]|\\(?s:.))*')",
        "NUMBER": r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*\.(?:[eE][+-]?\d(?:_?\d)*)?|(?:[1-9](?:_?\d)*|0(?:_?0)*)(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*)[jJ]?(?!\w)",
        "LINE": r"\n",
    }

    def tokens(self, text: str) -> list[Token]:
        """With NEWLINE, INDENT and DEDENT; a line that comes back to no open indentation is an ERROR."""
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        out: list[Token] = []
        depths, open_, first = [0], 0, True
        for kinds, _, at in super().tokens(text):
            kind = kinds[0]
            if kind == "LINE":
                if not open_ and not first:
                    out.append((("NEWLINE",), False, at))
                    first = True
                continue
            if first and not open_:
                line = text.rfind("\n", 0, at) + 1
                blank = text[line:at]
                depth = len(blank.expandtabs(8)) if not blank.strip(" \t\f") else depths[-1]
                if depth > depths[-1]:
                    depths.append(depth)
                    out.append((("INDENT",), False, at))
                while depth < depths[-1]:
                    depths.pop()
                    out.append((("DEDENT",), False, at))
                if depth != depths[-1]:
                    out.append(((ERROR,), False, at))
                    return out
                first = False
            open_ += (kind in ("(", "[", "{")) - (kind in (")", "]", "}"))
            open_ = max(0, open_)
            out.append((kinds, False, at))
        if not first:
            out.append((("NEWLINE",), False, len(text)))
        out += [(("DEDENT",), False, len(text))] * (len(depths) - 1)
        return out
