"""Whether a source file is valid in its language, and where its first error stands."""

from __future__ import annotations

from functools import lru_cache

from quarrylens.llm.syntax import grammars as g
from quarrylens.llm.syntax import lexers as x
from quarrylens.llm.syntax.early import python_error
from quarrylens.llm.syntax.engine import Grammar

#: Grammar, reserved words, lexer and what line ends mean, by language.
LANGUAGES = {
    "python": (g.PYTHON, g.PYTHON_RESERVED, x.PythonLexer, None),
    "javascript": (g.JAVASCRIPT, g.SCRIPT_RESERVED, x.ScriptLexer, "error"),
    "typescript": (g.TYPESCRIPT, g.SCRIPT_RESERVED, x.ScriptLexer, "error"),
    "java": (g.JAVA, g.JAVA_RESERVED, x.JavaLexer, None),
    "go": (g.GO, g.GO_RESERVED, x.GoLexer, None),
    "csharp": (g.CSHARP, g.CSHARP_RESERVED, x.CSharpLexer, None),
    "rust": (g.RUST, g.RUST_RESERVED, x.RustLexer, None),
    "php": (g.PHP, g.PHP_RESERVED, x.PhpLexer, None),
    "kotlin": (g.KOTLIN, g.KOTLIN_RESERVED, x.KotlinLexer, "fork"),
    "sql": (g.SQL, g.SQL_RESERVED, x.SqlLexer, None),
}


@lru_cache(None)
def _parser(lang: str) -> tuple[Grammar, x.Lexer, str | None]:
    text, reserved, lexer, newline = LANGUAGES[lang]
    grammar = Grammar(text, reserved)
    return grammar, lexer(grammar), newline


def first_error(content: str | None, lang: str | None) -> int | None:
    """The line, from 1, of the first token that no valid file has there; None for valid files.

    Null, empty and comment-only contents are valid, and so are languages without a grammar.
    """
    key = (lang or "").strip().lower()
    if not content or not content.strip() or key not in LANGUAGES:
        return None
    text = content.removeprefix("﻿")
    grammar, lexer, newline = _parser(key)
    tokens = lexer.tokens(text)
    if not tokens:
        return None
    at = grammar.recognise(tokens, newline)
    if at < 0 and key == "python":
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        bad = python_error(tokens, text)
        at = -1 if bad is None else bad
    if at < 0:
        return None
    offset = tokens[at][2] if at < len(tokens) else len(text)
    return text.count("\n", 0, offset) + 1
