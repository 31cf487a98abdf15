"""Errors of whole Python files that no context-free grammar states: one pass over the tokens.

``return``, ``yield`` and ``await`` outside functions, ``break`` and ``continue`` outside
loops, and parameter lists with repeated names or in an order that is not allowed.
"""

from __future__ import annotations

import re

_NAME = re.compile(r"[^\W\d]\w*")
_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}
_BLOCKS = {"def", "class", "for", "while", "if", "elif", "else", "try", "except", "finally", "with"}


def python_error(tokens: list[tuple], text: str) -> int | None:
    """Index of the first token at which such an error shows, None if there is none.

    ``text`` is the source with its line ends as the lexer sees them.
    """
    blocks: list[tuple[str, bool]] = []  # (def, async def, class, loop or block; whether it has an indented body)
    header, depth, lambdas, held, start, fresh_async, waiting = None, 0, 0, False, True, False, None  # held: a lambda on this line
    for at, (kinds, _, offset) in enumerate(tokens):
        kind = kinds[0]
        if kind == "INDENT":
            blocks.append((waiting or "block", True))
            waiting, start = None, True
            continue
        if kind == "DEDENT":
            while blocks and not blocks.pop()[1]:
                pass
            start = True
            continue
        if kind == "NEWLINE":
            while blocks and not blocks[-1][1]:
                blocks.pop()
            start, header, depth, lambdas, held, fresh_async = True, None, 0, 0, False, False
            continue
        if start and depth == 0:
            waiting = None
            if kind == "async":
                fresh_async = True
                continue
            if kind in _BLOCKS:
                header = ("async def" if fresh_async else "def") if kind == "def" else kind if kind == "class" else "loop" if kind in ("for", "while") else "block"
            elif kinds == ("match", "IDENT") or kinds == ("case", "IDENT"):
                header = "block"
            else:
                header = None
            if kind == "def" and (bad := _parameters(tokens, at, text)) is not None:
                return bad
            start = False
        if kind in _OPEN:
            depth += 1
        elif kind in _CLOSE:
            depth -= 1
        elif kind == "lambda":
            lambdas += depth == 0
            held = True
        elif kind == ":" and depth == 0 and lambdas:
            lambdas -= 1
        elif kind == ":" and depth == 0 and header:
            if at + 1 < len(tokens) and tokens[at + 1][0][0] == "NEWLINE":
                waiting = header
            else:
                blocks.append((header, False))
            header, start = None, True
            if at + 1 < len(tokens) and tokens[at + 1][0][0] == "NEWLINE":
                start = False
            continue
        elif kind == ";" and depth == 0:
            start = True
            continue
        if kind in ("break", "continue"):
            for name, _ in reversed(blocks):
                if name == "loop":
                    break
                if name != "block":
                    return at
            else:
                return at
        elif kind in ("return", "yield", "await") and not held:
            scope = next((name for name, _ in reversed(blocks) if name in ("def", "async def", "class")), None)
            if kind == "await" and scope != "async def" or scope not in ("def", "async def"):
                return at
    return None


def _parameters(tokens: list[tuple], at: int, text: str) -> int | None:
    """The first token of the parameter list of the ``def`` at ``at`` that repeats a name or stands in the wrong order."""
    while at < len(tokens) and tokens[at][0][0] != "(":
        if tokens[at][0][0] == "[":  # type parameters
            deep = 0
            while at < len(tokens):
                deep += (tokens[at][0][0] in _OPEN) - (tokens[at][0][0] in _CLOSE)
                if not deep:
                    break
                at += 1
        at += 1
    depth, begins, names, defaulted, star, double, own_default, last, closed = 1, True, set(), False, False, False, False, None, False
    for k in range(at + 1, len(tokens)):
        kinds, _, offset = tokens[k]
        kind = kinds[0]
        if kind in _OPEN:
            depth += 1
        elif kind in _CLOSE:
            depth -= 1
            if not depth:
                break
        elif depth == 1 and kind == ",":
            if last is not None and defaulted and not own_default and not star and not double:
                return last
            defaulted |= own_default
            begins, own_default, last, closed = True, False, None, double
            continue
        elif depth == 1 and kind == "=":
            own_default = True
        if begins and depth == 1:
            if closed:
                return k  # nothing may follow **name
            if kind == "*":
                if star:
                    return k
                star = True
                continue
            if kind == "**":
                double = True
                continue
            if kinds[-1] == "IDENT":
                name = _NAME.match(text, offset)[0]
                if name in names:
                    return k
                names.add(name)
                last = k
            begins = False
    if last is not None and defaulted and not own_default and not star and not double:
        return last
    return None
