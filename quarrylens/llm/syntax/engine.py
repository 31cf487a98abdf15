"""Grammars in extended BNF, their parse tables and a recogniser for token streams.

A grammar compiles to an LALR(1) table whose cells may hold several actions. The
recogniser follows all of them on stacks that share their lower parts and become one
again where they agree, so grammars may be ambiguous as long as they say what is valid.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cached_property

END, ERROR = "<end>", "<error>"
#: Parts of one rule that may be empty and are left out in all combinations; further ones become a rule of their own.
MOST_EMPTY = 4
_LEX = re.compile(r"\s+|#[^\n]*|(?P<rule>^[a-z_]\w*)\s*:|(?P<lit>'(?:[^'\\]|\\.)+')|(?P<name>[A-Za-z_]\w*)|(?P<op>[|()?*+])|(?P<ban>!\[)|(?P<close>\])", re.M)


class Grammar:
    """Rules ``name: alternatives`` with 'literals', TOKENS, rules, groups, ``? * +``.

    An alternative that ends in ``![ 'a' 'b' ]`` does not apply to text that begins with
    one of these literals. The rule ``start`` is where parsing starts. ``anyname`` stands
    for an identifier or any of the words in ``reserved``; ``anytoken`` for any token that
    is no bracket.
    """

    def __init__(self, text: str, reserved: str = ""):
        self.reserved = set(reserved.split())
        self.rules: list[tuple[str, tuple[str, ...], frozenset[str]]] = []
        self._names: dict[tuple, str] = {}
        self._made = 0
        tokens = self._tokens(text)
        self.literals = {v for k, v in tokens if k == "lit"}
        self.heads = {v for k, v in tokens if k == "rule"}
        self._read(tokens)
        if any("<anyname>" in body for _, body, _ in self.rules):
            self.heads.add("<anyname>")
            self.rules += [("<anyname>", (t,), frozenset()) for t in ["IDENT", *sorted(self.reserved)]]
        if any("<anytoken>" in body for _, body, _ in self.rules):
            self.heads.add("<anytoken>")
            classes = {s for _, body, _ in self.rules for s in body if s not in self.heads and s[0].isupper()}
            plain = (self.literals | self.reserved | classes) - set("()[]{}")
            self.rules += [("<anytoken>", (t,), frozenset()) for t in sorted(plain)]
        self.rules = self._without_empty(self.rules)
        self.soft = {v for v in self.literals if re.fullmatch(r"[^\W\d]\w*", v)} - self.reserved
        signs = sorted((v for v in self.literals if not re.fullmatch(r"[^\W\d]\w*", v)), key=len, reverse=True)
        self.signs = "|".join(map(re.escape, signs))

    def _tokens(self, text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"bad grammar at {text[at : at + 40]!r}")
            if m.lastgroup:
                kind, value = m.lastgroup, m[m.lastgroup]
                if kind == "lit":
                    value = re.sub(r"\\(.)", r"\1", value[1:-1])
                elif kind == "rule" or kind == "name" and value[0].islower():
                    value = f"<{value}>"  # apart from literals of the same spelling
                out.append((kind, value))
            at = m.end()
        return out

    def _read(self, tokens: list[tuple[str, str]]) -> None:
        at = 0

        def alternatives(stop: set) -> list[tuple[tuple[str, ...], frozenset[str]]]:
            nonlocal at
            found, body, ban = [], [], frozenset()
            while at < len(tokens) and tokens[at] not in stop and tokens[at][0] != "rule":
                kind, value = tokens[at]
                at += 1
                if (kind, value) == ("op", "|"):
                    found.append((tuple(body), ban))
                    body, ban = [], frozenset()
                    continue
                if kind == "ban":
                    own = set()
                    while tokens[at][0] != "close":
                        own.add(tokens[at][1])
                        at += 1
                    at += 1
                    ban = frozenset(own)
                    continue
                if (kind, value) == ("op", "("):
                    inner = alternatives({("op", ")")})
                    at += 1
                    symbol = self._helper("group", tuple(inner), inner) if len(inner) > 1 or len(inner[0][0]) != 1 or inner[0][1] else inner[0][0][0]
                else:
                    symbol = value
                if at < len(tokens) and tokens[at][0] == "op" and tokens[at][1] in "?*+":
                    symbol = self._repeat(symbol, tokens[at][1])
                    at += 1
                body.append(symbol)
            found.append((tuple(body), ban))
            return found

        while at < len(tokens):
            head = tokens[at][1]
            at += 1
            self.rules += [(head, body, ban) for body, ban in alternatives(set())]

    def _helper(self, kind: str, key: tuple, bodies: list) -> str:
        if (kind, key) not in self._names:
            self._made += 1
            name = self._names[kind, key] = f"<{kind}{self._made}>"
            self.heads.add(name)
            self.rules += [(name, body, ban) for body, ban in bodies]
        return self._names[kind, key]

    def _repeat(self, symbol: str, sign: str) -> str:
        none = frozenset()
        if sign == "?":
            return self._helper("maybe", (symbol,), [((), none), ((symbol,), none)])
        name = self._helper("some" if sign == "+" else "many", (symbol,), [])
        if not any(head == name for head, _, _ in self.rules):
            self.rules += [(name, (symbol,) if sign == "+" else (), none), (name, (name, symbol), none)]
        return name

    def _without_empty(self, rules: list) -> list:
        """The same language without rules for nothing: each body with and without every part that may be empty.

        So no table has to choose between an empty part and what follows it. Of bodies with many
        such parts the rest becomes a rule of its own.
        """
        empty: set[str] = set()
        grew = True
        while grew:
            grew = False
            for head, body, _ in rules:
                if head not in empty and all(s in empty for s in body):
                    empty.add(head)
                    grew = True
        some: set[str] = set()  # heads that may also be something
        grew = True
        while grew:
            grew = False
            for head, body, _ in rules:
                if head not in some and any(s in some or s not in self.heads for s in body):
                    some.add(head)
                    grew = True
        out: dict[tuple, None] = {}
        tails: dict[tuple, str] = {}
        todo = list(reversed(rules))
        while todo:
            head, body, ban = todo.pop()
            body = tuple(s for s in body if s not in self.heads or s in some)
            loose = [k for k, s in enumerate(body) if s in empty]
            if len(loose) > MOST_EMPTY:
                rest = body[loose[MOST_EMPTY - 1] + 1 :]
                if rest not in tails:
                    name = tails[rest] = f"<rest{len(tails)}>"
                    self.heads.add(name)
                    some.add(name)
                    if all(s in empty for s in rest):
                        empty.add(name)
                    todo.append((name, rest, frozenset()))
                front = body[: len(body) - len(rest)]
                if tails[rest] in empty:
                    todo.append((head, front, ban))
                out |= {(head, kept + (tails[rest],), ban): None for kept in self._variants(front, loose[:MOST_EMPTY])}
                continue
            out |= {(head, kept, ban): None for kept in self._variants(body, loose) if kept and kept != (head,)}
        return list(out)

    @staticmethod
    def _variants(body: tuple[str, ...], loose: list[int]) -> list[tuple[str, ...]]:
        found = []
        for mask in range(1 << len(loose)):
            left_out = {k for i, k in enumerate(loose) if mask >> i & 1}
            found.append(tuple(s for k, s in enumerate(body) if k not in left_out))
        return found

    @cached_property
    def tables(self) -> tuple[list, list, list]:
        """(actions by state and token, states to go to by state and rule, (head, length, ban) by rule)."""
        rules = [("$top", ("<start>",), frozenset()), *self.rules]
        by_head = defaultdict(list)
        for k, (head, _, _) in enumerate(rules):
            by_head[head].append(k)
        missing = {s for _, body, _ in rules for s in body if s not in by_head and s[0] == "<" and s[1:2].isalpha() and s not in self.literals}
        if missing:
            raise ValueError(f"rules without definition: {sorted(missing)}")
        empty: set[str] = set()
        grew = True
        while grew:
            grew = False
            for head, body, _ in rules:
                if head not in empty and all(s in empty for s in body):
                    empty.add(head)
                    grew = True
        first: dict[str, set[str]] = {h: set() for h in by_head}
        first_of = lambda s: first[s] if s in first else {s}
        grew = True
        while grew:
            grew = False
            for head, body, _ in rules:
                before = len(first[head])
                for s in body:
                    first[head] |= first_of(s)
                    if s not in empty:
                        break
                grew |= len(first[head]) > before
        def close(kernel: frozenset) -> set:
            items, todo = set(kernel), list(kernel)
            while todo:
                rule, dot = todo.pop()
                body = rules[rule][1]
                if dot < len(body):
                    for k in by_head.get(body[dot], ()):
                        if (k, 0) not in items:
                            items.add((k, 0))
                            todo.append((k, 0))
            return items

        start = frozenset({(0, 0)})
        number, states = {start: 0}, [start]
        shifts: list[dict] = []  # state to go to by any symbol
        ends: list[list[int]] = []  # rules whose end is reached
        for kernel in states:
            moves, done = defaultdict(set), []
            for rule, dot in close(kernel):
                body = rules[rule][1]
                if dot < len(body):
                    moves[body[dot]].add((rule, dot + 1))
                else:
                    done.append(rule)
            goto = {}
            for symbol, items in moves.items():
                key = frozenset(items)
                if key not in number:
                    number[key] = len(states)
                    states.append(key)
                goto[symbol] = number[key]
            shifts.append(goto)
            ends.append(done)
        ahead = self._lookaheads(rules, by_head, empty, shifts)
        actions: list[dict] = []
        for state, goto in enumerate(shifts):
            acts: dict[str, list[int]] = defaultdict(list)
            for rule in sorted(ends[state]):
                for t in ahead[state, rule]:
                    acts[t].append(~rule)
            for symbol, to in goto.items():
                if symbol not in by_head:
                    acts[symbol].append(to)
            actions.append({t: tuple(a) for t, a in acts.items()})
        gotos = [{h: to for h, to in goto.items() if h in by_head} for goto in shifts]
        return actions, gotos, [(head, len(body), ban) for head, body, ban in rules]

    @staticmethod
    def _lookaheads(rules: list, by_head: dict, empty: set, shifts: list[dict]) -> dict[tuple[int, int], list[str]]:
        """LALR(1): the tokens that may follow each rule that ends in a state, by what may follow its head where it began."""
        terminals: dict[str, int] = {END: 0}
        follow: dict[tuple[int, str], int] = {}  # bits of the tokens after a head that begins in a state
        feeds = defaultdict(list)  # (state, head) whose tokens also follow another
        back = defaultdict(list)  # (state, rule) -> the (state, head) it reduces to
        for state, goto in enumerate(shifts):
            for head, to in goto.items():
                if head not in by_head:
                    continue
                own = 0
                for symbol in shifts[to]:
                    if symbol not in by_head:
                        own |= 1 << terminals.setdefault(symbol, len(terminals))
                    elif symbol in empty:
                        feeds[to, symbol].append((state, head))
                follow[state, head] = own
        follow[0, "$top"] = 1
        for state, head in list(follow):
            for rule in by_head[head]:
                body, at = rules[rule][1], state
                tail = len(body)
                while tail and body[tail - 1] in empty:
                    tail -= 1
                for k, symbol in enumerate(body):
                    if symbol in by_head and k >= tail - 1:
                        feeds[state, head].append((at, symbol))
                    at = shifts[at][symbol]
                back[at, rule].append((state, head))
        todo = list(follow)
        while todo:
            source = todo.pop()
            bits = follow[source]
            for target in feeds.get(source, ()):
                if bits & ~follow[target]:
                    follow[target] |= bits
                    todo.append(target)
        names = list(terminals)
        out = {}
        for key, places in back.items():
            bits = 0
            for place in places:
                bits |= follow[place]
            out[key] = [names[i] for i in range(bits.bit_length()) if bits >> i & 1]
        return out

    @cached_property
    def _runs(self) -> dict[str, dict[int, tuple[int, int | None]]]:
        """For each token what ``_run`` gave so far; the keys are pairs of states, so it is bounded by the tables."""
        return defaultdict(dict)

    def _run(self, state: int, below: int, kind: str) -> tuple[int, int | None]:
        """(state, action) after all reductions of one symbol that are without choice; no action where there is none, or several."""
        actions, gotos, rules = self.tables
        while True:
            acts = actions[state].get(kind)
            if acts is None or len(acts) > 1:
                return state, None
            head, size, ban = rules[~acts[0]] if acts[0] < 0 else ("", 0, None)
            if head == "$top":
                return state, None
            if size != 1 or ban:
                return state, acts[0]
            state = gotos[below][head]

    def recognise(self, tokens: list[tuple], newline: str | None = None) -> int:
        """Index of the first token that no valid text has there, -1 if all is valid.

        Tokens are (kinds, after_newline, ...). ``newline`` says how line ends may stand
        for ``;``: "error" inserts one where a token is refused after a line end, before
        ``}`` and at the end; "fork" tries both at every line end.
        """
        actions, gotos, rules = self.tables
        states, runs = len(actions), self._runs
        heads = [(0, None, 0)]

        def advance(heads: list, kinds: tuple, at: int, begins) -> list:
            out, shifted, kept = [], set(), []  # kept: nodes whose id is in use
            for kind in kinds:
                known = runs[kind]
                todo, seen = list(heads), {(h[0], id(h[1])) for h in heads}
                while todo:
                    node = todo.pop()
                    kept.append(node)
                    state, below, began = node
                    under = below[0] if below else 0
                    key = state * states + under
                    hit = known.get(key)
                    if hit is None:
                        hit = known[key] = self._run(state, under, kind)
                    after, a = hit
                    if after != state:
                        if (after, id(below)) in seen:
                            continue
                        seen.add((after, id(below)))
                        node = (after, below, began)
                    for a in actions[after].get(kind, ()) if a is None else (a,):
                        if a >= 0:
                            if (a, after, id(below)) not in shifted:
                                shifted.add((a, after, id(below)))
                                out.append((a, node, at))
                            continue
                        head, size, ban = rules[~a]
                        low, since = node, at
                        for _ in range(size):
                            since = low[2]
                            low = low[1]
                        if ban and not ban.isdisjoint(begins(since)):
                            continue
                        if head == "$top":
                            out.append((-1, None, at))
                            continue
                        goal = gotos[low[0]].get(head)
                        if goal is not None and (goal, id(low)) not in seen:
                            seen.add((goal, id(low)))
                            todo.append((goal, low, since))
            return out

        def begins(k: int) -> tuple:
            return tokens[k][0] if k < len(tokens) else (END,)

        semicolon = (";",)
        for at in range(len(tokens) + 1):
            kinds, fresh = tokens[at][:2] if at < len(tokens) else ((END,), True)
            if len(heads) == 1 and len(kinds) == 1 and not (newline == "fork" and fresh):
                kind = kinds[0]
                known = runs[kind]
                state, below, began = heads[0]
                while True:  # no choice so far: plain shift-reduce steps, runs of unit reductions as one
                    key = state * states + (below[0] if below else 0)
                    hit = known.get(key)
                    if hit is None:
                        hit = known[key] = self._run(state, below[0] if below else 0, kind)
                    state, a = hit
                    if a is None or a >= 0:
                        break
                    head, size, ban = rules[~a]
                    if size == 0:
                        below, began = (state, below, began), at
                    else:
                        while size > 1:
                            began = below[2]
                            below = below[1]
                            size -= 1
                    if ban and not ban.isdisjoint(begins(began)):
                        a = None
                        break
                    state = gotos[below[0]][head]
                if a is not None:
                    heads = [(a, (state, below, began), at)]
                    continue
            nxt = advance(heads, kinds, at, begins)
            if newline == "fork" and fresh and at:
                with_semicolon = advance(heads, semicolon, at, begins)
                if with_semicolon:
                    known = {(h[0], id(h[1])) for h in nxt}
                    nxt += [h for h in advance(with_semicolon, kinds, at, begins) if (h[0], id(h[1])) not in known]
            elif not nxt and newline == "error" and (fresh or kinds[0] in ("}", END)):
                nxt = advance(advance(heads, semicolon, at, begins), kinds, at, begins)
            if not nxt:
                return at
            heads = nxt
        return -1
