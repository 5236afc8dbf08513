"""A small template language for chat formats: parsed into a syntax tree, folded, and turned into Python closures.

Text stands for itself. ``{{ expression }}`` prints, ``{# comment #}`` is dropped, ``-`` inside a tag trims the white space beside it, and
these blocks exist: ``{% for m in messages %}``, ``{% if %}`` / ``{% elif %}`` / ``{% else %}`` and ``{% generation %}``, which marks what a
model should learn to write. Expressions have strings, whole numbers, ``true``, ``false``, ``m.role``, ``m.text``, ``loop.first``,
``loop.last``, ``loop.index``, ``not``, ``and``, ``or``, ``==``, ``!=``, ``in``, ``~`` (joins texts) and filters (``| escape``).

Nothing else can be named: no attribute, call or index of Python is reachable, loops run over the messages alone and do not nest. So a
template ends after time linear in its conversation. Every mistake is a ``TemplateError`` when the template is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from enum import Enum


class Mark(Enum):
    """What a rendered conversation is made of, besides texts: where a marked region opens and closes, and where a message has ended."""

    OPEN, CLOSE, BREAK = range(3)


FIELDS = {"loop": ("first", "last", "index"), None: ("role", "text")}
_TAG = re.compile(r"""\{(?P<kind>[{%\#])(?P<left>-?)(?P<body>(?:'[^']*'|"[^"]*"|(?!-?[}%\#]\}).)*?)(?P<right>-?)[}%\#]\}""", re.S)
_WORD = re.compile(r"""\s*(?:(?P<string>'[^']*'|"[^"]*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[~|.()]))""")


class TemplateError(ValueError):
    """A template that does not follow the language."""


def escape(text: str) -> str:
    r"""``text`` with a backslash more in each ``<|``, ``<\|``, ``<\\|`` ..., so that no control string ``<|name|>`` is left in it."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


FILTERS: dict[str, Callable] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


# --- parsing ---------------------------------------------------------------------------------------
# Expressions are tuples: ("const", v), ("field", object, name), ("not", x), ("and"|"or"|"=="|"!="|"in", x, y), ("join", parts), ("filter", name, x).
# Statements: ("print", x), ("for", name, body), ("if", [(test, body), ...]), ("generation", body).


class _Expression:
    def __init__(self, source: str, variable: str | None):
        self.variable, self.words, at = variable, [], 0
        while source[at:].strip():
            m = _WORD.match(source, at)
            if m is None:
                raise TemplateError(f"cannot read {source[at:].strip()!r}")
            self.words.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.words.append(("end", ""))

    def take(self, *wanted: str) -> str | None:
        kind, word = self.words[0]
        if kind in ("name", "sign") and word in wanted:
            self.words.pop(0)
            return word
        return None

    def whole(self):
        tree = self.either()
        if self.words[0][0] != "end":
            raise TemplateError(f"unexpected {self.words[0][1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.joined()
        while sign := self.take("==", "!=", "in"):
            tree = (sign, tree, self.joined())
        return tree

    def joined(self):
        parts = [self.filtered()]
        while self.take("~"):
            parts.append(self.filtered())
        return parts[0] if len(parts) == 1 else ("join", parts)

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            kind, name = self.words.pop(0)
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def atom(self):
        kind, word = self.words.pop(0)
        if kind == "string":
            return ("const", word[1:-1])
        if kind == "number":
            return ("const", int(word))
        if (kind, word) == ("sign", "("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        if kind == "name" and word in ("true", "false"):
            return ("const", word == "true")
        if kind == "name" and self.take("."):
            field = self.words.pop(0)[1]
            if self.variable is not None and word in ("loop", self.variable) and field in FIELDS["loop" if word == "loop" else None]:
                return ("field", "loop" if word == "loop" else "message", field)
            raise TemplateError(f"unknown field {word}.{field}")
        raise TemplateError(f"unexpected {word or 'end'!r}")


def parse(source: str) -> list:
    """The syntax tree of a template, a list of statements."""
    pieces, at, trim = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        pieces.append(("text", text.rstrip() if m["left"] else text))
        if m.group()[-2] != {"{": "}", "%": "%", "#": "#"}[m["kind"]]:
            raise TemplateError(f"tag {m.group()!r} is not closed as it was opened")
        pieces.append((m["kind"], m["body"].strip()))
        at, trim = m.end(), bool(m["right"])
    pieces.append(("text", source[at:].lstrip() if trim else source[at:]))
    for kind, text in pieces:
        if kind == "text" and re.search(r"\{[{%#]", text):
            raise TemplateError(f"open tag in {text[:40]!r}")
    pieces.reverse()

    def block(ends: tuple[str, ...], variable: str | None, marked: bool) -> tuple[list, str]:
        body: list = []
        while pieces:
            kind, text = pieces.pop()
            if kind == "text" and text:
                body.append(("print", ("const", text)))
            elif kind == "{":
                body.append(("print", _Expression(text, variable).whole()))
            elif kind == "%":
                word, _, rest = text.partition(" ")
                if word in ends:
                    return body, text
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*) in messages", rest.strip())
                    if m is None or m[1] == "loop" or variable is not None:
                        raise TemplateError(f"loops run over messages and do not nest: {text!r}")
                    body.append(("for", m[1], block(("endfor",), m[1], marked)[0]))
                elif word == "if":
                    branches, test = [], rest
                    while True:
                        inner, end = block(("elif", "else", "endif"), variable, marked)
                        branches.append((("const", True) if test is None else _Expression(test, variable).whole(), inner))
                        if end == "endif":
                            break
                        if test is None:
                            raise TemplateError(f"{end!r} after else")
                        test = None if end == "else" else end.partition(" ")[2]
                    body.append(("if", branches))
                elif word == "generation" and not rest:
                    if marked:
                        raise TemplateError("generation inside generation")
                    body.append(("generation", block(("endgeneration",), variable, True)[0]))
                else:
                    raise TemplateError(f"unknown or misplaced tag {text!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return body, ""

    return block((), None, False)[0]


# --- folding ---------------------------------------------------------------------------------------


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


_OPERATIONS = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: _text(a) in _text(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def folded(tree):
    """The expression with every part that no message can change replaced by its value."""
    if tree[0] == "join":
        parts: list = []
        for part in map(folded, tree[1]):
            for p in part[1] if part[0] == "join" else [part]:
                if p[0] == "const" and parts and parts[-1][0] == "const":
                    parts[-1] = ("const", _text(parts[-1][1]) + _text(p[1]))
                else:
                    parts.append(("const", _text(p[1])) if p[0] == "const" else p)
        return parts[0] if len(parts) == 1 and parts[0][0] == "const" else ("join", parts)
    if tree[0] == "filter":
        inner = folded(tree[2])
        return ("const", FILTERS[tree[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    if tree[0] == "not":
        inner = folded(tree[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if tree[0] in _OPERATIONS:
        a, b = folded(tree[1]), folded(tree[2])
        if a[0] == "const" and tree[0] in ("and", "or"):
            return b if bool(a[1]) == (tree[0] == "and") else a
        return ("const", _OPERATIONS[tree[0]](a[1], b[1])) if a[0] == b[0] == "const" else (tree[0], a, b)
    return tree


def fold(body: list) -> list:
    """Statements with folded expressions, neighbouring constant texts as one, and no branch that is never taken."""
    out: list = []

    def put(statement) -> None:
        if statement[0] == "print" and statement[1][0] == "const":
            text = _text(statement[1][1])
            if out and out[-1][0] == "print" and out[-1][1][0] == "const":
                out[-1] = ("print", ("const", out[-1][1][1] + text))
            elif text:
                out.append(("print", ("const", text)))
        else:
            out.append(statement)

    for statement in body:
        if statement[0] == "print":
            tree = folded(statement[1])
            for part in tree[1] if tree[0] == "join" else [tree]:
                put(("print", part))
        elif statement[0] == "if":
            branches = []
            for test, inner in statement[1]:
                test = folded(test)
                if test[0] != "const" or test[1]:
                    branches.append((test, fold(inner)))
                if test[0] == "const" and test[1]:
                    break
            if branches and branches[0][0][0] == "const":
                for inner in branches[0][1]:
                    put(inner)
            elif branches:
                out.append(("if", branches))
        else:
            out.append((*statement[:-1], fold(statement[-1])))
    return out


# --- closures --------------------------------------------------------------------------------------
# A state is (role, text, first, last, index); expressions become functions of it, statements generators over it.

_PLACES = {("message", "role"): 0, ("message", "text"): 1, ("loop", "first"): 2, ("loop", "last"): 3, ("loop", "index"): 4}


def _value(tree) -> Callable:
    if tree[0] == "const":
        return lambda state, v=tree[1]: v
    if tree[0] == "field":
        return lambda state, i=_PLACES[tree[1:]]: state[i]
    if tree[0] == "join":
        parts = [_value(p) for p in tree[1]]
        return lambda state: "".join(_text(p(state)) for p in parts)
    if tree[0] == "filter":
        f, x = FILTERS[tree[1]], _value(tree[2])
        return lambda state: f(_text(x(state)))
    a = _value(tree[1])
    if tree[0] == "not":
        return lambda state: not a(state)
    b = _value(tree[2])
    if tree[0] == "and":
        return lambda state: a(state) and b(state)
    if tree[0] == "or":
        return lambda state: a(state) or b(state)
    operation = _OPERATIONS[tree[0]]
    return lambda state: operation(a(state), b(state))


def _block(body: list) -> Callable:
    steps = [_step(statement) for statement in body]

    def run(state, messages):
        for step in steps:
            yield from step(state, messages)

    return run


def _step(statement) -> Callable:
    kind = statement[0]
    if kind == "print":
        value = _value(statement[1])
        return lambda state, messages: (_text(value(state)),)
    if kind == "generation":
        inner = _block(statement[1])

        def marked(state, messages):
            yield Mark.OPEN
            yield from inner(state, messages)
            yield Mark.CLOSE

        return marked
    if kind == "if":
        branches = [(_value(test), _block(inner)) for test, inner in statement[1]]

        def chosen(state, messages):
            for test, inner in branches:
                if test(state):
                    yield from inner(state, messages)
                    return

        return chosen
    inner = _block(statement[2])

    def loop(state, messages):
        index, current = 0, next(messages, None)
        while current is not None:
            following = next(messages, None)
            index += 1
            yield from inner((*current, index == 1, following is None, index), messages)
            yield Mark.BREAK
            current = following

    return loop


def compiled(source: str) -> Callable[[Iterable[tuple[str, str]]], Iterator]:
    """A function from (role, text) pairs to an iterator over texts, marks; it reads one message ahead and keeps
    no others. A second loop of a template finds no message left, so a template may have one loop only."""
    tree = fold(parse(source))

    def loops(body) -> int:
        return sum(1 if s[0] == "for" else max((loops(b) for _, b in s[1]), default=0) if s[0] == "if" else loops(s[1]) if s[0] == "generation" else 0 for s in body)

    if loops(tree) > 1:
        raise TemplateError("one loop over the messages only")
    run = _block(tree)
    return lambda messages: run((), iter(messages))
