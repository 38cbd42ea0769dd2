"""Source text to tokens with their brackets: the one step that a pattern cannot do, as templates nest in placeholders.

A text is read once from front to end with a stack of open brackets. All that looks beyond a token's own bracket, its
neighbours, statements, calls, what an expression takes its value from, is made of the table by windows and joins.
"""

from __future__ import annotations

import re

# Alternatives in order; white space between tokens is passed over.
_CODE = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+')|(?P<number>\d[\w.]*)|(?P<name>(?:[^\W\d]|\$)[\w$]*)|(?P<template>`)|(?P<error>[\"']|/\*)"
    r"|(?P<mark>===|!==|==|!=|=>|\.\.\.|&&=?|\|\|=?|\?\?=?|\?\.|\+\+|--|<=|>=|[-+*/%&|^]=|[{}()\[\];,.<>+\-*/%&|^!~?:=@#])", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+")
_CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+", re.S)

# Marks and words of the language by what they do to the value of an expression.
BLOCKERS = frozenset("|| && ?? ? : => = += -= *= /= %= &= |= ^= ||= &&= ??= ; ,".split())
BINARY = frozenset("+ - * / % & | ^ < > <= >= == != === !==".split())
NO_VALUE = frozenset("new await typeof void delete function class async yield".split())
BEFORE_VALUE = frozenset("return throw case default else do const let var export import extends finally try".split())
HEADS = frozenset("if for while switch catch with".split())
OPENS = {")": "(", "]": "[", "}": "{"}
CARRIES = frozenset(("group", "hole"))

FIELDS = ("pos", "kind", "text", "line", "depth", "parent", "close", "role", "region", "top", "gives", "spoilt", "core", "alone", "sole", "chunks")
SCHEMA = (
    "pos int, kind string, text string, line int, depth int, parent int, close int, role string, region int, top int, gives boolean, spoilt boolean, core int, alone string, "
    "sole array<string>, chunks array<string>")


class Token:
    """kind: name, string, template, number, regex, mark, hole (bounds of a template's placeholder), error (text says of what).
    A template is one token, and the tokens of its placeholders follow it. role of brackets: call, group, params, head (of if,
    for and so on), index, array, block, brace, hole. region: the placeholder that it stands in. top: for what stands in groups
    and placeholders the outermost of these. gives: an operand has its value from it. spoilt: parentheses or a
    placeholder whose expression gives no value on. Parentheses that hold one thing alone
    amount to it: core is the innermost of them, alone the kind of what stands there, sole its names (a template's: those
    that its placeholders amount to). chunks: a template's own text."""

    __slots__ = FIELDS

    def __init__(self, pos: int, kind: str, text: str, line: int, frames: list[_Frame]):
        f = frames[-1]
        self.pos, self.kind, self.text, self.line, self.depth, self.parent = pos, kind, text, line, len(frames) - 1, f.pos
        self.region, self.top, self.gives, self.spoilt = f.region, f.top if f.role in CARRIES else None, False, False
        self.close = self.role = self.core = self.alone = self.sole = self.chunks = None


class _Frame:
    """An open bracket, and the operand that is at hand in it."""

    __slots__ = ("bracket", "closed", "end", "first", "fresh", "n", "pos", "prev", "region", "role", "spoilt", "start", "template", "text", "top")

    def __init__(self, bracket: Token | None, role: str, region: int, top: int | None = None, template: list | None = None):
        self.bracket, self.role, self.region, self.top, self.template = bracket, role, region, top, template
        self.pos, self.text = (bracket.pos, bracket.text) if bracket else (None, "")
        self.fresh, self.end, self.spoilt = True, False, False  # an operand may begin; one is complete; no value comes of all this
        self.prev = self.start = self.first = self.closed = None
        self.n = 0

    def operand(self, token: Token, gives: bool) -> None:
        self.start, self.fresh, token.gives = token, False, gives

    def void(self) -> None:
        if self.start:
            self.start.gives = False

    def after(self, text: str, *, end: bool, fresh: bool) -> None:
        self.prev, self.end, self.fresh = text, end, fresh

    def shut(self, closing: Token) -> None:
        b = self.bracket
        b.close, closing.role = closing.pos, b.role
        b.spoilt = self.spoilt and self.role in CARRIES
        b.core = b.pos
        if self.first and (self.n == 1 or (self.n == 2 and self.first.role == "group")):
            b.sole, b.alone = self.first.sole, self.first.alone
            b.core = self.first.core or b.pos


def _role(f: _Frame, mark: str) -> str:
    if mark == "(":
        return "head" if f.prev in HEADS else "params" if f.prev == "function" or f.closed == "function" else "call" if f.end else "group"
    if mark == "[":
        return "index" if f.end else "array"
    return "block" if f.prev in (None, ")", "=>", ";", "{", "}", "else", "do", "try", "finally") else "brace"


def _mark(f: _Frame, token: Token, frames: list[_Frame]) -> None:
    own = token.text
    if own in "([{":
        token.role = _role(f, own)
        if own == "{" and f.prev == ")" and f.closed.role == "call":
            f.closed.role = "params"  # name(...) { declares a method
        if f.fresh:
            f.operand(token, token.role == "group")
        top = token.top if token.top is not None else token.pos
        frames.append(_Frame(token, token.role, f.region, top if token.role == "group" else None))
    elif own in BINARY and (f.end or (own in "*<>" and f.prev == own)):
        f.start = None
        f.after(own, end=False, fresh=True)
    elif own in BLOCKERS:
        if own == "=>" and f.prev == ")":
            f.closed.role = "params"
        f.spoilt, f.start = True, None
        f.after(own, end=False, fresh=True)
    elif own in ("++", "--", "?."):
        if f.fresh:
            f.operand(token, False)
        f.void()
        f.after(own, end=f.end and own != "?.", fresh=False)
    else:
        if f.fresh and own != ".":
            f.operand(token, False)
        f.after(own, end=False, fresh=False)


def _word(f: _Frame, token: Token) -> None:
    own, member = token.text, f.prev in (".", "?.", "#")
    word = token.kind == "name" and not member
    if word and own in ("in", "instanceof", "of") and f.end:
        f.start = None
        f.after(own, end=False, fresh=True)
    elif word and (own in BEFORE_VALUE or own in HEADS):
        f.start = None
        f.after(own, end=False, fresh=True)
    elif word and own in NO_VALUE:
        if f.fresh or f.end:
            f.operand(token, False)
        f.after(own, end=False, fresh=False)
    else:
        f.closed = "function" if f.prev == "function" else None
        if (f.fresh or f.end) and not member:
            f.operand(token, word)
            token.sole, token.alone = ([own], "name") if word else (None, token.kind)
        f.after(own, end=True, fresh=False)


def lex(content: str | None) -> list[Token]:
    text = content or ""
    out: list[Token] = []
    frames = [_Frame(None, "file", 0)]
    open_templates: list[tuple[Token, int]] = []
    at = counted = 0
    line = 1

    def put(kind: str, own: str, where: int) -> Token:
        nonlocal line, counted
        line, counted = line + text.count("\n", counted, where), where
        out.append(Token(len(out) + 1, kind, own, line, frames))
        return out[-1]

    def chunk() -> None:
        """A template's own text up to its next placeholder or its end."""
        nonlocal at
        token, start = open_templates[-1]
        m = _CHUNK.match(text, at)
        token.chunks.append(m[0])
        at = m.end()
        if text.startswith("${", at):
            hole = put("hole", "${", at)
            hole.role, hole.top = "hole", token.top if token.top is not None else token.pos
            frames.append(_Frame(hole, "hole", hole.pos, hole.top, token))
            at += 2
            return
        open_templates.pop()
        if at == len(text):
            put("error", "text", at)
        at = min(at + 1, len(text))
        token.text = text[start:at]

    while m := _CODE.search(text, at):
        kind, own, where, f = m.lastgroup, m[0], m.start(), frames[-1]
        at = m.end()
        if own[0] == "/" and kind == "mark" and not f.end and (r := _REGEX.match(text, where)):
            kind, own, at = "regex", r[0], r.end()
        if kind == "comment":
            continue
        if kind == "error" or (own in OPENS and f.text != OPENS[own] and not (own == "}" and f.role == "hole")):
            put("error", "text" if kind == "error" else "bracket", where)
            continue
        if own in OPENS:
            frames.pop()
            token = put("hole" if f.role == "hole" else "mark", own, where)
            f.shut(token)
            if f.role == "hole":
                f.template.close = token.pos
                f.template.sole += (f.bracket.alone == "name" and f.bracket.sole) or []
                chunk()
                continue
            outer, block = frames[-1], f.role in ("head", "params", "block")
            outer.closed = f.bracket
            outer.n += 1
            outer.after(own, end=not block, fresh=block)
            continue
        token = put(kind, own, where)
        f.n += 1
        f.first = f.first or token
        if kind == "mark":
            _mark(f, token, frames)
        elif kind == "template":
            if f.fresh:
                f.operand(token, True)
            else:
                f.void()  # a tag's text, or the next statement
            f.after(own, end=True, fresh=False)
            token.chunks, token.sole, token.alone = [], [], "template"
            open_templates.append((token, where))
            chunk()
        else:
            _word(f, token)
    for f in frames[1:]:
        put("error", "text" if f.role == "hole" else "bracket", len(text))
    return out
