"""Definitions, calls and imports of source texts, by language.

Python goes through the standard library's ast (and, where a text doesn't
compile, by its lines' indentation). The languages with braces are cut into
tokens with matched brackets; recognisers find definitions by their heads and
their extents by the brackets, so strings, comments, templates and regular
expressions confuse neither. Everything is plain Python on one text, called from
the tasks that hold it.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

#: A callback passed as an argument is left out below so many tokens.
TRIVIAL_TOKENS = 30


@dataclass
class Definition:
    kind: str
    name: str
    start: int
    end: int
    calls: list[str] = field(default_factory=list)


@dataclass
class Parsed:
    """Definitions in the order of the language's kinds, then of the text; constants; imported names."""

    definitions: list[Definition]
    constants: list[Definition]
    imports: list[str]


class Lines:
    """Rows (from 0) of offsets."""

    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def row(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1


def parse_text(lang: str, text: str, tokens: Callable[[str], int]) -> Parsed:
    """tokens counts a string's tokens."""
    if lang == "python":
        return _python(text)
    source = Source(text, lang)
    found = {"java": _java, "go": _go, "rust": _rust}.get(lang, _script)(source, tokens)
    calls = sorted(source.calls())
    starts = [at for at, _, _ in calls]
    for d in found.definitions:
        d.calls = [c for _, _, c in calls[bisect_left(starts, d.start) : bisect_left(starts, d.end)]]
    return found


# ---- Python ----


def _python(text: str) -> Parsed:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_indentation(text)
    lines = text.splitlines(keepends=True) if "\f" in text or "\r" in text else re.findall(r"[^\n]*\n|[^\n]+", text)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))

    def at(row: int, column: int) -> int:
        """Offset of a row (from 1) and a column in bytes."""
        line = lines[row - 1] if row <= len(lines) else ""
        return starts[row - 1] + (column if line.isascii() else len(line.encode()[:column].decode(errors="ignore")))

    def own(node: ast.AST) -> tuple[int, int]:
        return at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)

    # every node is seen once, with the calls of the definitions around it; a definition's own decorators are outside it
    found, left = {"function": [], "class": []}, [(tree, ())]
    while left:
        node, around = left.pop()
        within = around
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            found[kind].append((Definition(kind, node.name, *own(node)), calls := []))
            within = (*around, calls)
        elif isinstance(node, ast.Call) and around:
            (low, high), (start, end) = own(node), own(node.func)
            for calls in around:
                calls.append((low, -high, text[start:end]))
        for name in node._fields:
            value = getattr(node, name, None) if name != "ctx" else None
            into = around if name == "decorator_list" else within
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, ast.AST):
                    left.append((x, into))
    for kind, pairs in found.items():
        for d, calls in pairs:
            d.calls = [c for _, _, c in sorted(calls)]
        found[kind] = [d for d, _ in pairs]
    constants, imports = [], []
    for node in tree.body:
        target = node.targets[0] if isinstance(node, ast.Assign) else node.target if isinstance(node, ast.AnnAssign) else None
        if isinstance(target, ast.Name) and not target.id.startswith("_"):
            constants.append(Definition("constant", target.id, *own(node)))
        if isinstance(node, ast.ImportFrom) and node.module == "__future__":
            continue
        if isinstance(node, ast.ImportFrom) and node.module and not node.level:
            imports.append(node.module)
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            imports += [x for a in node.names for x in (a.name, a.asname) if x and x != "*"]
    return Parsed([d for kind in found.values() for d in sorted(kind, key=lambda d: (d.start, -d.end))], constants, imports)


_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)


def _python_by_indentation(text: str) -> Parsed:
    found = []
    for m in _HEAD.finditer(text):
        end, start = m.end(), m.start() + len(m[1])
        for line in re.finditer(r"[^\n]*\n?", text[text.find("\n", m.end()) + 1 :] if "\n" in text[m.end() :] else ""):
            if line[0].strip():
                if len(line[0]) - len(line[0].lstrip(" \t")) <= len(m[1]):
                    break
                end = text.find("\n", m.end()) + 1 + line.start() + len(line[0].rstrip())
        calls = re.findall(r"(?<![\w.])(?!def\b|class\b|if\b|while\b|return\b|and\b|or\b|not\b|in\b|print\b(?=\s*\())([A-Za-z_][\w.]*)\s*\(", text[m.end() : end])
        found.append(Definition("class" if m[2] == "class" else "function", m[3], start, max(end, m.end()), calls))
    return Parsed(sorted(found, key=lambda d: (d.kind == "class", d.start)), [], [])


# ---- tokens of languages with braces ----

_SPACE = r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_WORD = r"(?P<word>[^\W\d][\w$]*|[$#][\w$]+|\$)|(?P<number>\d[\w.]*)"
_MARK = r"(?P<mark>=>|\?\.(?!\d)|::|->|&&|\|\||\?\?|\.\.\.|===|!==|==|!=|<=|>=|\+\+|--|:=|<-|[-+*/%&|^]=|.)"
_STRING = r"(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
_LEXERS = {
    "script": re.compile("|".join((_SPACE, _STRING, _WORD, _MARK)), re.S),
    "java": re.compile("|".join((_SPACE, r"(?P<block>\"\"\".*?(?:\"\"\"|\Z))", _STRING, _WORD, _MARK)), re.S),
    "go": re.compile("|".join((_SPACE, r"(?P<raw>`[^`]*(?:`|\Z))", _STRING, _WORD, _MARK)), re.S),
    "rust": re.compile("|".join((_SPACE, r"(?P<raw>b?r(?P<fence>#*)\".*?\"(?P=fence))", r"(?P<string>b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^']*|[^'\\\n])')|(?P<life>'\w+)", _WORD, _MARK)), re.S),
}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: A slash after one of these words begins a regular expression, and a bracket after one isn't a call.
_SCRIPT_WORDS = frozenset("if for while switch catch function return typeof await void delete new in of instanceof case do else throw yield import class extends with export default const let var".split())
_KEYWORDS = {
    "java": frozenset("if for while switch catch return new throw synchronized try assert do else case instanceof super this".split()) - {"super", "this"},
    "go": frozenset("if for switch select return func go defer range case type struct interface map chan var const import package else".split()),
    "rust": frozenset("if for while match return fn let in loop move mut ref as where impl dyn unsafe else pub use struct enum trait mod const static Fn FnMut FnOnce".split()),
}


class Source:
    """A text's tokens as (kind, text, start, end), with the partner of every bracket and the brackets around every token."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self.script = lang in ("javascript", "typescript", "tsx")
        self.typed = lang in ("typescript", "tsx")
        self.tokens: list[tuple[str, str, int, int]] = []
        self._cut(0, len(text))
        self.pair: dict[int, int] = {}
        self.around: list[int] = []
        open_: list[int] = []
        for i, (kind, t, _, _) in enumerate(self.tokens):
            if kind == "mark" and t in _CLOSE:
                # what a closing bracket doesn't fit is taken as unclosed
                match = next((k for k in range(len(open_) - 1, -1, -1) if self.tokens[open_[k]][1] == _CLOSE[t]), None)
                if match is not None:
                    self.pair[open_[match]], self.pair[i] = i, open_[match]
                    del open_[match:]
            self.around.append(open_[-1] if open_ else -1)
            if kind == "mark" and t in _OPEN:
                open_.append(i)
        #: brackets that are parameters, not arguments
        self.parameters: set[int] = set()
        #: tokens among which there are no calls
        self.quiet = bytearray(len(self.tokens))

    def hush(self, first: int, last: int) -> None:
        self.quiet[first : last + 1] = b"\1" * (last + 1 - first)

    def _cut(self, at: int, end: int, closing: bool = False) -> int:
        """Adds the tokens from `at`; with closing, up to the bracket that ends a template's expression. Returns where it stopped."""
        lexer, depth = _LEXERS["script" if self.script else self.lang], 0
        while at < end:
            if self.script and self.text[at] == "`":
                at = self._template(at, end)
                continue
            if self.script and self.text[at] == "/" and self.text[at : at + 2] not in ("//", "/*") and self._regex_here():
                m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(self.text, at)
                if m:
                    self.tokens.append(("string", m[0], at, m.end()))
                    at = m.end()
                    continue
            m = lexer.match(self.text, at)
            kind = "string" if m.lastgroup in ("raw", "block", "life", "fence") else m.lastgroup
            if closing and kind == "mark":
                depth += (m[0] == "{") - (m[0] == "}")
                if depth < 0:
                    return at
            if kind not in ("space", "comment"):
                self.tokens.append((kind, m[0], at, m.end()))
            at = m.end()
        return at

    def _template(self, at: int, end: int) -> int:
        """A template string: its text as string tokens, and the expressions in it between brackets."""
        start = at
        at += 1
        while at < end and self.text[at] != "`":
            if self.text[at] == "\\":
                at += 2
            elif self.text.startswith("${", at):
                self.tokens += [("template", self.text[start:at], start, at), ("mark", "{", at + 1, at + 2)]
                at = self._cut(at + 2, end, closing=True)
                if at < end:
                    self.tokens.append(("mark", "}", at, at + 1))
                start = at = min(at + 1, end)
            else:
                at += 1
        at = min(at + 1, end)
        if at > start:
            self.tokens.append(("string", self.text[start:at], start, at))
        return at

    def _regex_here(self) -> bool:
        if not self.tokens:
            return True
        kind, t, _, _ = self.tokens[-1]
        return t in _SCRIPT_WORDS if kind == "word" else kind == "mark" and t not in (")", "]", "}", "<")

    def at(self, i: int) -> str:
        """Text of token i; empty outside."""
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def start(self, i: int) -> int:
        return self.tokens[i][2]

    def end(self, i: int) -> int:
        return self.tokens[i][3]

    def close(self, i: int) -> int:
        """The partner of an opening bracket, or the last token."""
        return self.pair.get(i, len(self.tokens) - 1)

    def new_line(self, i: int) -> bool:
        """Token i begins a line."""
        return i == 0 or "\n" in self.text[self.end(i - 1) : self.start(i)]

    def operand_ends(self, i: int) -> bool:
        """An expression may end with token i."""
        kind, t = self.kind(i), self.at(i)
        return kind in ("number", "string") or t in (")", "]", "}", "++", "--") or kind == "word" and t not in _SCRIPT_WORDS

    def span(self, first: int, last: int) -> tuple[int, int]:
        return self.start(first), self.end(last)

    def chain(self, i: int) -> int:
        """The first token of the primary expression that ends with token i: names, members, indexes, calls."""
        while True:
            t = self.at(i)
            if t in (")", "]", "}") and i in self.pair:
                i = self.pair[i]
                before = self.kind(i - 1) in ("word", "string") and self.at(i - 1) not in _SCRIPT_WORDS or self.at(i - 1) in (")", "]", "!")
                if self.at(i) == "{" or not before or self.at(i) == "[" and self.new_line(i):
                    if self.at(i) == "(" and self.at(i - 1) == "?.":
                        i -= 2
                        continue
                    break
                i -= 1
                if self.at(i) == "!":
                    i -= 1
                continue
            if t == ">" and self.script:  # type arguments
                i = self.over_angles(i) - 1
                continue
            if self.at(i - 1) in (".", "?.", "::"):
                i -= 2
                if self.at(i) == ">" and self.lang == "rust":
                    while i > 0 and self.at(i) != "<":
                        i -= 1
                    i -= self.at(i - 1) == "::"
                    i -= 1
                continue
            break
        return i

    def over_angles(self, i: int) -> int:
        """The token that opens the type arguments which end with token i, or a token before them if none does."""
        depth, k = 0, i
        while k > max(0, i - 60):
            depth += (self.at(k) == ">") - (self.at(k) == "<")
            if not depth:
                break
            k -= 1
        return k

    def calls(self) -> Iterator[tuple[int, int, str]]:
        """(start, -end, callee) of all calls; sorted, outer ones come before what they hold."""
        words = _SCRIPT_WORDS - {"import"} if self.script else _KEYWORDS[self.lang]
        for i, (kind, t, start, end) in enumerate(self.tokens):
            if self.script and (kind in ("string", "template")) and self.text.startswith("`", start) and self.kind(i - 1) == "word" and self.at(i - 1) not in _SCRIPT_WORDS and self.end(i - 1) == start:
                first = self.chain(i - 1)
                yield self.start(first), -end, self.text[self.start(first) : self.end(i - 1)]
            if self.quiet[i]:
                continue
            if self.lang == "rust" and kind == "word" and self.at(i + 1) == "!" and self.at(i + 2) in _OPEN and t != "macro_rules" and self.start(i + 1) == end:
                first = self.chain(i)
                yield self.start(first), -self.end(self.close(i + 2)), self.text[self.start(first) : end]
                self.hush(i + 2, self.close(i + 2))
                continue
            if t != "(" or kind != "mark" or i in self.parameters:
                if self.script and t == "new" and kind == "word":  # without arguments, too
                    k = i + 1
                    while self.at(k + 1) == "." and self.kind(k + 2) == "word":
                        k += 2
                    if self.kind(k) == "word":
                        after = k + 1
                        if self.at(after) == "<":
                            while after < len(self.tokens) and self.at(after) not in ("(", ";"):
                                after += 1
                        last = self.close(after) if self.at(after) == "(" else k
                        yield start, -self.end(last), self.text[self.start(i + 1) : self.end(k)]
                continue
            before = i - 1
            if self.kind(before) == "word" and self.at(before) in words and self.at(before - 1) not in (".", "?."):
                continue
            if self.script and self.at(before) == "?.":
                before -= 1
            if self.script and self.at(before) == ">" and self.kind(before) == "mark":
                k = self.over_angles(before)
                if not self.typed or self.kind(k - 1) != "word":
                    continue
                before = k - 1
            generic = before
            if self.lang == "rust" and self.at(before) == ">":
                k = before
                while k > max(0, before - 60) and self.at(k) != "<":
                    k -= 1
                if self.at(k - 1) != "::":
                    continue
                generic = k - 2
            if self.kind(generic) not in ("word",) and self.at(generic) not in (")", "]", "}"):
                continue
            if self.at(generic) == "}" and self.lang != "go":
                continue
            if self.at(generic) == ")" and self.new_line(i):
                continue
            first = self.chain(generic)
            made = self.at(first - 1) == "new"
            last = self.close(i)
            if self.lang == "java":
                if self.at(first - 1) == "@" or self.kind(before) != "word" or self._enum_constant(before):
                    continue
                if made and not any(self.at(k) == "(" for k in range(first, before)):
                    continue  # the constructor's name
                yield self.start(first), -self.end(last), self.at(before)
                continue
            if made and self.script:
                if not any(self.at(k) == "(" for k in range(first, before + 1)):
                    continue  # given with its `new`
                first -= 1
            if self.lang == "go" and self.at(first) == "{":  # a function literal
                while first > 0 and self.at(first) != "func" and self.at(first - 1) not in (";", "}"):
                    first -= 1
            if self.lang == "go" and (self.at(first - 1) in ("]", "func") or self.at(first) == "{"):
                continue  # a conversion to a slice
            if self.lang == "rust" and (self.at(last + 1) == "=>" or self.at(first - 1) in ("let", "fn") or self.at(first - 1) == "|" and self.at(last + 1) in ("|", "=>")):
                continue  # a pattern
            yield self.start(first), -self.end(last), self.text[self.start(first) : self.end(before)]

    def _enum_constant(self, i: int) -> bool:
        around = self.around[i]
        head = around
        while head > 0 and self.at(head - 1) not in (";", "{", "}"):
            head -= 1
        return around >= 0 and any(self.at(k) == "enum" for k in range(head, around)) and self.at(i - 1) in ("{", ",")


# ---- JavaScript and TypeScript ----

_OBJECT_BEFORE = frozenset("= ( , [ ? return => && || ?? default : ... += yield await typeof in of case".split())
_MODIFIERS = frozenset("static async get set readonly override public private protected declare abstract accessor".split())


def _script(s: Source, tokens: Callable[[str], int]) -> Parsed:
    n = len(s.tokens)
    kinds: dict[int, str] = {}  # of braces
    found: dict[str, list[Definition]] = {k: [] for k in ("function", "arrow", "expression", "class", "method", "field")}
    arrows: list[tuple[int, int, int]] = []

    def brace_kind(i: int) -> str:
        if i not in kinds:
            before = s.at(i - 1)
            kind = "object" if before in _OBJECT_BEFORE and not (before == "=>") else "block"
            if before == ":":
                outer = s.around[i]
                kind = "type" if s.typed and (outer < 0 or s.at(outer) == "(" or brace_kind(outer) in ("class", "type", "block")) else "object"
            if before == "=" and s.typed:
                k = i - 2
                while k >= 0 and s.at(k) not in (";", "{", "}", "=") and not s.new_line(k + 1):
                    k -= 1
                if "type" in (s.at(k), s.at(k + 1), s.at(k + 2)):
                    kind = "type"
            kinds[i] = kind
        return kinds[i]

    def expression_end(i: int) -> int:
        """The last token of the expression that begins with token i."""
        inside = s.around[i]
        k = i
        while k < n:
            t = s.at(k)
            if s.kind(k) == "mark" and (t in (",", ";") or t in _CLOSE):
                return k - 1
            if k > i and s.new_line(k) and s.operand_ends(k - 1) and (s.kind(k) in ("word", "number", "string") and t not in ("in", "instanceof", "of", "as", "satisfies") or t in ("{", "@", "++", "--")):
                return k - 1
            k = s.close(k) + 1 if t in _OPEN and s.kind(k) == "mark" else k + 1
            if k < n and s.around[k] != inside and s.at(k) not in _CLOSE:
                return k - 1
        return n - 1

    def body_after(i: int) -> int | None:
        """The opening brace of a body after the parameters that close at token i; over a type, if there is one."""
        k = i + 1
        if s.typed and s.at(k) == ":":
            k, angles = k + 1, 0
            while k < n and (angles > 0 and s.at(k) == "," or s.at(k) not in (";", ",", ")", "=", "]", "}")):
                if s.at(k) == "{" and angles <= 0 and s.at(k - 1) not in (":", "|", "&", "=>", "is"):
                    break
                angles += (s.at(k) == "<") - (s.at(k) == ">")
                k = s.close(k) + 1 if s.at(k) in _OPEN else k + 1
        return k if s.at(k) == "{" else None

    def parameters_at(i: int) -> int | None:
        """The opening bracket at token i, or after type parameters there."""
        if s.at(i) == "<":
            depth = 0
            while i < n and not (s.at(i) == "(" and depth <= 0):
                depth += (s.at(i) == "<") - (s.at(i) == ">")
                i += 1
                if s.at(i) in (";", "{"):
                    return None
        return i if s.at(i) == "(" else None

    # heads of classes, interfaces, functions
    for i in range(n):
        kind, t = s.kind(i), s.at(i)
        if kind != "word" or s.at(i - 1) in (".", "?.") or s.at(i + 1) == ":" and t != "default":
            continue
        if t in ("class", "interface", "enum"):
            if t != "class" and not (s.typed and s.kind(i + 1) == "word"):
                continue
            named = s.kind(i + 1) == "word" and s.at(i + 1) not in ("extends", "implements")
            k = i + 1
            while k < n and s.at(k) != "{" and s.at(k) != ";":
                k = s.close(k) + 1 if s.at(k) in ("(", "[") else k + 1
            if s.at(k) != "{":
                continue
            kinds[k] = "class" if t == "class" else "type"
            statement = i == 0 or s.at(i - 1) in (";", "{", "}", "export", "default", "declare") or s.new_line(i) and s.operand_ends(i - 1)
            if t == "class" and named and statement:
                found["class"].append(Definition("class", s.at(i + 1), *s.span(i, s.close(k))))
        elif t == "function":
            first = i - 1 if s.at(i - 1) == "async" and not s.new_line(i) else i
            star = s.at(i + 1) == "*"
            name = i + 1 + star
            named = s.kind(name) == "word"
            opening = parameters_at(name + named)
            if opening is None:
                continue
            s.parameters.add(opening)
            body = body_after(s.close(opening))
            if body is None or star:
                continue
            kinds[body] = "block"
            statement = first == 0 or s.at(first - 1) in (";", "{", "}", "export", "else", "do") or s.at(first - 1) == "default" and named or s.new_line(first) and s.operand_ends(first - 1)
            if s.at(first - 1) == "{" and brace_kind(first - 1) == "object":
                statement = False
            if statement and named:
                found["function"].append(Definition("function", s.at(name), *s.span(first, s.close(body))))
            else:
                arrows.append((first, s.close(body), -(name + 1) if named else -1))
        elif t in ("catch", "if", "for", "while", "switch", "with") and s.at(i + 1) == "(":
            s.parameters.add(i + 1)

    # members of classes, and methods of objects
    for i in range(n):
        if s.at(i) != "{" or s.kind(i) != "mark":
            continue
        kind = brace_kind(i)
        if kind not in ("class", "object"):
            continue
        k, last = i + 1, s.close(i)
        while k < last:
            if s.at(k) in (";", ",") or s.at(k) == "@":
                if s.at(k) == "@":
                    k += 1
                    while s.at(k + 1) == ".":
                        k += 2
                    k = s.close(k + 1) if s.at(k + 1) == "(" else k
                k += 1
                continue
            first = k
            while s.at(k) in _MODIFIERS and s.at(k + 1) not in ("(", "=", ":", ";", ",", "}", "?", "!", "<") and not (s.new_line(k + 1) and s.at(k) not in ("static", "public", "private", "protected")):
                k += 1
            if s.at(k) == "{":  # static block
                k = s.close(k) + 1
                continue
            if s.at(k) == "*":
                k += 1
            name, name_end = k, k
            if s.at(k) == "[":
                name_end = s.close(k)
            k = name_end + 1
            if s.at(k) in ("?", "!"):
                k += 1
            opening = parameters_at(k) if s.kind(name) in ("word", "string", "number") or s.at(name) == "[" else None
            if opening is not None and (s.at(k) == "(" or s.at(k) == "<"):
                s.parameters.add(opening)
                body = body_after(s.close(opening))
                if body is not None:
                    kinds[body] = "block"
                    found["method"].append(Definition("method", s.text[s.start(name) : s.end(name_end)], *s.span(first, s.close(body))))
                    k = s.close(body) + 1
                    continue
                k = s.close(opening) + 1  # a signature without a body
                while k < last and s.at(k) not in (";", ",") and not s.new_line(k):
                    k = s.close(k) + 1 if s.at(k) in _OPEN else k + 1
                continue
            # a field, or a property of an object
            if kind == "object":
                k = name
                while k < last and s.at(k) != ",":
                    k = s.close(k) + 1 if s.at(k) in _OPEN else k + 1
                continue
            end = name_end
            while k < last and s.at(k) not in (";", "="):
                if s.new_line(k) and s.operand_ends(k - 1) and s.at(k) not in ("|", "&", ":", "?"):
                    break
                end = s.close(k) if s.at(k) in _OPEN else k
                k = end + 1
            if s.at(k) == "=" and k < last:
                end = expression_end(k + 1)
                k = end + 1
            if s.typed and (s.kind(name) in ("word", "string", "number") or s.at(name) == "["):
                found["field"].append(Definition("method", s.text[s.start(name) : s.end(name_end)], *s.span(first, end)))
            k = max(k, first + 1)

    def is_type(first: int) -> bool:
        """The arrow whose parameters begin with token `first` is a function type."""
        if not s.typed:
            return False
        before, outer = s.at(first - 1), s.around[first]
        if before == ":":
            if outer >= 0 and s.at(outer) == "(":
                return not any(s.at(k) == "?" for k in range(outer, first) if s.around[k] == outer and s.at(k + 1) != ":")
            return outer < 0 or brace_kind(outer) != "object"
        if before == "=":
            k = first - 1
            while k >= 0 and s.at(k) not in (";", "{", "}") and not (s.new_line(k) and s.at(k) in ("type", "export", "const", "let", "var")):
                k -= 1
            return "type" in (s.at(k), s.at(k + 1), s.at(k + 2)) and "const" not in (s.at(k), s.at(k + 1))
        inside_type = before == "=>" and outer >= 0 and s.at(outer) == "{" and brace_kind(outer) == "type"
        return before in ("|", "&", "<") or inside_type

    for i in range(n):
        if s.at(i) != "=>" or s.kind(i) != "mark":
            continue
        first, single = i - 1, False
        if s.at(first) == ")":
            first = s.pair.get(first, first)
        elif s.kind(first) == "word" and s.at(first - 1) not in (":", "|", "&", ".", ">"):
            single = True
        else:
            k = first  # over the type of the result
            while k > max(0, i - 80) and not (s.at(k) == ":" and s.at(k - 1) == ")"):
                if s.at(k) in (";", ",", "{", "=") and s.kind(k) == "mark":
                    k = -1
                    break
                k = s.pair[k] - 1 if s.at(k) in _CLOSE and k in s.pair else k - 1
            if k <= 0 or s.at(k) != ":":
                continue
            first = s.pair.get(k - 1, k - 1)
        if s.at(first) == "(":
            s.parameters.add(first)
        if s.at(first - 1) == ">" and s.typed:
            k = s.over_angles(first - 1)
            first = k if s.at(k - 1) in ("=", "(", ",", ":", "async") else first
        if s.at(first - 1) == "async" and not s.new_line(first):
            first -= 1
        if is_type(first):
            continue
        if s.at(i + 1) == "{":
            kinds[i + 1] = "block"
            last = s.close(i + 1)
        elif i + 1 < n:
            last = expression_end(i + 1)
        else:
            continue
        alone = i + 1 if last == i + 1 and s.kind(last) == "word" and s.at(last) not in ("this", "null", "undefined", "true", "false", "super") else None
        name = i - 1 if single else alone
        arrows.append((first, last, name + 1 if name is not None else 0))

    for first, last, named in sorted(arrows):
        expression = named < 0
        if s.lang != "javascript" and expression:
            continue
        argument, callee = _argument_of(s, first)
        low, high = s.span(first, last)
        if argument and tokens(s.text[low:high]) < TRIVIAL_TOKENS:
            continue
        at = abs(named) - 1
        if expression and named == -1:
            at = -1
        name = s.at(at) if named and at >= 0 else _assigned_name(s, first, brace_kind) or (f"{callee}()callback" if argument and callee else "")
        found["expression" if expression else "arrow"].append(Definition("function", name or s.text[low:high].split("\n")[0][:80], low, high))

    order = ("function", "arrow", "expression", "class", "method", "field")
    definitions = [d for k in order for d in sorted(found[k], key=lambda d: (d.start, -d.end))]
    return Parsed(definitions, _script_constants(s, expression_end), _script_imports(s))


def _argument_of(s: Source, first: int) -> tuple[bool, str]:
    """Whether the expression at token `first` is an argument, and the callee of a call (empty for `new`)."""
    opening = s.around[first]
    if opening < 0 or s.at(opening) != "(" or opening in s.parameters or s.at(first - 1) not in ("(", ","):
        return False, ""
    before = opening - 1
    if s.at(before) == "?.":
        before -= 1
    if s.at(before) == ">" and s.typed:
        before = s.over_angles(before) - 1
    if not (s.kind(before) == "word" and s.at(before) not in _SCRIPT_WORDS or s.at(before) in (")", "]")):
        return False, ""
    start = s.chain(before)
    if s.at(start - 1) == "new" and not any(s.at(k) == "(" for k in range(start, before + 1)):
        return True, ""
    return True, s.text[s.start(start) : s.end(before)].split("\n")[0].strip()[:60]


def _assigned_name(s: Source, first: int, brace_kind: Callable[[int], str]) -> str:
    """Name of what the expression at token `first` is bound to: a variable, a field, a property or what is assigned."""
    before, outer = s.at(first - 1), s.around[first]
    if before == ":" and outer >= 0 and s.at(outer) == "{" and brace_kind(outer) == "object":
        key = first - 2
        begin = s.pair.get(key, key) if s.at(key) == "]" else key
        return s.text[s.start(begin) : s.end(key)]
    if before != "=":
        return ""
    k = first - 2
    if s.typed:  # over an annotation
        j = k
        while j > 0 and s.around[j] == s.around[first - 1] and s.at(j) not in (";", ",", "=", "const", "let", "var") and s.at(j) != ":":
            j = s.pair[j] - 1 if s.at(j) in _CLOSE and j in s.pair else j - 1
        if s.at(j) == ":":
            k = j - 1
            if s.at(k) in ("?", "!"):
                k -= 1
    if s.at(k) in _CLOSE and s.at(k) != ")" and s.at(s.pair.get(k, k) - 1) in ("const", "let", "var", ","):
        return s.text[s.start(s.pair[k]) : s.end(k)]
    begin = s.chain(k)
    return s.text[s.start(begin) : s.end(k)].strip()


def _script_constants(s: Source, expression_end: Callable[[int], int]) -> list[Definition]:
    out, n = [], len(s.tokens)
    for i in range(n):
        if s.around[i] >= 0 or s.at(i) not in ("const", "let", "var") or s.kind(i) != "word":
            continue
        if not (i == 0 or s.at(i - 1) in (";", "}") or s.new_line(i)) or s.at(i - 1) in ("export", "declare"):
            continue
        k = i + 1
        while k < n and s.kind(k) in ("word", "mark") and s.at(k) != "enum":
            name, end = k, s.close(k) if s.at(k) in _OPEN else k
            k = end + 1
            if s.typed and s.at(k) in (":", "!"):
                angles = 0
                while k < n and (angles > 0 or s.at(k) not in (";", ",", "=") and not (s.new_line(k) and s.operand_ends(k - 1))):
                    angles += (s.at(k) == "<") - (s.at(k) == ">")
                    end = s.close(k) if s.at(k) in _OPEN else k
                    k = end + 1
            function = False
            if s.at(k) == "=":
                value, end = k + 1, expression_end(k + 1)
                k = end + 1
                head = value + (s.at(value) == "async")
                after = s.close(head) + 1 if s.at(head) == "(" else head + 1
                function = s.at(head) in ("function", "class") or s.at(after) == "=>" and s.at(head) != "[" or s.typed and (s.at(head) == "<" or s.at(head) == "(" and s.at(after) == ":" and any(s.at(j) == "=>" for j in range(after, end + 1)))
            if s.kind(name) == "word" and not s.at(name).startswith("_") and not function:
                out.append(Definition("constant", s.at(name), *s.span(name, end)))
            if s.at(k) != ",":
                break
            k += 1
    return out


def _script_imports(s: Source) -> list[str]:
    out = []
    for i in range(len(s.tokens)):
        if s.around[i] < 0 and s.at(i) == "import" and s.kind(i) == "word" and s.at(i + 1) not in ("(", "."):
            k = i + 1
            while k < len(s.tokens) and s.kind(k) != "string" and s.at(k) not in (";", "=") and not (s.new_line(k) and s.at(k) in ("import", "const", "export")):
                k = s.close(k) + 1 if s.at(k) == "{" else k + 1
            if s.kind(k) == "string" and (k == i + 1 or s.at(k - 1) == "from"):
                out.append(s.at(k).strip("\"'"))
    return [x for x in out if x]


# ---- Java ----

_JAVA_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())


def _java(s: Source, tokens: Callable[[str], int]) -> Parsed:
    n = len(s.tokens)
    bodies: list[tuple[int, bool]] = []
    found: dict[str, list[Definition]] = {"function": [], "class": [], "interface": []}

    def modifiers_before(i: int) -> int:
        while i > 0:
            if s.at(i - 1) in _JAVA_MODIFIERS:
                i -= 1
            elif s.at(i - 1) == ")" and (i - 1) in s.pair and s.kind(s.pair[i - 1] - 1) == "word" and s.at(s.pair[i - 1] - 2) == "@":
                i = s.pair[i - 1] - 2
            elif s.kind(i - 1) == "word" and s.at(i - 2) == "@":
                i -= 2
            else:
                break
        return i

    for i in range(n):
        if s.kind(i) == "word" and s.at(i) in ("class", "interface", "enum", "record") and s.kind(i + 1) == "word" and s.at(i - 1) != ".":
            k = i + 2
            while k < n and s.at(k) not in ("{", ";"):
                k = s.close(k) + 1 if s.at(k) == "(" else k + 1
            if s.at(k) != "{":
                continue
            bodies.append((k, s.at(i) == "enum"))
            if s.at(i) == "record" and s.at(i + 2) == "(":
                s.parameters.add(i + 2)
            if s.at(i) == "class" or s.at(i) == "interface" and s.at(i - 1) != "@":
                found[s.at(i)].append(Definition("class", s.at(i + 1), *s.span(modifiers_before(i), s.close(k))))
        elif s.at(i) == "{" and s.at(i - 1) == ")" and (i - 1) in s.pair:
            k = s.chain(s.pair[i - 1] - 1) if s.at(s.pair[i - 1] - 1) != ">" else s.pair[i - 1] - 1
            while s.at(k) in (">", "<", ",") or s.kind(k) == "word" and s.at(k) != "new" and s.at(k - 1) in ("<", ",", ".", "new"):
                k -= 1
            if s.at(k) == "new" or s.at(k - 1) == "new":
                bodies.append((i, False))  # an anonymous class
    for opening, enum in bodies:
        k, last = opening + 1, s.close(opening)
        if enum:
            while k < last and s.at(k) != ";":
                k = s.close(k) + 1 if s.at(k) in _OPEN else k + 1
            k += 1
        while k < last:
            first = k
            while s.at(k) in _JAVA_MODIFIERS or s.at(k) == "@":
                if s.at(k) == "@" and s.at(k + 1) != "interface":
                    k += 2
                    while s.at(k) == ".":
                        k += 2
                    k = s.close(k) + 1 if s.at(k) == "(" else k
                else:
                    k += 1
            if s.at(k) == "<":
                depth = 0
                while k < last:
                    depth += (s.at(k) == "<") - (s.at(k) == ">")
                    k += 1
                    if not depth:
                        break
            head = k
            while k < last and s.at(k) not in ("(", "=", ";", "{"):
                k = s.close(k) + 1 if s.at(k) == "[" else k + 1
            if s.at(k) == "(" and k < last:
                s.parameters.add(k)
                name, k = k - 1, s.close(k) + 1
                while k < last and s.at(k) not in ("{", ";"):
                    k += 1
                end = s.close(k) if s.at(k) == "{" else k
                if name > head and s.at(head) not in ("class", "interface", "enum", "record"):
                    found["function"].append(Definition("function", s.at(name), *s.span(first, min(end, last))))
                k = end + 1
            elif s.at(k) == "{":
                k = s.close(k) + 1
            else:
                while k < last and s.at(k) != ";":
                    k = s.close(k) + 1 if s.at(k) in _OPEN else k + 1
                k += 1
    imports = [s.at(i + 1) for i in range(n) if s.around[i] < 0 and s.at(i) == "import" and s.kind(i + 1) == "word" and s.at(i + 2) == ";"]
    unique = lambda ds: sorted({(d.start, d.end): d for d in ds}.values(), key=lambda d: (d.start, -d.end))
    return Parsed([d for k in ("function", "class", "interface") for d in unique(found[k])], [], imports)


# ---- Go ----


def _go(s: Source, tokens: Callable[[str], int]) -> Parsed:
    n = len(s.tokens)
    functions, methods, types = [], [], []
    for i in range(n):
        if s.kind(i) != "word":
            continue
        if s.at(i) == "func":
            k = i + 1
            receiver = s.around[i] < 0 and s.at(k) == "(" and s.kind(s.close(k) + 1) == "word" and s.at(s.close(k) + 2) in ("(", "[")
            if s.at(k) == "(":
                s.parameters.add(k)
                if receiver:
                    k = s.close(k) + 1
            name = k if s.kind(k) == "word" else None
            k += name is not None
            if name is not None and s.at(k) == "[":
                k = s.close(k) + 1
            if s.at(k) != "(":
                continue
            s.parameters.add(k)
            k = s.close(k) + 1
            if s.at(k) == "(":
                s.parameters.add(k)
                k = s.close(k) + 1
            end = k - 1
            while k < n and not (s.at(k) == "{" and s.at(k - 1) not in ("interface", "struct")) and not (s.new_line(k) and s.operand_ends(k - 1)) and s.at(k) not in (")", ",", ";", "}"):
                end = s.close(k) if s.at(k) in _OPEN else k
                k = end + 1
            if s.at(k) == "{":
                end = s.close(k)
            if name is not None and s.around[i] < 0:
                (methods if receiver else functions).append(Definition("function", s.at(name), *s.span(i, end)))
        elif s.at(i) == "interface" and s.at(i + 1) == "{":
            s.hush(i + 1, s.close(i + 1))
        elif s.at(i) == "type" and (s.new_line(i) or s.at(i - 1) in ("{", ";")) and (s.at(i + 1) == "(" or s.kind(i + 1) == "word"):
            k = end = s.close(i + 1) if s.at(i + 1) == "(" else i + 1
            if s.at(i + 1) == "(":
                s.parameters.add(i + 1)
            else:
                k += 1
                while k < n and not (s.new_line(k) and s.operand_ends(k - 1)) and s.at(k) not in (";", ")", "}"):
                    end = s.close(k) if s.at(k) in _OPEN else k
                    k = end + 1
            low, high = s.span(i, end)
            types.append(Definition("class", s.text[low:high].split("\n")[0][:80], low, high))
    return Parsed(functions + methods + types, [], [])


# ---- Rust ----

_RUST_BEFORE = frozenset("pub async const unsafe extern default crate".split())


def _rust(s: Source, tokens: Callable[[str], int]) -> Parsed:
    n = len(s.tokens)
    found: dict[str, list[Definition]] = {k: [] for k in ("fn", "impl", "struct", "enum", "trait")}
    inside_macro = bytearray(n)
    for i in range(n - 2):
        if s.kind(i) == "word" and s.at(i + 1) == "!" and (s.at(i + 2) in _OPEN or s.at(i) == "macro_rules"):
            k = i + 2 if s.at(i + 2) in _OPEN else i + 3
            inside_macro[k : s.close(k)] = b"\1" * (s.close(k) - k)
            if s.at(i) == "macro_rules":
                s.hush(i, s.close(k))
    for i in range(n):
        t = s.at(i)
        if s.kind(i) != "word" or t not in found or inside_macro[i]:
            continue
        named = s.kind(i + 1) == "word"
        if t == "impl" and not (i == 0 or s.at(i - 1) in (";", "{", "}", "]", "unsafe", "default")) or t != "impl" and not named:
            continue
        first = i
        while first > 0 and (s.at(first - 1) in _RUST_BEFORE or s.kind(first - 1) == "string" and s.at(first - 2) == "extern" or s.at(first - 1) == ")" and s.at(s.pair.get(first - 1, 0) - 1) == "pub"):
            first = s.pair[first - 1] - 1 if s.at(first - 1) == ")" else first - 1
        k = i + 1
        while k < n and s.at(k) not in ("{", ";"):
            if s.at(k) == "(":
                s.parameters.add(k)
            k = s.close(k) + 1 if s.at(k) in ("(", "[") else k + 1
        if k >= n or s.at(k) == ";" and t in ("fn", "impl", "trait", "enum"):
            continue
        end = s.close(k) if s.at(k) == "{" else k
        if t in ("enum", "struct"):
            s.hush(i, end)
        low, high = s.span(first, end)
        name = s.at(i + 1)
        if t == "impl":
            name = _impl_name(s, i + 1, k) or s.text[low:high].split("\n")[0][:80]
        found[t].append(Definition("function" if t in ("fn", "impl") else "class", name, low, high))
    imports = [s.at(i + 1) for i in range(n) if s.around[i] < 0 and s.at(i) == "use" and s.kind(i + 1) == "word" and s.at(i + 2) == ";"]
    return Parsed([d for k in found.values() for d in sorted(k, key=lambda d: (d.start, -d.end))], [], imports)


def _impl_name(s: Source, i: int, end: int) -> str:
    """The first plain type of an impl's head; empty if its types are generic or paths."""
    if s.at(i) == "<":
        depth = 0
        while i < end:
            depth += (s.at(i) == "<") - (s.at(i) == ">")
            i += 1
            if not depth:
                break
    heads = [i] + [k + 1 for k in range(i, end) if s.at(k) == "for"]
    for k in heads:
        if s.kind(k) == "word" and s.at(k + 1) not in ("<", "::", "!"):
            return s.at(k)
    return ""
