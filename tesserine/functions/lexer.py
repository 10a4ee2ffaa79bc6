"""Tokens of source text, and what its declarations are by a walk over them.

One pass over the characters: comments, strings (raw, triple, template, heredoc) and regular
expressions are tokens of their own, so nothing in them looks like a declaration; brackets are
kept on a stack, so what stands within a function is known. Both are linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_LINE_STRINGS = r'"(?:\\.|[^"\\\n])*"?' + r"|'(?:\\.|[^'\\\n])*'?"
_LONG_STRINGS = r'"(?:\\.|[^"\\])*(?:"|\Z)' + r"|'(?:\\.|[^'\\])*(?:'|\Z)"
#: Comments and strings by language.
_SYNTAX = {
    "go": (_C_COMMENT, _LINE_STRINGS + r"|`[^`]*(?:`|\Z)"),
    "js": (_C_COMMENT, _LINE_STRINGS),
    "css": (r"/\*.*?(?:\*/|\Z)", _LINE_STRINGS),
    "py": (r"#[^\n]*", r'(?:[rRbBuUfFtT]{1,2})?(?:"""(?:\\.|[^\\])*?(?:"""|\Z)' + r"|'''(?:\\.|[^\\])*?(?:'''|\Z)|" + _LINE_STRINGS + ")"),
    "php": (_C_COMMENT + r"|#(?!\[)[^\n]*", r"<<<[ \t]*(?P<q>['\"]?)(?P<doc>\w+)(?P=q)\n.*?(?:\n[ \t]*(?P=doc)\b|\Z)|\?>.*?(?:<\?(?:php\b|=)|\Z)|" + _LONG_STRINGS),
    "rb": (r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)|#[^\n]*", r"<<[~-]?(?P<q>['\"]?)(?P<doc>[A-Z_]\w*)(?P=q)[^\n]*\n.*?(?:^[ \t]*(?P=doc)\b|\Z)|%[qQwWiI]?\{[^}]*\}|" + _LONG_STRINGS),
}
_MASTER = {
    ext: re.compile(rf"(?P<c>{comment})|(?P<s>{string})|(?P<w>[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*)|(?P<n>\n)|(?P<p>=>|::|\S)|[^\S\n]+", re.S | re.M) for ext, (comment, string) in _SYNTAX.items()
}
ALIASES = {"jsx": "js", "ts": "js", "tsx": "js"}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\.?|[^`\\$]|\$(?!\{))*(`|\$\{|\Z)", re.S)
#: Words after which a slash begins a regular expression.
_OPERATORS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}


class Token(NamedTuple):
    """kind: c(omment), s(tring), w(ord), n(ewline) or p(unctuation)."""

    kind: str
    text: str
    start: int
    end: int
    line: int


def tokens(text: str, ext: str) -> Iterator[Token]:
    """All tokens but blanks, lines from 0."""
    ext = ALIASES.get(ext, ext)
    at, line = 0, 0
    if ext == "php" and "<?" in text:
        at = text.index("<?")
        line = text.count("\n", 0, at)
    if ext == "js":
        yield from _script_tokens(text)
        return
    for m in _MASTER[ext].finditer(text, at):
        kind = m.lastgroup  # of nested groups the outer one closes last; blanks have none
        if kind:
            value = m[0]
            yield Token(kind, value, m.start(), m.end(), line)
            if kind == "n":
                line += 1
            elif kind in "cs":
                line += value.count("\n")


#: What matters within braces: comments, strings and brackets, each beginning with a fixed sign, so that the search leaps to them.
_WITHIN = re.compile(_SYNTAX["go"][0] + "|" + _SYNTAX["go"][1] + r"|\(|\)|\[|\]|\{|\}", re.S | re.M)
_PLAIN = re.compile(r"[^()\[\]{}\"'`/]*\}")
_MASTER_GO = _MASTER["go"].finditer


def go_tokens(text: str) -> list[Token]:
    """Tokens of a Go file, of which those within braces are left out but for comments: no walk over declarations enters braces.

    Brackets right after ``type``, which a walk may enter, keep all tokens, and so does a file whose brackets don't match.
    """
    out: list[Token] = []
    new, add = tuple.__new__, out.append
    at, line, depth, kept, before = 0, 0, 0, False, ""
    while True:
        for m in _MASTER_GO(text, at):
            kind = m.lastgroup
            if kind is None:
                continue
            value = m[0]
            start, end = m.span()
            add(new(Token, (kind, value, start, end, line)))
            if kind == "c":
                line += value.count("\n")
                continue
            if kind == "n":
                line += 1
            elif kind == "s":
                line += value.count("\n")
            elif kind == "p":
                if value in "([{":
                    kept = depth > 0 and kept or not depth and before == "type"
                    if value == "{" and not kept:
                        break
                    depth += 1
                elif value in ")]}" and depth:
                    depth -= 1
            before = value
        else:
            return list(tokens(text, "go")) if depth else out
        m = _PLAIN.match(text, end)
        if m:
            at = m.end()
            line += text.count("\n", end, at)
        else:
            inner, last = 1, end
            for m in _WITHIN.finditer(text, end):
                value = m[0]
                if value in "([{":
                    inner += 1
                elif value in ")]}":
                    inner -= 1
                    if not inner:
                        break
                elif value[0] == "/":
                    line += text.count("\n", last, m.start())
                    last = m.start()
                    add(new(Token, ("c", value, last, m.end(), line)))
            else:
                return list(tokens(text, "go"))
            at = m.end()
            line += text.count("\n", last, at)
        before = text[at - 1]
        add(new(Token, ("p", before, at - 1, at, line)))


def _script_tokens(text: str) -> Iterator[Token]:
    """Tokens where a slash may begin a regular expression and a template may hold code."""
    match = _MASTER["js"].match
    at, line, last = 0, 0, ""
    templates: list[int] = []  # open braces within each template's substitution
    while at < len(text):
        kind = value = ""
        if text[at] == "/" and (not last or last in _OPERATORS or not re.match(r"[\w$)\]}]", last[-1])) and (m := _REGEX.match(text, at)):
            kind, value = "s", m[0]
        elif text[at] == "`" or text[at] == "}" and templates and not templates[-1]:
            if text[at] == "}":
                templates.pop()
            m = _TEMPLATE.match(text, at + 1)
            kind, value = "s", text[at : m.end()]
            if m[1] == "${":
                templates.append(0)
        else:
            m = match(text, at)
            kind, value = m.lastgroup, m[0]
            if templates and value in ("{", "}"):
                templates[-1] += 1 if value == "{" else -1
        if kind:
            yield Token(kind, value, at, at + len(value), line)
            if kind not in "cn":
                last = ";" if kind == "s" and value.endswith("${") else value
        line += value.count("\n") if kind in ("c", "s", "n") else 0
        at += len(value)


def _closings(code: list[Token], restart: frozenset[str] = frozenset()) -> list[int]:
    """For each bracket the place after the one that closes it; for other tokens 0.

    A bracket that nothing closes ends before the next line that begins with a word of
    ``restart``, so that one mistake doesn't swallow the rest of the file.
    """
    out, stack = [0] * len(code), []
    for i, t in enumerate(code):
        if t.kind == "p":
            if t.text in ("(", "[", "{"):
                stack.append(i)
            elif t.text in (")", "]", "}") and stack:
                out[stack.pop()] = i + 1
    if stack:
        after, unclosed = len(code), set(stack)
        for i in range(len(code) - 1, -1, -1):
            if i in unclosed:
                out[i] = after
            if code[i].text in restart and code[i].kind == "w" and (i == 0 or code[i - 1].kind == "n") and code[i].start == (code[i - 1].end if i else 0):
                after = max(i - 1, 0)  # the line break before it
    return out


_GO_TOP = frozenset({"func", "type", "package", "import"})


def _words(code: list[Token], at: int, n: int = 1) -> tuple[str, ...]:
    return tuple(t.text for t in code[at : at + n])


# Go ----------------------------------------------------------------------------------------


class Declaration(NamedTuple):
    """start and end are offsets of characters, lines count from 1."""

    kind: str
    name: str
    receiver: str | None
    type_name: str | None
    type_kind: str | None
    start: int
    end: int
    start_line: int
    end_line: int


def _go_end(code: list[Token], after: list[int], at: int, body: bool) -> int:
    """The place after a declaration that goes on at ``at``: after its body, or at the end of its line."""
    typed = False
    while at < len(code):
        t = code[at]
        if t.kind == "n" or t.text in (";", ")"):
            return at
        if t.text in ("(", "[", "{"):
            at = after[at]
            if body and t.text == "{" and not typed:
                return at
            typed = False
            continue
        typed = t.text in ("struct", "interface")
        at += 1
    return at


def _go_type(code: list[Token], after: list[int], at: int) -> tuple[Declaration | None, int]:
    """The type of a spec whose name is at ``at``, and the place after it."""
    if code[at].kind != "w":
        return None, at + 1
    i = at + 1
    if _words(code, i) == ("[",) and i + 2 < len(code) and code[i + 1].kind == "w" and code[i + 2].text != "]":
        i = after[i]  # type parameters; an array's length would be a number or a lone name
    if _words(code, i) == ("=",):
        i += 1
    kind = None
    if i < len(code) and code[i].kind == "w":
        kind = code[i].text if code[i].text in ("struct", "interface") else None if code[i].text in ("func", "map", "chan") else "alias"
    end = _go_end(code, after, i, False)
    last = code[end - 1] if end > at else code[at]
    return Declaration("type", code[at].text, None, code[at].text, kind, code[at].start, last.end, code[at].line + 1, last.line + last.text.count("\n") + 1), end


def _receiver_type(receiver: str) -> str:
    return re.sub(r"\[.*", "", receiver, flags=re.S).split()[-1].lstrip("*").split(".")[-1]


def go_declarations(text: str, every: list[Token] | None = None) -> list[Declaration]:
    """Functions, methods and types at the top of a Go file; every type of a group is one. ``every``: its tokens, if known."""
    code = [t for t in every or go_tokens(text) if t.kind != "c"]
    after = _closings(code, _GO_TOP)
    out, at = [], 0
    while at < len(code):
        t = code[at]
        if t.kind == "p" and t.text in ("(", "[", "{"):
            at = after[at]
        elif t.text == "type" and t.kind == "w":
            if _words(code, at + 1) == ("(",):
                end, at = after[at + 1], at + 2
                while at < end - 1:
                    if code[at].kind == "n" or code[at].text == ";":
                        at += 1
                        continue
                    found, at = _go_type(code, after, at)
                    out += [found] if found else []
                at = end
            elif at + 1 < len(code):
                found, at = _go_type(code, after, at + 1)
                out += [found] if found else []
            else:
                at += 1
        elif t.text == "func" and t.kind == "w":
            i, receiver = at + 1, None
            if _words(code, i) == ("(",):
                end = after[i]
                receiver = text[code[i].end : code[end - 1].start].strip()
                i = end
            if i < len(code) and code[i].kind == "w":
                end = _go_end(code, after, i + 1, True)
                last = code[end - 1]
                of = _receiver_type(receiver) if receiver else None
                out.append(Declaration("method" if receiver else "function", code[i].text, receiver, of, None, t.start, last.end, t.line + 1, last.line + last.text.count("\n") + 1))
                at = end
            else:
                at = i
        else:
            at += 1
    return out


def go_header(text: str, every: list[Token] | None = None) -> tuple[int, int | None]:
    """(end of the last package clause, import or top comment before the first function or type, start of that one or None): offsets of characters; end 0 without any."""
    every = every or go_tokens(text)
    after = _closings(every, _GO_TOP)
    at, end = 0, 0
    while at < len(every):
        t = every[at]
        if t.kind == "p" and t.text in ("(", "[", "{"):
            at = after[at]
            continue
        if t.kind == "c":
            end = t.end
        elif t.kind == "w" and t.text in ("package", "import"):
            at = after[at + 1] if _words(every, at + 1) == ("(",) else _go_end(every, after, at + 1, False)
            end = every[at - 1].end
            continue
        elif t.kind == "w" and t.text in ("func", "type"):
            return end, t.start
        at += 1
    return end, None


_FLAT = r"[^()\[\]{}\"'`/]*"
#: The head of a function or method up to its body, without nested brackets, strings and comments; its result is no struct or interface type.
_GO_HEAD = re.compile(rf"\s*(func)[ \t]+(?:\(([^()\[\]{{}}\"'`/\n]*)\)[ \t]*)?([^\W\d][\w$]*)[ \t]*\({_FLAT}\)[ \t]*(?:\({_FLAT}\)|(?:(?!struct|interface)[\w.* \t])*)[ \t]*\{{")


#: A line of a package clause or comment, or an import.
_GO_CLAUSE = re.compile(rf"\s*(package[ \t]+[^\W\d]\w*|//[^\n]*|import[ \t]+(?:[\w.]+[ \t]+)?\"[^\"\\\n]*\"|import[ \t]*\((?:[^()\[\]{{}}\"'`/]|\"[^\"\\\n]*\")*\))[ \t]*\n")


def go_plain(text: str) -> tuple[int, list[tuple]] | None:
    """The end of the header as ``go_header`` gives it, and (kind, name, receiver, type_name, type_kind, start, end) of ``go_declarations``, without tokens of functions.

    None unless all from the first line on that begins with ``func`` is functions and methods of plain heads.
    """
    at = 0 if text.startswith("func ") else text.find("\nfunc ") + 1
    if not at and not text.startswith("func "):
        return None
    end, found, plain = 0, [], 0
    while m := _GO_CLAUSE.match(text, plain):
        end, plain = m.end(1), m.end()
    if plain > at:  # the first is within brackets
        return None
    if text[plain:at].strip():
        every, depth = go_tokens(text[:at]), 0
        if every[-1].kind != "n" or every[-1].end != at:  # a string or comment goes on
            return None
        for t in every:
            if t.kind == "p":
                depth += 1 if t.text in "([{" else -1 if t.text in ")]}" and depth else 0
        if depth:
            return None
        end, found = go_header(text, every)[0], [d[:7] for d in go_declarations(text, every)]
    while m := _GO_HEAD.match(text, at):
        at = m.end()
        body = _PLAIN.match(text, at)
        if body:
            at = body.end()
        else:
            inner = 1
            for sign in _WITHIN.finditer(text, at):
                value = sign[0]
                if value in "([{":
                    inner += 1
                elif value in ")]}":
                    inner -= 1
                    if not inner:
                        break
            if inner:
                return None
            at = sign.end()
        receiver = m[2] if m[2] is None else m[2].strip()
        found.append(("method" if receiver else "function", m[3], receiver, _receiver_type(receiver) if receiver else None, None, m.start(1), at))
    return None if text[at:].strip() else (end, found)


def _go_points(code: list[Token]) -> Iterator[int]:
    after = _closings(code, _GO_TOP)
    at = 0
    while at < len(code):
        t = code[at]
        if t.kind == "p" and t.text in ("(", "[", "{"):
            at = after[at]
            continue
        if t.kind == "w" and t.text in ("package", "import", "func", "type"):
            yield t.line
            i = at + 1
            if t.text == "func" and _words(code, i) == ("(",):
                i = after[i]
            at = _go_end(code, after, i, t.text == "func") if t.text in ("func", "type") else i
            continue
        if t.kind == "w" and t.text in ("struct", "interface"):
            yield t.line
        at += 1


# Others ------------------------------------------------------------------------------------


def _py_points(code: list[Token], text: str) -> Iterator[int]:
    """Statements by their indent; those indented deeper than an open function count as within it."""
    depth, begins, functions = 0, True, []
    for i, t in enumerate(code):
        if t.kind == "p" and t.text in "([{":
            depth += 1
        elif t.kind == "p" and t.text in ")]}":
            depth = max(0, depth - 1)
        elif t.kind == "n":
            begins = begins or not depth and code[i - 1].text != "\\"
            continue
        if begins and not depth:
            head = text.rfind("\n", 0, t.start) + 1
            indent = len(text[head : t.start].expandtabs(8)) if not text[head : t.start].strip() else None
            if indent is not None:
                while functions and indent <= functions[-1]:
                    functions.pop()
            words = _words(code, i, 2)
            function = words[0] == "def" or words == ("async", "def")
            if not functions and (function or words[0] in ("import", "class")):
                yield t.line
            if function and indent is not None:
                functions.append(indent)
        begins = not depth and t.kind == "p" and t.text in (":", ";")


def _js_points(code: list[Token], typed: bool) -> Iterator[int]:
    """Declarations and blocks that stand in no function; a brace is a block after a parenthesis, an arrow or a word such as ``else``."""
    code = [t for t in code if t.kind != "n"]
    stack: list[tuple[str, bool, int]] = []  # bracket, whether it is a function's, place
    closed: tuple[bool, int] = (False, 0)  # of the last parenthesis: a function's, its place
    inner = 0
    for i, t in enumerate(code):
        before = code[i - 1].text if i else ""
        if t.kind == "p" and t.text in ("(", "[", "{"):
            two = code[i - 2].text if i > 1 else ""
            named = before in ("function", "*") or two in ("function", "*")
            body = t.text == "{" and (before == ")" and closed[0] or before == "=>")
            block = before == ")" or before in ("else", "try", "finally", "do", ";", "{", "}", "")
            if t.text == "{" and not body and not inner and block:
                yield t.line
            stack.append((t.text, t.text == "(" and named or body, i))
            inner += body
        elif t.kind == "p" and t.text in (")", "]", "}"):
            if stack:
                kind, function, place = stack.pop()
                if kind == "(":
                    closed = (function, place)
                elif kind == "{" and function:
                    inner -= 1
        elif not inner and t.text == "=>" and t.kind == "p":
            head = closed[1] if before == ")" else i - 1
            yield code[head - 1].line if head and code[head - 1].text == "async" else code[max(head, 0)].line
        elif not inner and t.kind == "w" and before != ".":
            after = code[i + 1] if i + 1 < len(code) else None
            named = after is not None and (after.kind == "w" or after.text == "{")
            if t.text in ("import", "export") and (after is None or after.text not in ("(", ".", ":")) or t.text == "class" and named or t.text == "function" and after is not None and (after.kind == "w" or after.text == "*"):
                yield code[i - 1].line if t.text == "function" and before == "async" else t.line
            elif typed and t.text in ("interface", "type") and named and after.kind == "w" and (t.text == "interface" or i + 2 < len(code) and code[i + 2].text in ("=", "<")):
                yield t.line


def _css_points(code: list[Token]) -> Iterator[int]:
    """Tags of selectors, and @media; selectors stand outside of braces or within those of an at-rule."""
    stack: list[bool] = []
    begins, rule = True, False
    for i, t in enumerate(code):
        if t.kind == "n":
            continue
        selecting = not stack or stack[-1]
        if begins:
            rule = t.text == "@"
            begins = False
        if t.text == "@" and _words(code, i + 1) == ("media",):
            yield t.line
        if t.text == "{" and t.kind == "p":
            stack.append(rule)
            begins = True
        elif t.text == "}" and t.kind == "p":
            begins = True
            if stack:
                stack.pop()
        elif t.text == ";":
            begins = True
        elif selecting and not rule and t.kind == "w" and (i == 0 or code[i - 1].text not in (".", "#", ":", "::", "[", "-", "=")):
            yield t.line


def _php_points(code: list[Token]) -> Iterator[int]:
    """Named functions and methods, classes, interfaces, traits and namespaces that stand in no function, at their modifiers."""
    code = [t for t in code if t.kind != "n"]
    stack: list[bool] = []
    opens = False
    for i, t in enumerate(code):
        before = code[i - 1].text if i else ""
        if t.text == "{" and t.kind == "p":
            stack.append(opens)
            opens = False
        elif t.text == "}" and t.kind == "p":
            if stack:
                stack.pop()
        elif t.text == ";":
            opens = False
        elif t.kind == "w" and before not in ("::", "new", ">", "$"):
            after = code[i + 1] if i + 1 < len(code) else None
            named = after is not None and (after.kind == "w" or after.text == "&")
            low = t.text.lower()
            if named and low in ("namespace", "class", "function", "interface", "trait") and not (low == "function" and before in ("use", "=")):
                head = i
                while head and code[head - 1].text.lower() in ("public", "protected", "private", "static", "final", "abstract", "readonly"):
                    head -= 1
                if not any(stack):
                    yield code[head].line
                opens = low == "function"


def _rb_points(code: list[Token]) -> Iterator[int]:
    for i, t in enumerate(code):
        first = i == 0 or code[i - 1].kind == "n" or code[i - 1].text in (";", "=", "private", "public", "protected")
        if t.kind == "w" and first and t.text in ("class", "module", "def", "begin"):
            yield t.line


def points(text: str, ext: str) -> tuple[list[int], set[int]]:
    """Lines (from 0) of declarations that stand in no function, and lines on which a comment or decorator begins."""
    every = go_tokens(text) if ext == "go" else list(tokens(text, ext))
    code = [t for t in every if t.kind != "c"]
    kind = ALIASES.get(ext, ext)
    walk = {"go": _go_points, "css": _css_points, "php": _php_points, "rb": _rb_points}
    found = _py_points(code, text) if kind == "py" else _js_points(code, ext in ("ts", "tsx")) if kind == "js" else walk[kind](code)
    remarks = {t.line for t in every if t.kind == "c"}
    mark = {"py": "@", "js": "@", "php": "#"}.get(kind)
    remarks |= {t.line for i, t in enumerate(code) if t.text == mark and (i == 0 or code[i - 1].kind == "n")} if mark else set()
    return sorted(set(found)), remarks


LANGUAGES = frozenset({*_SYNTAX, *ALIASES})
