"""Paths, languages, definitions and symbols of source text. Column in, Column out, JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserine.functions.text import lines, strip

#: Languages by extension.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rb": "ruby", "php": "php", "java": "java"}
#: Words that hint at a language in a question; the first of equal counts wins.
HINTS = {
    "python": ("python", "py", "fastapi", "pydantic", "pytest", "pip", "requirements.txt"),
    "typescript": ("typescript", "ts", "tsx", "vite", "react", "nextjs", "nuxt", "deno"),
    "javascript": ("javascript", "js", "node", "express", "yarn", "npm", "package.json"),
    "go": ("golang", "go", "gin", "go.mod", "go.sum"),
    "java": ("java", "maven", "gradle", "spring"),
}
#: Parts of a path that mark tests.
TESTS = ("/tests/", "/test/", "test_", "_test.", "/__tests__/")
_NAME = "([A-Za-z_][A-Za-z0-9_]*)"
#: Patterns of definitions by extension: what their names are called, and whether they lead. Classes come before functions.
DEFINITIONS = {
    "py": (("class", rf"^\s*class\s+{_NAME}\s*[:(]"), ("function", rf"^\s*def\s+{_NAME}\s*\(")),
    "ts": (("class", rf"^\s*(?:export\s+)?class\s+{_NAME}\b"), ("function", rf"^\s*(?:export\s+)?(?:async\s+)?function\s+{_NAME}\s*\("), ("function", rf"^\s*const\s+{_NAME}\s*=\s*(?:async\s+)?\(")),
    "go": (("function", rf"^\s*func\s+(?:\([^)]+\)\s*)?{_NAME}\s*\("),),
    "java": (("class", rf"^\s*(?:public\s+|protected\s+|private\s+)?class\s+{_NAME}\b"), ("method", rf"^\s*(?:public|protected|private|static|\s)+\s+[A-Za-z_<>\[\]]+\s+{_NAME}\s*\(")),
    "rb": (("function", r"^\s*def\s+([A-Za-z_][A-Za-z0-9_!?]*)\b"),),
    "php": (("function", rf"^\s*function\s+{_NAME}\s*\("),),
}
SAME = {"tsx": "ts", "js": "ts", "jsx": "ts"}
#: Words of a line that defines something.
DEFINING = ("def ", "class ", "function ", "func ", "export ")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _case(value: Column, table: dict[str, object], default: Column) -> Column:
    out = None
    for key, result in table.items():
        result = result if isinstance(result, Column) else F.lit(result)
        out = F.when(value == key, result) if out is None else out.when(value == key, result)
    return out.otherwise(default)


def language_of(ext: Column, default: Column | None = None) -> Column:
    """The language of an extension; the extension itself, or ``default``, where it is unknown."""
    return _case(ext, LANGUAGES, ext if default is None else default)


def slug(text: Column) -> Column:
    """Lower case with hyphens for everything but letters, digits and underscores; ``repo`` if nothing is left."""
    out = F.regexp_replace(strip(F.lower(text)), r"[^\p{L}\p{N}_-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(out, "-{2,}", "-"), "^-+|-+$", ""), F.lit("")), F.lit("repo"))


def module_name(path: Column) -> Column:
    """The path without a known extension, dots for slashes."""
    bare = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(?i)\.(py|js|jsx|ts|tsx|php|rb|go|css)$", "")
    return F.array_join(F.filter(F.split(bare, "/"), lambda s: ~s.isin("", ".")), ".")


def relative_path(path: Column, root: Column) -> Column:
    """The path below ``root`` with slashes; as it is where it lies elsewhere."""
    path, root = (F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "(?<=.)/+$", "") for p in (path, root))
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def is_test_path(path: Column) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in TESTS]), lambda t: F.contains(F.lower(path), t))


_SCRIPT = ("javascript", "typescript")
#: What a text is. (languages, pattern, kind): the first row that holds counts, for all languages where it names none.
KINDS = (
    (("python", *_SCRIPT), "class ", "class_or_type"),
    (("python",), r"(?m)^\s*def\s+", "function_or_method"),
    (_SCRIPT, r"\bfunction\b|=>\s*\{", "function_or_method"),
    (("go",), "(?s)type .*struct|struct.*type ", "class_or_type"),
    (("go",), r"(?m)^\s*func\s+", "function_or_method"),
    ((), "import |from ", "imports"),
)
#: What a block is called by its first line. (languages, pattern, label, pattern of a name that follows it).
SUMMARIES = (
    (("python",), "def ", "Python function ", r"def ([^(]*)"),
    (("python",), "class ", "Python class ", r"class ([^(:]*)"),
    (_SCRIPT, "function |=>", "JavaScript/TypeScript function", None),
    (_SCRIPT, "class ", "JavaScript/TypeScript class", None),
    (("go",), "func ", "Go function", None),
    (("go",), "type ", "Go type definition", None),
)


def _holds(languages: tuple[str, ...], pattern: str, text: Column, language: Column) -> Column:
    return text.rlike(pattern) & language.isin(*languages) if languages else text.rlike(pattern)


def _first(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first case that holds."""
    return F.coalesce(*[F.when(hit, value) for hit, value in cases], default)


def ast_kind(text: Column, language: Column) -> Column:
    """class_or_type, function_or_method, imports or unknown, by KINDS."""
    return _first([(_holds(names, pattern, text, language), F.lit(kind)) for names, pattern, kind in KINDS], F.lit("unknown"))


def import_lines(code: Column, language: Column) -> Column:
    """The stripped lines that import; those of scripts only where they call ``require``."""
    begins = lambda x, *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.startswith(x, w))
    return F.filter(
        F.transform(lines(code), strip),
        lambda x: ((language == "python") & begins(x, "import ", "from "))
        | (language.isin("javascript", "typescript") & begins(x, "import ", "const ", "let ", "var ") & F.contains(x, F.lit("require(")))
        | ((language == "go") & begins(x, "import ")),
    )


def definitions(code: Column, ext: Column) -> Column:
    """(primary_symbol, primary_kind, def_symbols): the definitions of the text, classes before functions; empty for other extensions."""
    empty = F.array().cast("array<string>")
    tables = DEFINITIONS | {same: DEFINITIONS[of] for same, of in SAME.items()}
    parts = {e: [(kind, _found(code, "(?md)" + pattern)) for kind, pattern in found] for e, found in tables.items()}
    symbols = _case(ext, {e: F.array_distinct(F.concat(*[p for _, p in found])) for e, found in parts.items()}, empty)
    leading = _case(ext, {e: F.coalesce(*[F.when(F.size(p) > 0, F.lit(kind)) for kind, p in found], F.lit("")) for e, found in parts.items()}, F.lit(""))
    return F.struct(F.coalesce(F.get(symbols, F.lit(0)), F.lit("")).alias("primary_symbol"), leading.alias("primary_kind"), F.slice(symbols, 1, 64).alias("def_symbols"))


def symbols(code: Column, defined: Column, most: int = 256) -> Column:
    """Definitions, then identifiers of three characters or more, distinct in that order."""
    return F.slice(F.array_distinct(F.concat(defined, F.filter(_found(code, r"\b[A-Za-z_][A-Za-z0-9_]*\b", 0), lambda x: F.length(x) >= 3))), 1, most)


def primary_span(code: Column, symbol: Column, start: Column, end: Column) -> Column:
    """[line, end] of the first line that defines the symbol, else the chunk's own."""
    defining = F.transform(lines(code), lambda x: F.contains(x, symbol) & F.exists(F.array(*[F.lit(d) for d in DEFINING]), lambda d: F.contains(x, d)))
    at = F.array_position(defining, F.lit(True))
    return F.array(F.when((F.length(symbol) > 0) & (at > 0), start + at.cast("int") - 1).otherwise(start), end)


def doc_head(code: Column, language: Column, most: int = 1200) -> Column:
    """A Python docstring, else the first 50 lines that aren't blank; a longer head is cut at a line end, else at a blank."""
    docstring = F.regexp_extract(code, "(?md)^\\s*(\"\"\"|''')((?s:.*?))\\1", 2)
    first = F.array_join(F.slice(F.filter(lines(code), lambda x: F.length(strip(x)) > 0), 1, 50), "\n")
    head = F.coalesce(F.when(language == "python", F.nullif(docstring, F.lit(""))), first)
    part = F.substring(head, 1, most)
    blank = F.length(part) - F.instr(F.reverse(part), " ")
    cut = F.when(F.contains(part, F.lit("\n")), F.substring_index(part, "\n", -1))
    at_line = F.substring(part, F.lit(1), F.length(part) - F.length(cut) - 1)
    at_word = F.concat(F.when((F.instr(part, " ") > 0) & (blank > most * 0.8), F.substring(part, F.lit(1), blank)).otherwise(part), F.lit("..."))
    return F.when(F.length(head) <= most, head).when(F.contains(part, F.lit("\n")), at_line).otherwise(at_word)


#: Patterns of names by language, for texts of unknown structure.
MINED = {
    "python": (r"(?m)^\s*def\s+([A-Za-z_]\w*)\s*\(", r"(?m)^\s*class\s+([A-Za-z_]\w*)\s*[\(:]"),
    "javascript": (r"(?:async\s+function|function)\s+([A-Za-z_]\w*)\s*\(", r"const\s+([A-Za-z_]\w*)\s*=\s*\(", r"class\s+([A-Za-z_]\w*)\s*"),
    "php": (r"function\s+([A-Za-z_]\w*)\s*\(", r"class\s+([A-Za-z_]\w*)\s*"),
    "ruby": (r"(?m)^\s*def\s+([A-Za-z_]\w*[!?=]?)", r"(?m)^\s*class\s+([A-Za-z_]\w*)"),
    "go": (r"(?m)^\s*func\s+(?:\([^)]+\)\s*)?([A-Za-z_]\w*)\s*\(", r"(?m)^\s*type\s+([A-Za-z_]\w*)\s+struct"),
}


def mined_symbols(text: Column, language: Column, most: int = 50) -> Column:
    """Names that the language's patterns find (all identifiers for other languages), then up to two lower-case parts of each identifier, in the order of the text."""
    identifiers = _found(text, r"\b([A-Za-z_][A-Za-z0-9_]{3,})\b")
    tables = {k: F.concat(*[_found(text, p) for p in patterns]) for k, patterns in (MINED | {"typescript": MINED["javascript"]}).items()}
    parts = lambda t: F.slice(F.transform(F.filter(F.concat(_found(t, "[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)", 0), F.split(t, "_")), lambda p: F.length(p) > 2), F.lower), 1, 2)
    return F.slice(F.array_distinct(F.concat(_case(language, tables, identifiers), F.flatten(F.transform(F.array_distinct(identifiers), parts)))), 1, most)


def guessed_language(question: Column) -> Column:
    """The language with the most hints in the text, the first of equals; empty without any."""
    low = F.lower(question)
    counts = [F.struct(F.size(F.filter(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(low, h))).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, hints) in enumerate(HINTS.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["lang"]).otherwise(F.lit(""))


def summary_line(code: Column, language: Column, title: Column) -> Column:
    """One line on what a block of code is, by SUMMARIES."""
    first, n = strip(F.get(lines(code), F.lit(0))), F.size(lines(code)).cast("string")
    named = [(_holds(names, pattern, first, language), F.concat(F.lit(label), F.regexp_extract(first, name, 1) if name else F.lit(""), F.lit(" with "), n, F.lit(" lines of code"))) for names, pattern, label, name in SUMMARIES]
    return _first(named, F.concat(title, F.lit(" code block with "), n, F.lit(" lines")))


#: Terms that a text is given.
STATUS = ("200", "201", "400", "401", "403", "404", "500")
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")
ERRORS = ("Exception", "Error", "ValueError", "TypeError")
FRAMEWORKS = {"fastapi": "FastAPI", "django": "Django", "flask": "Flask", "react": "React", "vue": "Vue"}
#: When: (languages, where, pattern, terms); where is the text, its lower case or one of its lines.
TERMS = (
    ((), "line", f"(?is)status.*({'|'.join(STATUS)})|({'|'.join(STATUS)}).*status", STATUS),
    ((), "lower", "|".join(METHODS).lower(), METHODS),
    (("python",), "text", "|".join(ERRORS), ERRORS),
    *[((), "lower", word, (name,)) for word, name in FRAMEWORKS.items()],
)


def qa_terms(code: Column, language: Column, most: int = 12) -> Column:
    """Up to 12 sorted terms on what lines of the text mention, by TERMS."""
    none = F.array().cast("array<string>")
    held = {
        "text": lambda names, pattern: _holds(names, pattern, code, language),
        "lower": lambda names, pattern: _holds(names, pattern, F.lower(code), language),
        "line": lambda names, pattern: F.exists(lines(code), lambda x: _holds(names, pattern, x, language)),
    }
    found = [F.when(held[where](names, pattern), F.array(*[F.lit(t) for t in terms])).otherwise(none) for names, where, pattern, terms in TERMS]
    return F.array_join(F.slice(F.array_sort(F.concat(*found)), 1, most), ", ")
