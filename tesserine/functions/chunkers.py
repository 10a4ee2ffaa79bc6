"""Chunks and declarations of source text: one row in, an array of structs out.

Parsers for the languages aren't available, so declarations are found by a walk over tokens
(``lexer``). The walk is linear and keeps state from token to token, which built-in expressions
can't; it runs in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserine.functions import go, lexer

CHUNKS = "array<struct<chunk_number:int,start_line:int,end_line:int,text:string>>"
DECLARATIONS = "array<struct<kind:string,name:string,receiver:string,receiver_text:string,type_name:string,type_kind:string,start_line:int,end_line:int,start_byte:int,end_byte:int>>"


def _once(run, schema: str):
    """An Arrow function that the optimizer doesn't repeat, as it would in the filter it infers for an exploded array."""
    return F.arrow_udf(run, schema).asNondeterministic()


def _array(found: Iterable[list[tuple]], schema: str) -> pa.Array:
    """Lists of tuples as an array of arrays of structs: its columns are built whole, without a dictionary for each struct."""
    fields = [f.split(":") for f in schema.removeprefix("array<struct<").removesuffix(">>").split(",")]
    offsets, rows = [0], []
    for some in found:
        rows += some
        offsets.append(len(rows))
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, pa.int32() if kind == "int" else pa.string()) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def chunk_lines(text: str, ext: str) -> list[tuple[int, int, int, str]]:
    """Chunks cut at every declaration, moved up over the comments right above it.

    What precedes the first cut is a chunk of its own. Comments that reach up to the first line
    of the file stay with it. Blank chunks are dropped; a text without any cut, or of a language
    without patterns, is one chunk.
    """
    lines = text.split("\n")
    found, remarks = lexer.points(text, ext) if ext in lexer.LANGUAGES else ([], set())
    cuts = set()
    for line in found:
        above = line
        while above - 1 in remarks:
            above -= 1
        cuts.add(above or line)
    bounds = [0, *sorted(cuts - {0}), len(lines)]
    pieces = [(a + 1, b, "\n".join(lines[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)]
    kept = [p for p in pieces if p[2].strip()] or [(1, len(lines), text)]
    return [(n, *p) for n, p in enumerate(kept, 1)]


def _chunks(text: pa.Array, ext: pa.Array) -> pa.Array:
    return _array((chunk_lines(t or "", e or "") for t, e in zip(text.to_pylist(), ext.to_pylist(), strict=True)), CHUNKS)


def code_chunks(text: Column, ext: Column) -> Column:
    """Array of (chunk_number, start_line, end_line, text). Null text counts as empty."""
    return _once(_chunks, CHUNKS)(text, ext)


def byte_offsets(text: str, places: Iterable[int]) -> dict[int, int]:
    """Offsets in UTF-8 bytes of places in characters, in one pass."""
    out, last, size = {}, 0, 0
    for at in sorted(set(places)):
        size += len(text[last:at].encode())
        out[at], last = size, at
    return out


def go_declarations(text: str) -> list[dict]:
    """Functions, methods and types of a Go file with their spans; every type of a group has its own row.

    receiver is the receiver's type with its pointer (``*T``), receiver_text what stands in the
    parentheses. type_kind is struct, interface or alias (of a named type), null for others.
    """
    found = lexer.go_declarations(text)
    size = byte_offsets(text, [x for d in found for x in (d.start, d.end)])
    pointer = lambda d: ("*" if "*" in d.receiver else "") + re.sub(r"\[.*", "", d.receiver, flags=re.S).split()[-1].lstrip("*")
    return [
        {
            "kind": d.kind, "name": d.name, "receiver": pointer(d) if d.receiver else None, "receiver_text": d.receiver, "type_name": d.type_name, "type_kind": d.type_kind,
            "start_line": d.start_line, "end_line": d.end_line, "start_byte": size[d.start], "end_byte": size[d.end],
        }
        for d in found
    ]


def _go(text: pa.Array) -> pa.Array:
    return _array(([tuple(d.values()) for d in go_declarations(t or "")] for t in text.to_pylist()), DECLARATIONS)


def go_structure(text: Column) -> Column:
    return _once(_go, DECLARATIONS)(text)


def go_package(text: Column) -> Column:
    """The package name, empty where there is none."""
    return F.regexp_extract(text, r"(?m)^\s*package\s+(\w+)", 1)


def go_imports(text: Column) -> Column:
    """Sorted distinct import paths, of single imports and of groups."""
    blocks = F.regexp_extract_all(text, F.lit(r'import\s+((?:[\w.]+\s+)?"[^"]+"|\([^)]*\))'), F.lit(1))
    paths = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'"([^"]+)"'), F.lit(1))))
    return F.array_sort(F.array_distinct(paths))


def go_aliases(text: Column) -> Column:
    """Map from the name used in the file to the import path; an import without a name goes by its last segment."""
    blocks = F.regexp_extract_all(text, F.lit(r'import\s+((?:[\w.]+\s+)?"[^"]+"|\([^)]*\))'), F.lit(1))
    specs = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'((?:[\w.]+[ \t]+)?"[^"]+")'), F.lit(1))))
    path = lambda s: F.regexp_extract(s, '"([^"]+)"', 1)
    name = lambda s: F.coalesce(F.nullif(F.trim(F.substring_index(s, '"', 1)), F.lit("")), F.element_at(F.split(path(s), "/"), -1))
    entries = F.transform(F.array_distinct(specs), lambda s: F.struct(name(s).alias("key"), path(s).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


_TOKEN = re.compile(r"\w+|[^\w\s]")
#: For texts of ASCII: signs of words as they are and others as blanks, and what isn't a single sign.
_WORDS = bytes(i if re.match(r"\w", chr(i)) else 32 for i in range(128)).ljust(256)
_NO_SIGNS = bytes(i for i in range(128) if re.match(r"[\w\s]", chr(i)))
#: Extensions by language name.
EXTENSIONS = {"python": "py", "javascript": "js", "typescript": "ts", "go": "go", "ruby": "rb", "php": "php", "java": "java"}


def text_chunks(text: str, language: str = "", ext: str = "") -> list[dict]:
    """(start_line, end_line, text) of each chunk; a text that can't be cut is one chunk."""
    ext = ext or EXTENSIONS.get(language.lower(), language.lower()) or "txt"
    try:
        found = chunk_lines(text, ext)
    except re.error:
        found = [(1, 1, len(text.split("\n")), text)]
    return [{"start_line": a, "end_line": b, "text": t} for _, a, b, t in found]


def count_tokens(text: str, encode=None) -> int:
    """Tokens of an injected tokenizer's ``encode``; without one, words and single signs are counted."""
    if encode:
        return len(encode(text))
    if not text.isascii():
        return len(_TOKEN.findall(text))
    plain = text.encode()
    return len(plain.translate(_WORDS).split()) + len(plain.translate(None, _NO_SIGNS))


def bounded_chunks(text: str, ext: str, limit: int, count=count_tokens) -> list[tuple[int, int, int, str]]:
    """(chunk_number, start_line, end_line, text): lines are taken until the next would pass ``limit`` tokens, then cut at the last declaration.

    Where there is none since the chunk began, it runs over the limit to the next one. Blank chunks are dropped.
    """
    lines = text.split("\n")
    found, remarks = lexer.points(text, ext) if ext in lexer.LANGUAGES else ([], set())
    cuts = set()
    for line in found:
        above = line
        while above - 1 in remarks:
            above -= 1
        cuts.add(above or line)
    pieces, start, tokens, at = [], 0, 0, 0
    sizes = [count(line) for line in lines]
    while at < len(lines):
        if tokens + sizes[at] > limit:
            stop = at if at in cuts else max((c for c in cuts if start < c < at), default=start)
            if stop > start:
                pieces.append((start, stop))
                start = at = stop
                tokens = 0
                if stop == len(lines):
                    break
                tokens, at = sizes[at], at + 1
                continue
        tokens += sizes[at]
        at += 1
    pieces.append((start, len(lines)))
    kept = [(a + 1, b, "\n".join(lines[a:b])) for a, b in pieces]
    return [(n, *p) for n, p in enumerate((p for p in kept if p[2].strip()), 1)]


def bounded_code_chunks(text: Column, ext: Column, limit: int, factory=None) -> Column:
    """Array of (chunk_number, start_line, end_line, text) of up to ``limit`` tokens where declarations allow; ``factory`` builds a tokenizer's encode in each worker."""

    def run(texts: pa.Array, exts: pa.Array) -> pa.Array:
        encode = factory() if factory else None
        return _array((bounded_chunks(t or "", e or "", limit, lambda x: count_tokens(x, encode)) for t, e in zip(texts.to_pylist(), exts.to_pylist(), strict=True)), CHUNKS)

    return _once(run, CHUNKS)(text, ext)


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a text, both included, from 1."""
    return F.array_join(F.slice(F.split(text, "\n", -1), start, F.greatest(end - start + 1, F.lit(0))), "\n")


#: Beginnings of lines that start a block of their own.
STARTS = ("if ", "else", "switch", "case", "for ", "range", "defer", "go func", "select")


def _logical_end(stripped: list[str], at: int) -> int:
    """Where a part that begins at line ``at`` ends: after 15 lines, or within its lines 5 to 25 after the first closing brace that other code follows, else before the last line that starts a block."""
    n = len(stripped)
    end = min(at + 15, n)
    for i in range(at + 5, min(at + 25, n)):
        line = stripped[i]
        if line == "}":
            after = stripped[i + 1] if i + 1 < n else ""
            if after and after[0] != "}":
                return i + 1
        elif line.startswith(STARTS):
            end = i
    return end


def logical_parts(text: str, limit: int, first_line: int = 1, count=count_tokens, size: int | None = None) -> list[tuple[int, int, str]]:
    """(start_line, end_line, text) of the parts of a text, none over ``limit`` tokens; a text within it is one part.

    A part ends at a logical line, or earlier where the limit is reached. A single line over the
    limit is cut between tokens, into parts of the same line. Blank parts are left out. size: the
    text's tokens, if known.
    """
    if (count(text) if size is None else size) <= limit:
        return [(first_line, first_line + text.count("\n"), text)]
    lines = text.split("\n")
    stripped = [x.strip() for x in lines]
    parts, at = [], 0
    while at < len(lines):
        end = _logical_end(stripped, at)
        part = "\n".join(lines[at:end])
        while (over := count(part) > limit) and end > at + 1:
            end -= 1
            part = "\n".join(lines[at:end])
        if not over:
            pieces = [part]
        else:
            cuts = [0, *[m.start() for m in _TOKEN.finditer(part)][limit::limit], len(part)] if limit > 0 else [0, len(part)]
            pieces = [part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        parts += [(first_line + at, first_line + end - 1, x) for x in pieces if x.strip()]
        at = end
    return parts


def split_body(text: str, limit: int, count=count_tokens) -> list[tuple[int, int, str]]:
    """(start_line, end_line, text) of the parts of an oversize body; a body within ``limit`` tokens is one part.

    A part has 15 lines, or ends within its lines 5 to 25 after a closing brace that other code
    follows, or before a line that starts a block.
    """
    lines = text.split("\n")
    if count(text) <= limit:
        return [(1, len(lines), text)]
    parts, at = [], 0
    while at < len(lines):
        end = min(at + 15, len(lines))
        for i in range(at + 5, min(at + 25, len(lines))):
            line, after = lines[i].strip(), lines[i + 1].strip() if i + 1 < len(lines) else ""
            if line == "}" and after and not after.startswith("}"):
                end = i + 1
                break
            if line.startswith(STARTS):
                end = i
                break
        parts.append((at + 1, end, "\n".join(lines[at:end])))
        at = end
    return [p for p in parts if p[2].strip()]


def packed_chunks(text: str, ext: str, limit: int, count=count_tokens) -> list[tuple[int, int, int, str]]:
    """(chunk_number, start_line, end_line, text): neighbouring declarations are merged up to ``limit`` tokens; one that is larger is split at logical lines.

    What precedes the first declaration and what follows the last one belong to the chunks too.
    """
    lines = text.split("\n")
    found, remarks = lexer.points(text, ext) if ext in lexer.LANGUAGES else ([], set())
    cuts = set()
    for line in found:
        while line - 1 in remarks:
            line -= 1
        cuts.add(line)
    bounds = [0, *sorted(cuts - {0}), len(lines)]
    units = [(a, b, count("\n".join(lines[a:b]))) for a, b in zip(bounds, bounds[1:], strict=False)]
    merged: list[list[int]] = []
    for a, b, size in units:
        if merged and merged[-1][2] + size <= limit:
            merged[-1][1], merged[-1][2] = b, merged[-1][2] + size
        else:
            merged.append([a, b, size])
    known = count is count_tokens  # its sizes add up: no token spans lines
    out = [p for a, b, size in merged for p in logical_parts("\n".join(lines[a:b]), limit, a + 1, count, size if known else None)]
    return [(n, *p) for n, p in enumerate((p for p in out if p[2].strip()), 1)]


def packed_code_chunks(text: Column, ext: Column, limit: int) -> Column:
    """Array of (chunk_number, start_line, end_line, text), none over ``limit`` tokens. Null text counts as empty."""

    def run(texts: pa.Array, exts: pa.Array) -> pa.Array:
        return _array((packed_chunks(t or "", e or "", limit) for t, e in zip(texts.to_pylist(), exts.to_pylist(), strict=True)), CHUNKS)

    return _once(run, CHUNKS)(text, ext)


GO_CHUNKS = "array<struct<kind:string,name:string,receiver:string,type_name:string,type_kind:string,start_line:int,end_line:int,part:int,parts:int,text:string,tokens:int,label:string,before_start_line:int,after_start_line:int,before_end_line:int,after_end_line:int>>"


def go_chunks(text: str, limit: int, count=count_tokens) -> list[dict]:
    """The header of a Go file, then one chunk a function, method or type, or its logical parts where it is over ``limit`` tokens.

    The header reaches from the first line that isn't blank to the end of package and imports; a
    file without them has none. A type of a group is a chunk of its own. part is 0 for a whole declaration, else
    from 1.
    """
    lines = text.split("\n")
    out = []

    def add(kind, name, receiver, type_name, type_kind, first, last):
        parts = logical_parts("\n".join(lines[first - 1 : last]), limit, first, count)
        for n, (a, b, part) in enumerate(parts, 1):
            out.append({"kind": kind, "name": name, "receiver": receiver, "type_name": type_name, "type_kind": type_kind, "start_line": a, "end_line": b, "part": n if len(parts) > 1 else 0, "parts": len(parts), "text": part})

    every = lexer.go_tokens(text)
    end, _ = lexer.go_header(text, every)
    if end:
        begin = next(i for i, x in enumerate(lines, 1) if x.strip())
        add("header", None, None, None, None, begin, text.count("\n", 0, end) + 1)
    for d in lexer.go_declarations(text, every):
        add(d.kind, d.name, d.receiver, d.type_name, d.type_kind, d.start_line, d.end_line)
    return out


#: By byte: 0 for blanks, 1 for signs of words, 2 for single signs, 3 for what the engines tell apart: beyond ASCII, and separators that are blanks in one.
_CLASS = bytes(3 if i > 127 or 28 <= i <= 31 else 1 if re.match(r"\w", chr(i)) else 0 if chr(i).isspace() else 2 for i in range(256))
#: Bytes of texts whose tokens are counted together, unless one is longer.
_COUNTED = 1 << 20
#: A line that ``_logical_end`` heeds.
_HEEDED = re.compile(r"^[ \t\r\f\v]*(?:\}[ \t\r\f\v]*$|" + "|".join(map(re.escape, STARTS)) + ")", re.M)
_GO_FIELDS = "kind", "name", "receiver", "type_name", "type_kind", "start_line", "end_line", "part", "parts", "text", "tokens", "label"


def _known_parts(text: str, first: int, starts: list[int], before: list[int], limit: int) -> list[tuple[int, int, str, int]]:
    """``logical_parts`` of some lines, over the limit, with their tokens; starts: of each line and the place after the last line's break; before: tokens ahead of each."""
    n, end_of = len(starts) - 1, starts[-1] - 1
    special = _HEEDED.search(text, starts[0], end_of)
    if special and special[0].strip() == "}" and special.start() >= starts[-2]:  # nothing follows it
        special = None
    stripped = [text[a : b - 1].strip() for a, b in zip(starts, starts[1:], strict=False)] if special else []
    parts, at = [], 0
    while at < n:
        end = _logical_end(stripped, at) if special else min(at + 15, n)
        while before[end] - before[at] > limit and end > at + 1:
            end -= 1
        tokens, part = before[end] - before[at], text[starts[at] : starts[end] - 1]
        if tokens > limit:
            cuts = [0, *[m.start() for m in _TOKEN.finditer(part)][limit::limit], len(part)] if limit > 0 else [0, len(part)]
            parts += [(first + at, first + end - 1, x, count_tokens(x)) for x in (part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)) if x.strip()]
        elif tokens:
            parts.append((first + at, first + end - 1, part, tokens))
        at = end
    return parts


def _labels(text: str) -> list[tuple[str, list[list[str]]]]:
    """The labels of ``go.BLOCKS`` whose words a text holds, with those words."""
    low = text.lower()
    found = []
    for label, groups in go.BLOCKS:
        held = []
        for words in groups:
            held.append([w for w in words if w in low])
            if not held[-1]:
                break
        else:
            found.append((label, held))
    return found


def _label(part: str, labels: list[tuple[str, list[list[str]]]]) -> str | None:
    """``go.block_label`` of a part of a text of ASCII with these ``labels``; None without any."""
    low = part.lower() if labels else ""
    return next((label for label, groups in labels if all(any(w in low for w in words) for words in groups)), None)


def _known_chunks(texts: list[str], limit: int) -> list[list[tuple]]:
    """_GO_FIELDS of ``go_chunks`` of each text; tokens are counted for all texts at once, and null, like labels, where the engines don't agree on them."""
    whole = "".join(texts)
    data = whole.encode()
    kind = np.frombuffer(data.translate(_CLASS), np.uint8)
    if kind.max(initial=0) == 3:
        if len(texts) > 1:
            return [x for t in texts for x in _known_chunks([t], limit)]
        return [[(*c.values(), None, None) for c in go_chunks(texts[0], limit)]]
    ends = np.cumsum([len(t) for t in texts])
    bases = ends - [len(t) for t in texts]
    spans, of = [], []
    for i, text in enumerate(texts):
        known = lexer.go_plain(text)
        if known is None:
            every = lexer.go_tokens(text)
            known = (lexer.go_header(text, every)[0], [d[:7] for d in lexer.go_declarations(text, every)]) if every else (0, [])
        end, found = known
        if end:
            spans.append(("header", None, None, None, None, len(text) - len(text.lstrip()), end))
        spans += found
        of += [i] * (len(found) + bool(end))
    out: list[list[tuple]] = [[] for _ in texts]
    if not spans:
        return out
    word = kind == 1
    begins = word.copy()
    np.greater(word[1:], word[:-1], out=begins[1:])
    heads = bases[bases < ends]
    begins[heads] = word[heads]
    begins |= kind == 2
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begins, out=before[1:])
    breaks = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), len(data))
    base, until = bases[of], ends[of]
    top = np.searchsorted(breaks[:-1], base)
    first, last = (np.searchsorted(breaks[:-1], base + [s[side] for s in spans]) for side in (5, 6))
    start = np.where(first > top, breaks[first - 1] + 1, base)
    stop = np.minimum(breaks[last], until)
    lines, ahead = (breaks + 1).tolist(), before[breaks].tolist()
    columns = of, spans, *(x.tolist() for x in (first - top + 1, last - top + 1, start, stop, before[start], before[stop], first, last))
    at, labels = -1, []
    for i, span, line, to, a, b, n_a, n_b, i_first, i_last in zip(*columns, strict=True):
        if n_b - n_a <= limit:
            out[i].append((*span[:5], line, to, 0, 1, whole[a:b], n_b - n_a, None))
            continue
        if i != at:
            at, labels = i, _labels(texts[i])
        parts = _known_parts(whole, line, [a, *lines[i_first:i_last], b + 1], [n_a, *ahead[i_first:i_last], n_b], limit)
        out[i] += [(*span[:5], x, y, p if len(parts) > 1 else 0, len(parts), part, size, _label(part, labels)) for p, (x, y, part, size) in enumerate(parts, 1)]
    return out


def _go_chunks(limit: int):
    def run(text: pa.Array) -> pa.Array:
        texts = [x or "" for x in text.to_pylist()]
        found, at = [], 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= _COUNTED:
                size += len(texts[to])
                to += 1
            found += _known_chunks(texts[at:to], limit)
            at = to
        sizes = np.array([len(f) for f in found], np.int64)
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        columns = dict(zip(_GO_FIELDS, list(zip(*[r for f in found for r in f], strict=True)) or [()] * len(_GO_FIELDS), strict=True))
        arrays = {name: pa.array(c, pa.int32() if name in _INTS else pa.string()) for name, c in columns.items()}
        for line in ("start_line", "end_line"):  # of the neighbours
            here = arrays[line].to_numpy()
            edge = np.zeros(len(here) + 1, bool)
            edge[offsets] = True
            arrays[f"before_{line}"] = pa.array(np.roll(here, 1), mask=edge[:-1])
            arrays[f"after_{line}"] = pa.array(np.roll(here, -1), mask=edge[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(arrays.values()), list(arrays)))

    return run


_INTS = frozenset({"start_line", "end_line", "part", "parts", "tokens"})


def go_code_chunks(text: Column, limit: int) -> Column:
    """Array of the chunks of a Go file, with their tokens, where they are known, and the lines of the chunks before and after. Null text counts as empty."""
    return _once(_go_chunks(limit), GO_CHUNKS)(text)
