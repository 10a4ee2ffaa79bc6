"""Text expressions for chunks, snippets, prompts and keys. Column in, Column out, JVM only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that mark a chunk as holding a credential.
SECRET_PATTERNS = (r"AKIA[0-9A-Z]{16}", r"password\s*[:=]\s*[\"'][^\"']+[\"']", r"api[_-]?key\s*[:=]\s*[\"'][^\"']+[\"']")
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "how", "what", "where", "which", "does")
WS = r"[ \t\n\x0B\f\r]"


def strip(text: Column) -> Column:
    """Without leading and trailing ASCII white space, line ends included."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+$", "")


def truncate(text: Column, most: int) -> Column:
    """Stripped; a longer text is cut to ``most`` characters, right-stripped and marked by an ellipsis."""
    whole = strip(text)
    return F.when(F.length(whole) > most, F.concat(rstrip(F.substring(whole, 1, most)), F.lit("…"))).otherwise(whole)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def clip_lines(text: Column, most: int, marker: str = "... (trimmed)") -> Column:
    """The first lines; a marker line where some were cut."""
    all_lines = lines(text)
    return F.when(F.size(all_lines) > most, F.concat(F.array_join(F.slice(all_lines, 1, most), "\n"), F.lit("\n" + marker))).otherwise(text)


def safe_truncate(text: Column, most: int) -> Column:
    """Cut at the last line end, else the last blank, of the last fifth of the limit; else hard."""
    head = F.substring(text, 1, most)
    last = lambda mark: F.length(head) - F.instr(F.reverse(head), mark)
    has = lambda mark: F.instr(head, mark) > 0
    cut = F.when(has("\n") & (last("\n") > 0.8 * most), last("\n")).when(has(" ") & (last(" ") > 0.8 * most), last(" ")).otherwise(F.lit(most))
    return F.when(F.length(text) <= most, text).otherwise(rstrip(F.substring(head, F.lit(1), cut)))


def close_fences(text: Column) -> Column:
    """A closing fence where the number of fences is odd."""
    return F.when(F.regexp_count(text, F.lit("```")) % 2 == 1, F.concat(text, F.lit("\n```"))).otherwise(text)


def snippet(path: Column, start: Column, end: Column, summary: Column, code: Column, most: int = 800) -> Column:
    """Header, summary of up to 200 characters and 30 fenced lines of code fitted to the limit."""
    head = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    short = F.when(F.length(summary) > 0, F.concat(F.lit("\nSummary: "), F.substring(summary, 1, 200))).otherwise(F.lit(""))
    room = F.greatest(F.lit(0), F.lit(most) - F.length(head) - F.length(short) - 9)
    body = F.array_join(F.slice(lines(code), 1, 30), "\n")
    return F.concat(head, short, F.lit("\n```\n"), F.substring(body, F.lit(1), room), F.lit("\n```"))


def trim_code(code: Column, most: int = 1200) -> Column:
    """First 70 % and last 25 % of the limit around a gap mark."""
    return F.when(F.length(code) > most, F.concat(F.substring(code, 1, int(most * 0.7)), F.lit("\n...\n"), F.substring(code, F.length(code) - int(most * 0.25) + 1, F.lit(int(most * 0.25))))).otherwise(code)


def first_line(*texts: Column) -> Column:
    """First non-blank line, stripped, of the first text that has one; else the empty text."""
    one = lambda t: F.get(F.filter(F.transform(lines(F.coalesce(t, F.lit(""))), strip), lambda x: F.length(x) > 0), F.lit(0))
    return F.coalesce(*[one(t) for t in texts], F.lit(""))


def embedding_text(repo: Column, path: Column, lang: Column, symbol: Column, kind: Column, roles: Column, summary: Column, keywords: Column, doc_head: Column, text: Column) -> Column:
    """Labelled sections of a chunk for its embedding; roles, summary, keywords and signature are left out when empty. roles and keywords are arrays; nulls count as empty."""
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    some = lambda label, value: F.when(F.length(value) > 0, F.concat(F.lit(label), value))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[repo]: "), plain(repo)),
        F.concat(F.lit("[path]: "), plain(path)),
        F.concat(F.lit("[lang]: "), plain(lang)),
        F.concat(F.lit("[symbol]: "), plain(symbol), F.lit(" ("), plain(kind), F.lit(")")),
        F.when(F.size(roles) > 0, F.concat(F.lit("[roles]: "), F.array_join(roles, ", "))),
        some("\n[summary]: ", summary),
        F.when(F.size(keywords) > 0, F.concat(F.lit("[keywords]: "), F.array_join(keywords, ", "))),
        some("\n[signature]:\n", first_line(doc_head, text)),
        F.concat(F.lit("\n[code]:\n"), trim_code(plain(text))),
    )


def sha_key(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, digits)


def cache_key(version: str, query: Column, row_id: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit(version), sha_key(query), row_id.cast("string"), sha_key(text))


def provenance_id(row_id: Column, chunk_hash: Column, text: Column) -> Column:
    return F.concat(row_id.cast("string"), F.lit(":"), F.coalesce(F.nullif(chunk_hash, F.lit("")), sha_key(text, 8)))


def extension(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(".")), F.lower(F.element_at(F.split(path, r"\."), -1))).otherwise(F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def meaningful(text: Column) -> Column:
    """Distinct tokens of three characters or more that start with a letter and aren't stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS)))


def has_secret(text: Column) -> Column:
    hit = F.lit(False)
    for pattern in SECRET_PATTERNS:
        hit = hit | text.rlike("(?i)" + pattern)
    return hit


def ascii_ratio(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.length(text))


def is_generated(path: Column, text: Column) -> Column:
    """Generated by name (protobuf, mocks, zz_generated) or by a note in the first 1000 characters."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    note = F.lower(F.substring(text, 1, 1000))
    by_name = F.endswith(name, F.lit(".pb.go")) | F.endswith(name, F.lit("_mock.go")) | F.startswith(name, F.lit("zz_generated.")) | F.contains(name, F.lit("generated")) | F.contains(name, F.lit("mocks"))
    return by_name | F.contains(note, F.lit("code generated")) | F.contains(note, F.lit("do not edit"))


def citations(answer: Column) -> Column:
    """Sorted distinct numbers in [n]."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))


def _first_by_case(items: Column) -> Column:
    """The first of items that are equal in lower case. The items and their lower case are bound to names: within a lambda an expression is evaluated for every item."""
    lowered = lambda x: F.transform(F.array(F.transform(x, F.lower)), lambda low: F.filter(x, lambda _, i: F.array_position(low, F.get(low, i)) == i + 1))
    return F.get(F.get(F.transform(F.array(items), lowered), F.lit(0)), F.lit(0))


def normalized_list(items: Column, most: int | None = None) -> Column:
    """Trimmed items that aren't empty, cut to ``most``, distinct by lower case in first-seen order. Null has no items."""
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda x: F.length(x) > 0)
    return _first_by_case(kept if most is None else F.slice(kept, 1, most))


def clean_terms(terms: Column, most: int = 120) -> Column:
    """Split at commas and semicolons, trimmed, cut to ``most``, distinct by lower case in first-seen order."""
    items = F.slice(F.filter(F.transform(F.split(terms, "[;,]"), strip), lambda x: F.length(x) > 0), 1, most)
    return _first_by_case(items)


def rerank_snippet(path: Column, start: Column, end: Column, summary: Column, language: Column, code: Column, most: int = 800) -> Column:
    """Place, summary of up to 200 characters and fenced code for a reranker.

    The code's line ends are normalised; its first 30 lines, with a comment where some are left
    out, are cut at a line or word to what is left of the limit, and open fences are closed.
    Code is left out where less than 100 characters are left.
    """
    place = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    short = F.when(F.length(summary) > 0, safe_truncate(F.concat(F.lit("Summary: "), summary), 200))
    unix = F.replace(F.replace(code, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    first = let(lines(unix), lambda rows: F.when(F.size(rows) > 30, F.concat(F.array_join(F.slice(rows, 1, 30), "\n"), F.lit("\n// ... (truncated)"))).otherwise(F.array_join(rows, "\n")))
    fenced = lambda used: F.concat(F.lit("\n```"), F.lower(F.coalesce(language, F.lit(""))), F.lit("\n"), let(cut_at(first, F.lit(most - 50) - used), close_fences), F.lit("\n```"))
    return let(F.concat_ws("\n", place, short), lambda head: F.concat_ws("\n", head, F.when((F.length(code) > 0) & (F.length(head) < most - 100), fenced(F.length(head)))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut_at(text: Column, most: Column) -> Column:
    """Like safe_truncate, with a limit that differs from row to row."""

    def cut(whole: Column) -> Column:
        def at(head: Column) -> Column:
            last = lambda mark: F.length(head) - F.instr(F.reverse(head), mark)
            has = lambda mark: F.instr(head, mark) > 0
            end = F.when(has("\n") & (last("\n") > most * 0.8), last("\n")).when(has(" ") & (last(" ") > most * 0.8), last(" ")).otherwise(most)
            return rstrip(F.substring(head, F.lit(1), end))

        return F.when(F.length(whole) <= most, whole).otherwise(let(F.substring(whole, F.lit(1), most), at))

    return let(text, cut)
