"""Quality rules for Go chunks, as violations and as repairs.

Chunks have: path, chunk_id, start_line, ast_path, text, core, header_context, summary_1l,
qa_terms, imports_used, symbols_defined, symbols_referenced and neighbors (prev, next). A null
counts as empty. Rules on one row need no shuffle; the two that look at a whole file share one
set of range parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.operators import ordered

#: The codes and messages of the rules below, which callers compare, and names that are built in, so never imports.
BUILTINS = ("error", "nil", "true", "false", "string", "int", "bool")
HEADER = "go:file_header"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _blank(name: str) -> Column:
    return F.length(F.trim(_text(name))) == 0


def _row_rules() -> dict[str, list[Column]]:
    """Messages of each rule for one chunk; null where it holds."""
    path, context, imports = _text("ast_path"), _text("header_context"), _list("imports_used")
    header = path == HEADER
    type_name, function_name, method = (F.when(F.startswith(path, F.lit(p)), F.substring(path, len(p) + 1, 1 << 20)) for p in ("go:type:", "go:function:", "go:method:"))
    capital = lambda name: F.substring(name, 1, 1).rlike(r"^\p{Lu}")
    ast = (
        F.when(path == "", F.lit("ast_path is empty")).when(header, F.lit(None))
        .when(type_name.isNotNull(), F.when(~capital(type_name), F.concat(F.lit("Invalid type name in ast_path: "), type_name)))
        .when(function_name.isNotNull(), F.when(~capital(function_name), F.concat(F.lit("Invalid function name in ast_path: "), function_name)))
        .when(method.isNotNull(), F.when(~F.contains(method, F.lit(".")), F.concat(F.lit("Invalid method format in ast_path: "), method)))
        .otherwise(F.concat(F.lit("Unknown ast_path format: "), path))
    )
    first = F.concat(F.lit('import "'), F.coalesce(F.get(imports, F.lit(0)), F.lit("")), F.lit('"'))
    one_form = F.when((F.size(imports) == 1) & ~F.contains(context, first), F.lit("Single import should use single-line format"))
    many_form = F.when((F.size(imports) > 1) & ~F.contains(context, F.lit("import (")), F.lit("Multiple imports should use block format"))
    leaks = F.filter(imports, lambda x: x.isin(*BUILTINS))
    referenced = _list("symbols_referenced")
    itself = F.array_sort(F.array_intersect(_list("symbols_defined"), referenced))
    bare = F.filter(referenced, lambda s: ~F.contains(s, F.lit(".")))
    doubled = F.array_sort(F.filter(F.array_distinct(referenced), lambda s: F.contains(s, F.lit(".")) & F.array_contains(bare, F.element_at(F.split(s, r"\."), -1))))
    terms = F.size(F.filter(F.split(_text("qa_terms"), ","), lambda t: F.length(F.trim(t)) > 0))
    named = F.startswith(path, F.lit("go:function:")) | F.startswith(path, F.lit("go:type:"))
    return {
        "GO_AST_PATH_FORMAT": [ast],
        "GO_HEADER_CONTEXT_PACKAGE": [F.when(~header & ~F.startswith(F.ltrim(context), F.lit("package ")), F.lit("header_context must start with 'package '"))],
        "GO_IMPORTS_MINIMAL_ALPHABETICAL": [F.when(~header & (imports != F.array_sort(imports)), F.lit("imports_used must be alphabetically sorted")), F.when(~header, one_form), F.when(~header, many_form)],
        "GO_IMPORTS_BUILTIN_LEAK": [F.when(F.size(leaks) > 0, F.concat(F.lit("Builtins should not be in imports_used: "), F.array_join(leaks, ", ")))],
        "GO_SYMBOLS_DEFINED_PRESENT": [F.when(named & (F.size(_list("symbols_defined")) == 0), F.lit("Functions and types must have symbols_defined"))],
        "GO_SYMBOLS_SELF_REFERENCE": [F.when(F.size(itself) > 0, F.concat(F.lit("symbols_referenced contains self-references: "), F.array_join(itself, ", ")))],
        "GO_SYMBOLS_QUALIFIED_PREF": [F.when(F.size(doubled) > 0, F.concat(F.lit("Both qualified and bare forms found: "), F.array_join(doubled, ", ")))],
        "GO_PATH_ID_NORMALIZED": [
            F.when(F.startswith(_text("path"), F.lit("/")), F.lit("path should be repo-relative (no leading slash)")),
            F.when((_text("path") != "") & ~F.contains(_text("chunk_id"), _text("path")), F.lit("chunk_id should contain the normalized path")),
        ],
        "GO_NO_EMPTY_CHUNKS": [F.when(_blank("text") | _blank("core"), F.lit("Chunk text and core must not be empty"))],
        "GO_QA_TERMS_COUNT_RANGE": [F.when((F.length(_text("qa_terms")) > 0) & ~terms.between(6, 12), F.concat(F.lit("QA terms should be 6-12 terms, got "), terms.cast("string")))],
    }


def _file_rules() -> dict[str, list[Column]]:
    """Messages of the rules that compare a chunk with the others of its file: ``headers`` of the file, and the chunks ``before`` and ``after``, structs that are null at its ends."""
    headers, header = F.coalesce("headers", F.lit(0)), _text("ast_path") == HEADER
    first, last = F.col("before").isNull(), F.col("after").isNull()
    wrong = lambda side, want: F.when(~F.col(f"neighbors.{side}").eqNullSafe(want), F.concat(F.lit(f"{side} should be "), F.coalesce(want, F.lit("null")), F.lit(", got "), F.coalesce(F.col(f"neighbors.{side}"), F.lit("null"))))
    edges = [F.when(first & F.col("neighbors.prev").isNotNull(), F.lit("First chunk should have prev = null")), F.when(last & F.col("neighbors.next").isNotNull(), F.lit("Last chunk should have next = null"))]
    middle = [F.when(~first & ~last, wrong("prev", F.col("before.chunk_id"))), F.when(~first & ~last, wrong("next", F.col("after.chunk_id")))]
    missing = F.when(headers == 0, F.lit("No go:file_header chunk found")).when((headers > 1) & header, F.lit("Multiple go:file_header chunks found")).when((headers == 1) & header & ~first, F.lit("go:file_header chunk is not first"))
    return {"GO_HEADER_PRESENT_FIRST": [missing], "GO_NEIGHBOR_CHAIN": [*edges, *middle]}


def _broken(rules: dict[str, list[Column]]) -> Column:
    found = F.array(*[F.struct(F.lit(code).alias("code"), message.alias("message")) for code, messages in rules.items() for message in messages])
    return F.filter(found, lambda v: v["message"].isNotNull())


def violations(chunks: DataFrame) -> DataFrame:
    """(path, chunk_id, code, message): one row per broken rule and message. Chunks of a file are ordered by start_line, ties by chunk_id.

    Rules on one row are applied first, so that no text is sorted; a file may have any number of
    chunks, since its rows and their neighbours are found in range parts.
    """
    rows = chunks.select("path", "start_line", "ast_path", "neighbors", F.struct("chunk_id").alias("at"), _broken(_row_rules()).alias("found"))
    headers = chunks.where(_text("ast_path") == HEADER).groupBy("path").agg(F.count("*").alias("headers"))
    placed = ordered.with_few(ordered.beside(rows, ["path"], ["start_line"], "at", "before", "after"), headers, ["path"])
    found = F.concat(_broken(_file_rules()), "found")
    return placed.select("path", F.coalesce("at.chunk_id", F.lit("unknown")).alias("chunk_id"), found.alias("found")).select("path", "chunk_id", F.inline("found"))


def repaired(chunks: DataFrame) -> DataFrame:
    """Chunks with the repairable rules mended: the chain, sorted imports without builtins, symbols, paths, and a package line.

    Rows without text and core are dropped first, so that the chain skips them. The package is
    that of the file's header chunk, else ``main``. The line is put before a context without one.
    """
    rows = chunks.where(~_blank("text") & ~_blank("core"))
    rows = rows.withColumn("path", F.regexp_replace("path", "^/+", ""))
    w = Window.partitionBy("path")
    ordered = w.orderBy(F.when(_text("ast_path") == HEADER, 0).otherwise(1), "start_line", "chunk_id")
    package = F.max(F.when(_text("ast_path") == HEADER, F.nullif(F.regexp_extract(_text("text"), r"(?m)^\s*package\s+(\w+)", 1), F.lit("")))).over(w)
    context = _text("header_context")
    line = F.concat(F.lit("package "), F.coalesce(package, F.lit("main")))
    needs = (_text("ast_path") != HEADER) & ~F.startswith(F.ltrim(context), F.lit("package "))
    imports = F.array_sort(F.array_distinct(F.filter(_list("imports_used"), lambda x: ~x.isin(*BUILTINS))))
    others = F.array_except(_list("symbols_referenced"), _list("symbols_defined"))
    qualified = F.transform(F.filter(others, lambda s: F.contains(s, F.lit("."))), lambda s: F.element_at(F.split(s, r"\."), -1))
    return rows.withColumns({
        "header_context": F.when(needs, F.when(context == "", line).otherwise(F.concat(line, F.lit("\n\n"), context))).otherwise(F.col("header_context")),
        "imports_used": imports,
        "symbols_referenced": F.filter(others, lambda s: F.contains(s, F.lit(".")) | ~F.array_contains(qualified, s)),
        "neighbors": F.struct(F.lag("chunk_id").over(ordered).alias("prev"), F.lead("chunk_id").over(ordered).alias("next")),
    })
