"""Repositories from their chunks: file statistics, heads, trees, packs, router documents and guides.

chunks: repo_id, rel_path, chunk_number, start_line, end_line, text, language, symbols (array).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.names import is_test_path
from tesserine.functions.text import clean_terms, lines, strip
from tesserine.operators import ordered
from tesserine.operators.packs import top_values

#: Patterns of files that start a program.
ENTRYPOINTS = (r"(^|/)(main\.py|app\.py|server\.py|manage\.py)$", r"(^|/)cli/.*\.(py|js|ts)$", r"(^|/)bin/[^/]+$", r"(^|/)src/main/(java|go|scala)/", r"(^|/)index\.(js|ts)$")
_LAST = 10**9


def _in_file() -> list[Column]:
    """The order of a file's chunks; those without a line or number come last."""
    return [F.coalesce("start_line", F.lit(_LAST)), F.coalesce("chunk_number", F.lit(_LAST))]


def repositories(chunks: DataFrame, most: int = 10_000) -> DataFrame:
    """(repo_id, count), the largest first."""
    return chunks.groupBy("repo_id").count().orderBy(F.desc("count"), "repo_id").limit(most)


def repository(chunks: DataFrame, repo_id: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of one repository's chunks."""
    return chunks.where(F.col("repo_id") == repo_id).select(*columns)


def file_stats(chunks: DataFrame) -> DataFrame:
    """(repo_id, rel_path, chunks, size, sym_count, language, score) of each file: score is the root of its size plus its number of symbols; the language is that of its first chunk that has one."""
    place = F.struct(F.coalesce("start_line", F.lit(_LAST)), F.coalesce("chunk_number", F.lit(_LAST)))
    by_file = chunks.where("rel_path <> ''").groupBy("repo_id", "rel_path").agg(
        F.count("*").alias("chunks"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("size"), F.sum(F.greatest(F.size("symbols"), F.lit(0))).alias("sym_count"), F.min_by("language", F.when(F.col("language").isNotNull(), place)).alias("language")
    )
    return by_file.withColumn("score", F.round(F.sqrt("size") + F.col("sym_count"), 6))


def top_files(stats: DataFrame, most: int, tests: bool = True, by: str = "score") -> DataFrame:
    """The files of each repository that rank highest, with their place; ties by path."""
    kept = stats if tests else stats.where(~is_test_path(F.col("rel_path")))
    order = Window.partitionBy("repo_id").orderBy(F.desc(by), "rel_path")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def heads(chunks: DataFrame, files: DataFrame, most_lines: int = 50, most_chars: int | None = None) -> DataFrame:
    """(repo_id, rel_path, place, first, last, head): the first lines of each of the few files, chunk after chunk.

    The chunk that crosses the limit is cut; last is the greatest end line of the chunks looked at.
    """
    rows = chunks.join(files.select("repo_id", "rel_path", "place"), ["repo_id", "rel_path"]).withColumn("code", lines(F.coalesce("text", F.lit(""))))
    rows = ordered.running(rows, ["repo_id", "rel_path"], _in_file(), {"at": F.lit(1), "before": F.size("code")}, {"before": most_lines - 1})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("at", "before")})
    piece = F.array_join(F.slice("code", F.lit(1), F.least(F.size("code"), (F.lit(most_lines) - F.col("before")).cast("int"))), "\n")
    out = rows.groupBy("repo_id", "rel_path", "place").agg(F.min("start_line").alias("first"), F.max("end_line").alias("last"), F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))).alias("p"))
    head = F.array_join(F.transform("p", lambda x: x["piece"]), "\n")
    if most_chars:
        head = F.when(F.length(head) > most_chars, F.concat(F.substring(head, 1, most_chars), F.lit("\n# …(trimmed)…"))).otherwise(head)
    return out.select("repo_id", "rel_path", "place", F.coalesce("first", F.lit(1)).alias("first"), F.coalesce("last", F.lit(most_lines)).alias("last"), head.alias("head"))


def tree(files: DataFrame, depth: int = 2, children: int = 10, most: int = 60) -> DataFrame:
    """(repo_id, dir_tree): folders to a depth, each with its first children, until ``most`` children are listed.

    files: repo_id, rel_path. Children are ranked before they are gathered, so a folder of very many files costs one row a child.
    """
    parts = F.split("rel_path", "/")
    alone = F.size(parts) == 1
    key = F.when(alone, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, depth), "/"))
    child = F.when(alone, F.col("rel_path")).otherwise(F.array_join(F.slice(parts, 1, depth + 1), "/"))
    pairs = files.select("repo_id", key.alias("folder"), child.alias("child")).distinct()
    listed = pairs.withColumn("i", F.row_number().over(Window.partitionBy("repo_id", "folder").orderBy("child"))).where(F.col("i") <= children)
    listed = listed.withColumn("n", F.row_number().over(Window.partitionBy("repo_id").orderBy("folder", "i"))).where(F.col("n") <= most)
    line = F.concat(F.when(F.col("i") == 1, F.concat("folder", F.lit("/\n"))).otherwise(F.lit("")), F.lit("  - "), "child")
    out = listed.groupBy("repo_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    return out.select("repo_id", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.when(F.col("n") >= most, F.lit("\n  ...")).otherwise(F.lit(""))).alias("dir_tree"))


def is_entrypoint(path: Column) -> Column:
    out = F.lit(False)
    for pattern in ENTRYPOINTS:
        out = out | path.rlike("(?i)" + pattern)
    return out


def entrypoints(files: DataFrame, most: int = 5) -> DataFrame:
    """(repo_id, entrypoints): the first files by path that start a program."""
    rows = files.select("repo_id", "rel_path").distinct().where(is_entrypoint(F.col("rel_path")))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("repo_id").orderBy("rel_path"))).where(F.col("i") <= most)
    return _gathered(rows, "rel_path", "i", "entrypoints")


def _gathered(rows: DataFrame, value: str, place: str, out: str) -> DataFrame:
    """(repo_id, out): the values of the few rows of each repository in order."""
    return rows.groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value]).alias(out))


def _most_common(rows: DataFrame, value: str, most: int, out: str) -> DataFrame:
    return _gathered(top_values(rows.where(F.col(value).isNotNull()), "repo_id", value, most), value, "place", out)


def _module(rows: DataFrame) -> DataFrame:
    return rows.where(F.contains("rel_path", F.lit("/"))).select("repo_id", F.substring_index("rel_path", "/", 1).alias("module"))


def _packed(chunks: DataFrame, parts: list[DataFrame], file_heads: DataFrame) -> DataFrame:
    shown = file_heads.groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rel_path", "first", "last", "head"))), lambda x: F.struct(x["rel_path"].alias("rel_path"), F.array(x["first"], x["last"]).alias("span"), x["head"].alias("head"))).alias("file_heads"))
    out = chunks.select("repo_id").distinct()
    for part in (*parts, shown):
        out = out.join(part, "repo_id", "left")
    return out


def router_pack(chunks: DataFrame, tests: bool = False) -> DataFrame:
    """One row a repository: languages (5, a vote a file), modules (10, a vote a file), top_symbols (60), important_files (12) and file_heads (4 of 50 lines). Ties by name."""
    stats = file_stats(chunks)
    files = top_files(stats, 12, tests)
    symbols = chunks.where("rel_path <> ''").select("repo_id", F.explode("symbols").alias("symbol"))
    parts = [_most_common(stats, "language", 5, "languages"), _most_common(_module(stats), "module", 10, "modules"), _most_common(symbols, "symbol", 60, "top_symbols"), _gathered(files, "rel_path", "place", "important_files")]
    return _packed(chunks, parts, heads(chunks, files.where("place <= 4"), 50))


def guide_pack(chunks: DataFrame) -> DataFrame:
    """One row a repository: languages (3) and modules (8) with a vote a chunk, top_symbols (30), top_files (10), file_heads (6 of 120 lines and 8,000 characters), dir_tree and entrypoints."""
    stats = file_stats(chunks)
    files = top_files(stats, 10)
    voted = chunks.where("rel_path <> ''").join(stats.select("repo_id", "rel_path", F.col("language").alias("file_language")), ["repo_id", "rel_path"])
    symbols = chunks.where("rel_path <> ''").select("repo_id", F.explode("symbols").alias("symbol"))
    parts = [
        _most_common(voted.select("repo_id", F.col("file_language").alias("language")), "language", 3, "languages"), _most_common(_module(voted), "module", 8, "modules"), _most_common(symbols, "symbol", 30, "top_symbols"),
        _gathered(files, "rel_path", "place", "top_files"), tree(stats), entrypoints(stats),
    ]
    return _packed(chunks, parts, heads(chunks, files.where("place <= 6"), 120, 8000))


def router_document(packs: DataFrame) -> DataFrame:
    """Router documents where no model describes the repository: titles, lists and terms of the pack, capped as stored documents are."""
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none)
    names = F.transform(listed("important_files"), lambda p: F.element_at(F.split(p, "/"), -1))
    terms = F.array_distinct(F.concat(listed("top_symbols"), listed("modules"), names))
    return packs.select(
        "repo_id", F.initcap(F.regexp_replace("repo_id", "[-_]", " ")).alias("short_title"), F.lit("Profile made from counts.").alias("summary"), F.slice(listed("languages"), 1, 8).alias("languages"), none.alias("tech_stack"),
        F.slice(listed("modules"), 1, 20).alias("modules"), F.slice(listed("important_files"), 1, 12).alias("important_files"), F.array_join(clean_terms(F.array_join(listed("top_symbols"), ", ")), ", ").alias("key_symbols"),
        F.array_join(clean_terms(F.array_join(F.slice(terms, 1, 120), ", ")), ", ").alias("keywords"), F.lit("").alias("synonyms"), F.lit("").alias("sample_queries"),
    )


def described(packs: DataFrame, described_by: DataFrame, fields: Sequence[str] = ("short_title", "summary", "tech_stack", "synonyms", "sample_queries")) -> DataFrame:
    """Router documents with the fields that a model's answers (repo_id and fields) give; where its summary is blank, the row keeps its own."""
    answers = described_by.select("repo_id", *[F.col(f).alias(f"__{f}") for f in fields if f in described_by.columns])
    out = router_document(packs).join(answers, "repo_id", "left")
    for f in fields:
        if f"__{f}" in out.columns:
            given = F.col(f"__{f}")
            full = F.size(given) > 0 if f == "tech_stack" else F.length(strip(given)) > 0
            out = out.withColumn(f, F.when(F.coalesce(full, F.lit(False)), given if f == "tech_stack" else strip(given)).otherwise(F.col(f)))
    return out.drop(*answers.columns[1:])


def changed(rows: DataFrame, stored: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """The rows whose digest isn't the stored one of their key: what an upsert has to compute again."""
    return rows.join(stored.select(*keys, digest), [*keys, digest], "left_anti")


def file_guides(chunks: DataFrame, most_lines: int = 400, most_chars: int = 20_000) -> DataFrame:
    """(repo_id, rel_path, first, last, excerpt, excerpt_sha1): what a guide of each file is written from. Chunks follow each other until the limits are passed; the one that passes them is kept."""
    text = F.coalesce("text", F.lit(""))
    sums = {"at": F.lit(1), "chars": F.length(text), "n_lines": F.size(lines(text))}
    rows = ordered.running(chunks, ["repo_id", "rel_path"], _in_file(), sums, {"chars": most_chars, "n_lines": most_lines}).withColumn("at", F.coalesce("at", F.lit(0)))
    out = rows.groupBy("repo_id", "rel_path").agg(F.min("start_line").alias("first"), F.max("end_line").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("text")))), lambda x: x["text"]), "\n").alias("excerpt"))
    return out.withColumn("excerpt_sha1", F.sha1(F.col("excerpt").cast("binary")))


def file_texts(chunks: DataFrame) -> DataFrame:
    """(file, n_chunks, text): the stripped texts of each file's chunks by start line, a blank line between them. A chunk without a path belongs to ``unknown``."""
    file = F.coalesce(F.nullif("rel_path", F.lit("")), F.lit("unknown"))
    body = strip(F.coalesce("text", F.lit("")))
    rows = chunks.select(file.alias("file"), F.coalesce("start_line", F.lit(0)).alias("s"), F.coalesce("chunk_number", F.lit(0)).alias("c"), body.alias("body"))
    parts = F.array_sort(F.collect_list(F.when(F.length("body") > 0, F.struct("s", "c", "body"))))
    return rows.groupBy("file").agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(parts, lambda x: x["body"]), "\n\n").alias("text"))


def listed(routers: DataFrame, most: int = 100) -> DataFrame:
    """The first router documents by id, with defaults for what they lack."""
    out = routers.orderBy("repo_id").limit(most)
    for name, kind in (("short_title", "string"), ("summary", "string"), ("languages", "array<string>"), ("tech_stack", "array<string>"), ("modules", "array<string>")):
        default = F.lit("") if kind == "string" else F.array().cast(kind)
        out = out.withColumn(name, F.coalesce(F.col(name), default) if name in out.columns else default)
    return out.select("repo_id", "short_title", "summary", "languages", "tech_stack", "modules")
